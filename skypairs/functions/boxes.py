"""Points of one block in numpy: halved into boxes of equal size, and counted against another block by these boxes.

A pair of boxes whose distances all fall between the same two edges adds a product; the boxes of others are halved, and only
points of the smallest boxes that straddle an edge are compared one by one, by the formula a brute-force count uses.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

# the smallest boxes hold this many points, up to twice as many
LEAF = 12
# relative room for rounding where boxes are judged
EPS = 1e-12
# pairs of boxes handled at once, and point pairs
PAIRS, POINT_PAIRS = 1 << 15, 1 << 17


def halved(xyz: np.ndarray, levels: int) -> np.ndarray:
    """Order of the points (3, n) in which 2**levels equal runs are boxes: each half is cut at the median of its longest
    side. The runs are filled up with n, which stands for no point."""
    n = xyz.shape[1]
    order = np.minimum(np.arange(-(-n // (1 << levels)) << levels), n)
    xyz = np.concatenate([xyz, np.full((3, 1), np.nan)], axis=1)
    for k in range(levels):
        order = order.reshape(1 << k, -1)
        at = xyz[:, order]
        wide = np.fmax.reduce(at, axis=2) - np.fmin.reduce(at, axis=2)
        longest = np.argmax(np.nan_to_num(wide, nan=-1.0), axis=0)
        key = np.take_along_axis(at, longest[None, :, None], axis=0)[0]
        order = np.take_along_axis(order, np.argpartition(key, order.shape[1] // 2, axis=1), axis=1)
    return order.reshape(-1)


class Boxes:
    """A block: points (3, n) in the order of ``halved`` with NaN where there is none, ``c`` in each smallest box, and their
    weights (zero where there is no point; None: one each) and ids. ``lo``, ``hi``, ``n``, ``w`` and ``w2`` have an entry a level,
    the whole block first."""

    def __init__(self, xyz: np.ndarray, c: int, weights: np.ndarray | None = None, ids: np.ndarray | None = None):
        # the smallest boxes are the last axis: what numpy repeats runs over many of them
        self.points = np.ascontiguousarray(xyz.reshape(3, -1, c).transpose(0, 2, 1))
        self.weights = None if weights is None else np.ascontiguousarray(weights.reshape(-1, c).T)
        self.ids = None if ids is None else np.ascontiguousarray(ids.reshape(-1, c).T)
        there = ~np.isnan(self.points[0])
        w = there.astype(np.int64) if weights is None else self.weights
        lo, hi = np.fmin.reduce(self.points, axis=1), np.fmax.reduce(self.points, axis=1)
        levels = [(lo, hi, there.sum(axis=0), w.sum(axis=0), (w * w).sum(axis=0))]
        while levels[0][0].shape[1] > 1:
            lo, hi, *sums = levels[0]
            levels.insert(0, (np.fmin(lo[:, ::2], lo[:, 1::2]), np.fmax(hi[:, ::2], hi[:, 1::2]), *(s[::2] + s[1::2] for s in sums)))
        self.lo, self.hi, self.n, self.w, self.w2 = zip(*levels)
        self.depth = len(levels) - 1

    @cached_property
    def by_id(self) -> np.ndarray:
        """Points in the order of their ids; those that stand for no point are left out."""
        at = np.flatnonzero(~np.isnan(self.points[0]))
        return at[np.argsort(self.ids.reshape(-1)[at])]

    @cached_property
    def ranked(self) -> np.ndarray:
        return self.ids.reshape(-1)[self.by_id]


def judged(a: Boxes, la: int, i: np.ndarray, b: Boxes, lb: int, j: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many edges (squared) are certainly not above, and possibly not above, the squared distances of pairs of boxes."""
    near = far = 0.0
    for k in range(3):
        down = a.lo[la][k][i] - b.hi[lb][k][j]
        up = b.lo[lb][k][j] - a.hi[la][k][i]
        gap = np.maximum(np.maximum(down, up), 0.0)
        span = np.minimum(down, up)
        near, far = near + gap * gap, far + span * span
    return edges.searchsorted(near * (1 - EPS), "right"), edges.searchsorted(far * (1 + EPS), "right")


def straddling(a: Boxes, b: Boxes, edges: np.ndarray, decided):
    """Walks down the pairs of boxes of two blocks, or of one with itself. ``decided`` gets (level_a, i, level_b, j, edges below)
    of those that no edge cuts; the smallest ones that an edge cuts are yielded as (i, j, lo, hi), many at a time."""
    zero = np.zeros(1, np.int64)
    todo, left, held = [(0, 0, zero, zero)], [], 0
    while todo:
        la, lb, i, j = todo.pop()
        lo, hi = judged(a, la, i, b, lb, j, edges)
        sure = lo == hi
        decided(la, i[sure], lb, j[sure], lo[sure])
        cut = ~sure
        i, j = i[cut], j[cut]
        if not len(i):
            continue
        if la == a.depth and lb == b.depth:
            left.append((i, j, lo[cut], hi[cut]))
            held += len(i)
            if held >= 16 * PAIRS:
                yield tuple(map(np.concatenate, zip(*left)))
                left, held = [], 0
            continue
        if la < a.depth:
            i, j, la = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j]), la + 1
        if lb < b.depth:
            i, j, lb = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1]), lb + 1
        if a is b:
            once = i <= j
            i, j = i[once], j[once]
        todo.extend((la, lb, i[k:k + PAIRS], j[k:k + PAIRS]) for k in range(0, len(i), PAIRS))
    if left:
        yield tuple(map(np.concatenate, zip(*left)))


class Distances:
    """Squared distances of all points of pairs of smallest boxes, as (point of a, point of b, pair); NaN where there is no
    point. The arrays are kept from call to call."""

    def __init__(self, a: Boxes, b: Boxes):
        self.a, self.b = a, b
        self.size = a.points.shape[1], b.points.shape[1]
        self.step = max(1, POINT_PAIRS // (self.size[0] * self.size[1]))
        self.room = np.empty((2, self.size[0] * self.size[1] * self.step))
        self.mask = np.empty(self.room.shape[1], bool)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shape = (*self.size, len(i))
        out, other = (r[:shape[0] * shape[1] * shape[2]].reshape(shape) for r in self.room)
        for k in range(3):
            d = other if k else out
            np.subtract(self.a.points[k].take(i, axis=1)[:, None, :], self.b.points[k].take(j, axis=1)[None, :, :], out=d)
            np.multiply(d, d, out=d)
            if k:
                np.add(out, d, out=out)
        return out

    def under(self, r2: np.ndarray, edge: float) -> np.ndarray:
        return np.less(r2, edge, out=self.mask[:r2.size].reshape(r2.shape))


def pair_histogram(a: Boxes, b: Boxes, edges: np.ndarray) -> np.ndarray:
    """Sums of w_a * w_b over the pairs of points of two blocks, or the unordered ones of one (``a is b``), by the number of edges
    (squared, ascending) that their squared distance has reached."""
    if float(a.w[0][0]) * float(b.w[0][0]) >= 2.0 ** 62:
        raise OverflowError("the pairs of two blocks are more than a long holds")
    same, out = a is b, np.zeros(len(edges) + 1, np.int64)

    def product(la, i, lb, j):
        both = a.w[la][i] * b.w[lb][j]
        return np.where(i == j, (both - a.w2[la][i]) // 2, both) if same else both

    def decided(la, i, lb, j, below):
        np.add.at(out, below, product(la, i, lb, j))

    def weights(block, at):
        return np.ones((block.points.shape[1], len(at)), np.int64) if block.weights is None else block.weights.take(at, axis=1)

    plain = a.weights is None and b.weights is None
    distances = Distances(a, b)
    step = distances.step
    for i, j, lo, hi in straddling(a, b, edges, decided):
        kind = (lo * (len(edges) + 1) + hi) * 2 + (same & (i == j))
        order = np.argsort(kind, kind="stable")
        starts = np.flatnonzero(np.diff(kind[order], prepend=-1))
        for first, last in zip(starts, [*starts[1:], len(order)]):
            l, h, alone = lo[order[first]], hi[order[first]], kind[order[first]] & 1
            for k in range(first, last, step):
                at = order[k:min(k + step, last)]
                r2 = distances.of(i[at], j[at])
                if alone:
                    r2[np.tril_indices(len(r2))] = np.nan
                if not plain:
                    w = weights(a, i[at])[:, None, :] * weights(b, j[at])[None, :, :]
                before = 0
                for e in range(l, h):
                    under = distances.under(r2, edges[e])
                    n = int(np.count_nonzero(under)) if plain else int((w * under).sum())
                    out[e] += n - before
                    before = n
                out[h] += int(product(a.depth, i[at], b.depth, j[at]).sum()) - before
    return out


class Near:
    """For each point of a block the number of points of other blocks, or of itself, below a squared distance; ``directed``
    counts only those with a larger id. Points are of weight one."""

    def __init__(self, home: Boxes, edge: float, directed: bool):
        self.home, self.directed = home, directed
        self.edges = np.array([edge])
        self.points = np.zeros(home.points.shape[1:], np.int64)
        self.boxes = [np.zeros(n.shape, np.int64) for n in home.n]
        self.gain = 0

    def add_whole(self, ids: np.ndarray) -> None:
        """The larger ids of a block, in ascending order, whose points are all within reach of all of this one."""
        larger = len(ids) - ids.searchsorted(self.home.ranked, "right")
        self.points.reshape(-1)[self.home.by_id] += larger

    def add(self, b: Boxes) -> None:
        a, same = self.home, self.home is b
        b = Boxes.__new__(Boxes) if same else b
        if same:  # both orders of each pair count here
            b.__dict__.update(a.__dict__)
        ca, leaves = self.points.shape
        if self.directed:
            # ids as their places in the order of b's: as many of them are below
            order = b.ranked
            place, mine = np.zeros(a.ids.shape, np.int64), np.full(b.ids.shape, -1)
            place.reshape(-1)[a.by_id] = order.searchsorted(a.ranked, "right")
            mine.reshape(-1)[b.by_id] = np.arange(len(order))
            sure: dict[tuple[int, int], list] = {}

        def decided(la, i, lb, j, below):
            i, j = i[below == 0], j[below == 0]
            if not len(i):
                return
            if self.directed:
                sure.setdefault((la, lb), []).append((i, j))
            else:
                np.add.at(self.boxes[la], i, b.n[lb][j])

        distances = Distances(a, b)
        for i, j, _, _ in straddling(a, b, self.edges, decided):
            order_i = np.argsort(i, kind="stable")
            i, j = i[order_i], j[order_i]
            for k in range(0, len(i), distances.step):
                p, q = i[k:k + distances.step], j[k:k + distances.step]
                under = distances.under(distances.of(p, q), self.edges[0])
                if self.directed:
                    under &= place.take(p, axis=1)[:, None, :] <= mine.take(q, axis=1)[None, :, :]
                n = np.add.reduce(under.view(np.uint8), axis=1, dtype=np.int64)
                first = np.flatnonzero(np.diff(p, prepend=-1))
                self.points[:, p[first]] += np.add.reduceat(n, first, axis=1)
        if self.directed:
            self._larger(sure, b, place, mine, len(order))

    def _larger(self, sure: dict, b: Boxes, place: np.ndarray, mine: np.ndarray, n: int) -> None:
        """Points of decided pairs of boxes: for each of one the larger ids of the other, by bisection in its order."""
        c, leaves = self.points.shape
        for (la, lb), parts in sure.items():
            i, j = map(np.concatenate, zip(*parts))
            size_a, size_b = leaves >> la, mine.shape[1] >> lb
            # the places of each box of b in ascending order, one box after the other
            boxes = mine.T.reshape(1 << lb, -1) + 1
            ranked = (np.sort(boxes, axis=1) + np.arange(1 << lb)[:, None] * (n + 1)).reshape(-1)
            width = boxes.shape[1]
            step = max(1, POINT_PAIRS // (c * size_a))
            order = np.argsort(i, kind="stable")
            for k in range(0, len(i), step):
                p, q = i[order[k:k + step]], j[order[k:k + step]]
                mates = place.T.reshape(1 << la, -1)[p]
                larger = (q[:, None] + 1) * width - ranked.searchsorted(mates + 1 + q[:, None] * (n + 1))
                first = np.flatnonzero(np.diff(p, prepend=-1))
                sums = np.add.reduceat(larger, first, axis=0).reshape(len(first), size_a, c)
                self.points.reshape(c, 1 << la, size_a)[:, p[first], :] += sums.transpose(2, 0, 1)

    def sums(self) -> np.ndarray:
        leaves = self.points.shape[1]
        out = self.points + sum(np.repeat(n, leaves // len(n)) for n in self.boxes) + self.gain
        out[np.isnan(self.home.points[0])] = 0
        return out
