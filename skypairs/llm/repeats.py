"""Repeated passages by prefix-partitioned suffix trees (operator 8).

A suffix is the text from some word on. Two documents share a passage of `length` words where two of their suffixes run through
one internal node at that depth of the suffix tree. The tree is built in parts, each of which fits a fixed memory:

1. Of the suffixes that begin inside any window of `length` words, the one whose prefix of 7 words hashes lowest stands
   for the window, so equal windows are stood for at the same place. Suffixes are split by these prefixes; a prefix that
   a single document has leads to no internal node and is dropped.
2. The windows left are sent, as runs of words, to the group of the prefix that stands for them. A group's suffixes are
   sorted by doubling the compared length (1, 2, 4, 8, `length` words): that is the group's suffix array, and where
   neighbours agree in `length` words is a deep internal node of its subtree. Of its documents the one with the smallest
   key is kept, and the windows of all others are repeats.

Groups are dealt to buckets, whose number follows the counted words. A bucket that holds more words than a task may gather
is split again by longer prefixes, of the windows' own first 10 and then `length` words, in a further round; with `length`
words a group is one node and is folded as it streams by. Before any exchange, each task merges its own: a passage that many documents of a task
share leaves it once. Neighbouring repeats make the maximal repeated passages of a document.

Words are compared by 64-bit hashes, the prefixes of groups too; windows word by word.

Edge cases: null texts have no words. Texts shorter than `length` words have no windows. Repeats inside one document, and
between rows with equal keys, don't count; a null key counts as larger than any other. Repeated rows give equal rows. A
text of any length is one row. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skypairs.llm.columns import binary_rows, flat, ranges, written
from skypairs.llm.dart import mix
from skypairs.llm.words import slices

LENGTH, SHORT = 13, 7
#: Prefixes of later rounds, in words; `length` is the last.
LONGER = 10
#: Words that a task merges at a time.
GATHER = 1_000_000
#: Bytes of text to a bucket of short prefixes.
BUCKET = 32 << 20
_BLANKS = r"[\x20\x09-\x0D]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KINDS = "u1u2u4u8i8"


def _prefixes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, where there are as many."""
    out = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        out = mix(out * _STEP + words[k:len(words) - n + 1 + k] + np.uint64(k))
    return out


def _standing(words: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of every row, in order: its first word, the word at which its suffix stands, and that suffix's
    short prefix. All places count from the start of the array."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    first = ranges(offsets[:-1], counts)
    short = _prefixes(words, SHORT)
    best, at = short[first].copy(), first.copy()
    for k in range(1, length - SHORT + 1):
        lower = short[first + k] < best
        best[lower], at[lower] = short[first + k][lower], first[lower] + k
    return first, at, best


def _batched(batches: Iterator[pa.RecordBatch], column: int, gather: int) -> Iterator[pa.Table]:
    """Runs of whole rows with about `gather` list values."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        begin, ends = 0, flat(batch.column(column))[1][1:]
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + gather - total, "right")))
            held.append(batch.slice(begin, end - begin))
            total += int(ends[end - 1] - done)
            begin = end
            if total >= gather:
                yield pa.Table.from_batches(held).combine_chunks()
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    values, offsets = flat(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return values.to_numpy().view(np.uint64), offsets


class Rows:
    """Which row of the table something belongs to: its key, whether that is null, and the mark of its text."""

    def __init__(self, doc: np.ndarray, none: np.ndarray, mark: np.ndarray):
        self.doc, self.none, self.mark = doc, none, mark

    @classmethod
    def of(cls, table: pa.Table) -> Rows:
        doc = table.column(0).combine_chunks() if isinstance(table, pa.Table) else table.column(0)
        return cls(doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), table.column(1).to_numpy())

    def __getitem__(self, index: np.ndarray) -> Rows:
        return Rows(self.doc[index], self.none[index], self.mark[index])

    @property
    def arrays(self) -> list[np.ndarray]:
        return [self.doc, self.none, self.mark]

    @property
    def columns(self) -> list[pa.Array]:
        return [pa.array(self.doc, mask=self.none.astype(bool)), pa.array(self.mark)]

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        return Rows(*(np.concatenate(a) for a in zip(*(p.arrays for p in parts), strict=True)))

    def same_key(self, other: Rows) -> np.ndarray:
        return (self.doc == other.doc) & (self.none == other.none)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal tuples begin."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))


def _spread(start: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the begin of its run."""
    return np.repeat(start, np.diff(np.append(start, n)))


def _halves(place: np.ndarray) -> list[np.ndarray]:
    return [(place & 0xFFFF).astype(np.uint16), (place >> 16).astype(np.uint16)]


def _place(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | high.astype(np.int64) << 16


_SCHEMA = "bucket int, doc long, mark long, place int, packed binary, depth int"
_NAMES = ["bucket", "doc", "mark", "place", "packed", "depth"]


def _record(bucket: int, arrays: list[np.ndarray], depth: int | None = None) -> pa.RecordBatch:
    head = np.array([len(arrays), *(x for a in arrays for x in (a.nbytes, _KINDS.index(a.dtype.str[1:])))], "<i8")
    packed = head.tobytes() + b"".join(a.tobytes() for a in arrays)
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
                                       pa.array([packed], pa.binary()), pa.array([depth], pa.int32())], _NAMES)


def _unpacked(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head, at, out = np.frombuffer(data, "<i8", 2 * n, 8).reshape(-1, 2), 8 + 16 * n, []
    for size, kind in head.tolist():
        dtype = _KINDS[kind:kind + 2]
        out.append(np.frombuffer(data, "<" + dtype, size // int(dtype[1]), at))
        at += size
    return out


def _through(rows: Rows, place: np.ndarray | None = None, packed: list[bytes] | None = None) -> pa.RecordBatch:
    """Records that need no merging."""
    n = len(rows.doc)
    return pa.RecordBatch.from_arrays(
        [pa.array((rows.mark & 1023).astype(np.int32)), *rows.columns, pa.nulls(n, pa.int32()) if place is None else pa.array(place.astype(np.int32)),
         pa.nulls(n, pa.binary()) if packed is None else pa.array(packed, pa.binary()), pa.nulls(n, pa.int32())], _NAMES)


def _parts(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b]:cuts[b + 1]]


def _short_groups(buckets: int, length: int, gather: int):
    """Entries of the short prefixes: packed by bucket, or, where a prefix is already shared, the places themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batched(batches, 2, gather):
            words, offsets = _words(table.column(2))
            rows = Rows.of(table)
            del table
            _, at, key = _standing(words, offsets, length)
            if not len(at):
                continue
            new = _runs(at)
            at, key = at[new], key[new]
            row = np.searchsorted(offsets, at, "right") - 1
            order = np.argsort(key, kind="stable")
            at, key, row = at[order], key[order], row[order]
            start = _runs(key)
            other = ~rows[row].same_key(rows[row[_spread(start, len(key))]])
            several = np.logical_or.reduceat(other, start)
            shared = np.repeat(several, np.diff(np.append(start, len(key))))
            yield _through(rows[row[shared]], (at - offsets[row])[shared])
            # one entry for a shared prefix, marked by a place that can't be
            sent = np.concatenate([np.flatnonzero(~shared), start[several]])
            place = np.where(shared[sent], -1, (at - offsets[row])[sent])
            key, row = key[sent], row[sent]
            del at, order, other, shared, words
            for b, part in _parts((key % np.uint64(buckets)).astype(np.int64), buckets):
                who, index = np.unique(row[part], return_inverse=True)
                yield _record(b, [key[part], index.astype(np.uint32), *_halves(place[part]), *rows[who].arrays])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | list[list[np.ndarray]]]:
    """Rows that pass through, and the packed records of one bucket after another (the rows come sorted by bucket)."""
    current, held = None, []
    for batch in batches:
        through = batch.column(2).is_valid()
        if through.true_count:
            yield batch.filter(through)
        for bucket, known, packed in zip(batch.column(0).to_pylist(), through.to_pylist(), batch.column(4), strict=True):
            if not known:
                if bucket != current and held:
                    yield held
                    held = []
                current = bucket
                held.append(_unpacked(packed.as_py()))
    if held:
        yield held


def _shared_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, mark and place of the suffixes whose short prefix several documents share."""
    for held in _by_bucket(batches):
        if isinstance(held, pa.RecordBatch):
            yield held.select(["doc", "mark", "place"])
            continue
        key = np.concatenate([h[0] for h in held])
        rows = Rows.joined([Rows(*h[4:7])[h[1]] for h in held])
        place = np.concatenate([_place(h[2], h[3]) for h in held])
        held.clear()
        order = np.argsort(key, kind="stable")
        key, rows, place = key[order], rows[order], place[order]
        start = _runs(key)
        joint = place == 0xFFFFFFFF  # a prefix that was shared before it was sent
        several = np.logical_or.reduceat(~rows.same_key(rows[_spread(start, len(key))]) | joint, start)
        keep = np.repeat(several, np.diff(np.append(start, len(key)))) & ~joint
        yield pa.RecordBatch.from_arrays([*rows[keep].columns, pa.array(place[keep].astype(np.int32))], ["doc", "mark", "place"])


def _later(rows: Rows, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by node and key, and in it which entries have a larger key than the smallest of their node."""
    order = np.lexsort((rows.doc, rows.none, node))
    rows, start = rows[order], _runs(node[order])
    return order, ~rows.same_key(rows[_spread(start, len(order))])


def _places(rows: Rows, place: np.ndarray) -> pa.RecordBatch:
    """Places of repeats, packed by row of the table."""
    order = np.lexsort((place, rows.mark, rows.doc, rows.none))
    rows, place = rows[order], place[order]
    start = _runs(*rows.arrays)
    ends = np.append(start[1:], len(place))[:len(start)]
    return _through(rows[start], packed=[place[a:b].astype("<u4").tobytes() for a, b in zip(start, ends, strict=True)])


class Runs:
    """Runs of words, each with the row and the place where it begins; windows of `length` words begin at all but the last length - 1."""

    def __init__(self, words: np.ndarray, size: np.ndarray, row: np.ndarray, place: np.ndarray, rows: Rows):
        self.words, self.size, self.row, self.place, self.rows = words, size, row, place, rows

    @classmethod
    def of(cls, held: list[list[np.ndarray]]) -> Runs:
        base = np.cumsum([0, *(len(h[7]) for h in held[:-1])])
        return cls(np.concatenate([h[5][h[6]] for h in held]), np.concatenate([h[4] for h in held]).astype(np.int64),
                   np.concatenate([h[1].astype(np.int64) + b for h, b in zip(held, base, strict=True)]),
                   np.concatenate([_place(h[2], h[3]) for h in held]), Rows.joined([Rows(*h[7:10]) for h in held]))

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    def single(self, length: int) -> Runs:
        """Each window as a run of its own."""
        count = self.size - length + 1
        first = ranges(self.start, count)
        return Runs(self.words[ranges(first, np.full(len(first), length))], np.full(len(first), length), np.repeat(self.row, count),
                    ranges(self.place, count), self.rows)

    def dealt(self, key: np.ndarray, buckets: int, depth: int) -> Iterator[pa.RecordBatch]:
        start = self.start
        for b, part in _parts((key % np.uint64(buckets)).astype(np.int64), buckets):
            who, index = np.unique(self.row[part], return_inverse=True)
            names, codes = np.unique(self.words[ranges(start[part], self.size[part])], return_inverse=True)
            yield _record(b, [key[part], index.astype(np.uint32), *_halves(self.place[part]), self.size[part].astype(np.uint16), names,
                              codes.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32), *self.rows[who].arrays], depth)

    def nodes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows, and the number of each window's node at that depth: equal windows, equal numbers, in
        the order of the suffix array."""
        rank = np.unique(self.words, return_inverse=True)[1].astype(np.int64)
        done = 1
        while done < length:
            step = min(done, length - done)
            rank = np.unique(rank[:len(rank) - step] << 32 | rank[step:], return_inverse=True)[1].astype(np.int64)
            done += step
        first = ranges(self.start, self.size - length + 1)
        return first, rank[first]


def _window_groups(buckets: int, length: int, gather: int):
    """Windows whose suffix is left: runs of words packed by bucket, or repeats of documents of the same task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batched(batches, 2, gather):
            words, offsets = _words(table.column(2))
            left, bounds = flat(table.column(3).combine_chunks())
            rows = Rows.of(table)
            del table
            first, at, short = _standing(words, offsets, length)
            if not len(first):
                continue
            standing = np.zeros(len(words) + 1, bool)
            marked = left.to_numpy() + np.repeat(offsets[:-1], np.diff(bounds))
            # rows with equal keys and marks share their places; those beyond a row's end are another row's
            standing[marked[marked < np.repeat(offsets[1:], np.diff(bounds))]] = True
            left = standing[at]
            first, at, short = first[left], at[left], short[left]
            if not len(first):
                continue
            row = np.searchsorted(offsets, first, "right") - 1
            whole = _prefixes(words, length)[first]
            order, again = _later(rows[row], whole)
            repeated = np.sort(order[again])
            yield _places(rows[row[repeated]], (first - offsets[row])[repeated])
            # all rows with the smallest key are sent: another task may have a smaller one
            sent = np.ones(len(first), bool)
            sent[repeated] = False
            first, at, short, row = first[sent], at[sent], short[sent], row[sent]
            del whole, order, again, left, sent, standing
            fresh = np.ones(len(first), bool)
            fresh[1:] = (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)
            begin = np.flatnonzero(fresh)
            size = np.diff(np.append(begin, len(first))) + length - 1
            yield from Runs(words[ranges(first[begin], size)], size, row[begin], (first - offsets[row])[begin], rows).dealt(short[begin], buckets, SHORT)

    return run


def _subtrees(buckets: int, length: int, gather: int, depth: int):
    """The windows that a document with a smaller key has too, packed by row of the table; and runs of buckets that hold too
    many words, by longer prefixes."""
    def found(runs: Runs) -> Iterator[pa.RecordBatch]:
        first, node = runs.nodes(length)
        count = runs.size - length + 1
        row, place = np.repeat(runs.row, count), ranges(runs.place, count)
        order, again = _later(runs.rows[row], node)
        at = order[again]
        yield from by_row(runs.rows, row[at], place[at])

    def by_row(rows: Rows, row: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        spread = mix(mix(rows.doc.view(np.uint64)) + rows.mark.view(np.uint64))[row]
        for b, part in _parts((spread % np.uint64(buckets)).astype(np.int64), buckets):
            who, index = np.unique(row[part], return_inverse=True)
            yield _record(b, [index.astype(np.uint32), *_halves(place[part]), *rows[who].arrays])

    def folded(least: Runs | None, more: Runs) -> tuple[Runs, Iterator[pa.RecordBatch]]:
        """Single windows with the smallest key of each node, after more of them; the others are repeats."""
        if least is not None:
            more = Runs(*(np.concatenate(a) for a in zip((least.words, least.size, least.row, least.place),
                                                         (more.words, more.size, more.row + len(least.rows.doc), more.place), strict=True)),
                        Rows.joined([least.rows, more.rows]))
        order, again = _later(more.rows[more.row], more.nodes(length)[1])
        keep = np.sort(order[~again])
        who, index = np.unique(more.row[keep], return_inverse=True)
        repeated = [*by_row(more.rows, more.row[order[again]], more.place[order[again]])]
        return Runs(more.words.reshape(-1, length)[keep].reshape(-1), more.size[keep], index, more.place[keep], more.rows[who]), repeated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size, least, split = None, [], 0, None, False
        deeper = LONGER if depth < LONGER < length else length

        def longer(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            runs = Runs.of(held).single(length)
            key = _prefixes(runs.words, deeper)[runs.start]
            yield from runs.dealt(key, buckets * 7 + 1, deeper)

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal least
            if held and split:
                yield from longer(held)
            elif held and depth == length:
                least, repeated = folded(least, Runs.of(held).single(length))
                yield from repeated
            elif held:
                yield from found(Runs.of(held))
            held.clear()

        for batch in batches:
            through = batch.column(2).is_valid()
            if through.true_count:
                yield batch.filter(through)
            for bucket, known, packed in zip(batch.column(0).to_pylist(), through.to_pylist(), batch.column(4), strict=True):
                if known:
                    continue
                if bucket != current:
                    yield from finish()
                    current, size, least, split = bucket, 0, None, False
                held.append(_unpacked(packed.as_py()))
                size += len(held[-1][6])
                if size > gather:
                    split = depth < length
                    yield from finish()
                    size = 0 if depth == length or split else size
                    split = depth < length
        yield from finish()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, mark and places of the repeats of each row of the table."""
    for held in _by_bucket(batches):
        if not isinstance(held, pa.RecordBatch):
            place = np.concatenate([_place(h[1], h[2]) for h in held])
            held = _places(Rows.joined([Rows(*h[3:6])[h[0]] for h in held]), place)
        yield held.select(["doc", "mark", "packed"])


def _marks(text: str) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def _kept(length: int):
    """n_words, n_removed and the words that stay, joined by single blanks."""
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = binary_rows(batch.column(1))
            gap = np.ones(len(data) + 1, bool)
            gap[:-1] = blank[data]
            begins = ~gap[:-1] & np.concatenate([[True], gap[:-2]])[:len(data)]
            edges = offsets[:-1][offsets[:-1] < len(data)]
            begins[edges] |= ~gap[edges]
            start = np.flatnonzero(begins)
            stop = np.flatnonzero(gap)
            row = np.searchsorted(offsets, start, "right") - 1
            end = np.minimum(stop[np.searchsorted(stop, start)], offsets[row + 1]) if len(start) else start
            count = np.bincount(row, minlength=batch.num_rows)
            base = np.cumsum(count) - count
            change = np.zeros(len(start) + 1, np.int64)
            for k in np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False)).tolist():
                at = base[k] + np.unique(np.concatenate([np.frombuffer(p, "<u4") for p in batch.column(2)[k].as_py()]).astype(np.int64))
                change[at] += 1
                change[at + length] -= 1
            stays = np.cumsum(change[:-1]) == 0
            size = end[stays] - start[stays] + 1
            ahead = np.concatenate([[0], np.cumsum(size)])
            out = np.full(ahead[-1], 32, np.uint8)
            out[ranges(ahead[:-1], size - 1)] = data[ranges(start[stays], size - 1)]
            left = np.bincount(row[stays], minlength=batch.num_rows)
            to = ahead[np.cumsum(left)]
            texts = [out[a:max(a, b - 1)].tobytes() for a, b in zip(np.concatenate([[0], to[:-1]]), to, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array(count - left), pa.array(texts, pa.binary())],
                ["key", "n_words", "n_removed", "kept"])
    return run


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                    gather: int = GATHER) -> DataFrame:
    """key (long), n_words, n_removed and kept (UTF-8 bytes: the words left, joined by single blanks) of each row. A word goes
    if it is in a window of `length` words that also starts in a document with a smaller key. gather: words that a task
    merges at a time, and that a bucket may hold."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc"), _marks(text).alias("mark"), F.col(text).alias("text"))
    tokens = F.filter(F.split(F.coalesce("text", F.lit("")), _BLANKS), lambda w: w != "")
    hashes = F.transform(tokens, lambda w: F.xxhash64(w)).alias("words")

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions = max(least, -(-size // BUCKET))

    def dealt(packed: DataFrame) -> DataFrame:
        return packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["doc"].eqNullSafe(b["doc"]) & (a["mark"] == b["mark"])

    short = written(dealt(rows.select("doc", "mark", hashes).mapInArrow(_short_groups(n, length, gather), _SCHEMA))
                    .mapInArrow(_shared_prefixes, "doc long, mark long, place int"))
    places = short.groupBy("doc", "mark").agg(F.collect_set("place").alias("places"))
    # a run has about length + 4 words, and a bucket half of what a task may gather
    n = max(least, -(-short.count() * (length + 4) * 2 // gather))
    packed = (rows.join(places.hint("merge"), same(rows, places)).select(rows["doc"], rows["mark"], hashes, "places")
              .mapInArrow(_window_groups(n, length, gather), _SCHEMA))
    finished, depth = [], SHORT
    while True:
        packed = written(dealt(packed).mapInArrow(_subtrees(n, length, gather, depth), _SCHEMA))
        finished.append(packed.filter("depth IS NULL"))
        packed = packed.filter("depth IS NOT NULL")
        if depth == length or packed.limit(1).count() == 0:
            break
        depth, n = packed.select("depth").first()[0], 7 * n + 1
    again = finished[0]
    for more in finished[1:]:
        again = again.union(more)
    found = (dealt(again).mapInArrow(_merged, "doc long, mark long, packed binary")
             .groupBy("doc", "mark").agg(F.collect_list("packed").alias("found")))
    both = rows.join(found.hint("merge"), same(rows, found), "left").select(rows["doc"].alias("key"), "text", "found")
    return both.mapInArrow(_kept(length), "key long, n_words long, n_removed long, kept binary").withColumnRenamed("key", key)
