"""Licence scans by patience alignment (operator 3).

A notice is looked for around each of its key words. There, document and template are aligned: equal words at both
ends are taken; words that occur once in the document's part and once in the template's are anchors; the longest
subsequence of anchors that ascends in both is kept; and the gaps between them are aligned in the same way. Coverage is
the share of the template's words that are aligned. The key words of a template are its longest words, as many as it
takes for a coverage of `least` to need one of them, so that nothing is missed by starting from them.

The part of the document that is aligned goes as far to both sides as it brings words of the template that it lacks: at most
as many other words as the template has may stand between two of them, and it ends where another copy begins. So inserted
words (margins, comments, clauses) cost neither head nor tail, however many there are in all.

A notice can list the words that name its licence and version. One of the places where the template has them all must be
aligned in full, and no word that names another licence may stand unaligned among them ("GNU Lesser General Public
License" isn't a find of the GPL). A version is the same with and without a v before it.

Of overlapping finds the one with more aligned words stays, then the one that starts first, then the first template.

Edge cases: a null or empty text has no finds; a notice that occurs several times is found each time. Texts of any
length are read once; the work is that of the places with key words. Rows are independent; null and repeated keys and
further columns don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skypairs.llm.words import slices

LEAST = 0.75
SLACK = 4
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(text: str) -> str:
    return text.translate(_CAPITALS)


_CAPITALS = {k: k + 32 for k in range(65, 91)}
_VERSION = re.compile(r"v[0-9]+\Z")


def _plain(word: str) -> str:
    return word[1:] if _VERSION.match(word) else word


def ascending(values: Sequence[int]) -> list[int]:
    """Places of a longest strictly ascending subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, v in enumerate(values):
        at = bisect_left(tails, v)
        tails[at:at + 1], ends[at:at + 1] = [v], [k]
        before.append(ends[at - 1] if at else -1)
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, ascending in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        mine, theirs = _once(a, i, n), _once(b, j, m)
        anchors = [(p, theirs[w]) for w, p in mine.items() if w in theirs]
        anchors.sort()
        kept = [anchors[k] for k in ascending([q for _, q in anchors])]
        out += kept
        if kept:
            bounds = [(i - 1, j - 1), *kept, (n, m)]
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(bounds, bounds[1:])]
    return sorted(out)


def _once(words: Sequence[str], begin: int, end: int) -> dict[str, int]:
    found: dict[str, int] = {}
    for k in range(begin, end):
        found[words[k]] = -1 if words[k] in found else k
    return {w: k for w, k in found.items() if k >= 0}


class Template:
    def __init__(self, number: int, name: str, text: str, least: float, names: str = ""):
        self.number, self.name, self.least = number, name, least
        self.words = [_plain(w) for w in _WORD.findall(_lower(text))]
        self.names = Counter(_plain(w) for w in _WORD.findall(_lower(names)))
        self.mentions = self._mentions()
        if self.names and not self.mentions:
            raise ValueError(f"the text of {name} lacks some of its names: {names}")
        self.others: frozenset[str] = frozenset()
        self.counts = Counter(self.words)
        self.place: dict[str, int] = {}
        for k, w in enumerate(self.words):
            self.place.setdefault(w, k)
        self.keys: set[str] = set()
        covered = 0
        for word in sorted(self.place, key=lambda w: (-len(w), w)):
            self.keys.add(word)
            covered += self.words.count(word)
            if covered > (1 - least) * len(self.words):
                break

    def _mentions(self) -> list[list[int]]:
        """Places of the words that name the licence, for each time that the template has them all."""
        out, places, left = [], [], Counter(self.names)
        for k, w in enumerate(self.words):
            if left[w]:
                left[w] -= 1
                places.append(k)
                if not any(left.values()):
                    out.append(places)
                    places, left = [], Counter(self.names)
        return out

    def _named(self, words: list[str], begin: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether the aligned words name this licence, and no other one."""
        if not self.mentions:
            return True
        to, aligned = {q: begin + p for p, q in pairs}, {begin + p for p, _ in pairs}
        for places in self.mentions:
            if all(q in to for q in places):
                among = range(to[places[0]], to[places[-1]])
                if not any(words[p] in self.others and p not in aligned for p in among):
                    return True
        return False

    def _reach(self, words: list[str], part: range, places: range) -> int:
        """The end (in the order of `places`, which go away from the part) of the words that the part lacks, and of as many
        more as the template has beyond the last of them."""
        lacks = self.counts.keys() - set(words[part.start:part.stop])
        size, step = len(self.words), places.step
        end, gap, new, again = places.start, 0, 0, 0
        for p in places:
            if not lacks or gap > size or again > new + max(SLACK, size // 8):
                break
            gap += 1
            if words[p] in lacks:
                lacks.remove(words[p])
                at = self.place[words[p]]
                end, gap, new = p + step * (1 + SLACK + (size - at if step > 0 else at)), 0, new + 1
            elif self.counts.get(words[p]) == 1:
                again += 1
        return min(end, places.stop) if step > 0 else max(end, places.stop)

    def _finished(self, words: list[str], begin: int, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """With the words that follow the last aligned one in the template and, SLACK words apart at most, in the text:
        the part may end among them."""
        if pairs:
            p, q = begin + pairs[-1][0], pairs[-1][1]
            while q + 1 < len(self.words) and self.words[q + 1] in (after := words[p + 1:p + 2 + SLACK]):
                p, q = p + 1 + after.index(self.words[q + 1]), q + 1
                pairs = [*pairs, (p - begin, q)]
        return pairs

    def _aligned(self, words: list[str], least: int, p: int) -> tuple[int, list[tuple[int, int]]]:
        """The first word of the part around place p, not before `least`, and its alignment."""
        size, start = len(self.words), p - self.place[words[p]]
        if start >= least and words[start:start + size] == self.words:
            return start, [(k, k) for k in range(size)]
        begin = max(least, start - SLACK)
        end = min(len(words), begin + size + size // 4 + 2 * SLACK)
        last = self._reach(words, range(begin, end), range(end, len(words)))
        first = self._reach(words, range(begin, last), range(begin - 1, least - 1, -1)) + 1
        present = set(words[first:last])
        if not self.names.keys() <= present or sum(self.counts[w] for w in present) < self.least * size:
            return begin, []
        near = align(words[begin:end], self.words)
        if len(near) == size or (first, last) == (begin, end):
            return begin, self._finished(words, begin, near)
        far = align(words[first:last], self.words)
        begin, pairs = (first, far) if len(far) > len(near) else (begin, near)
        return begin, self._finished(words, begin, pairs)

    def finds(self, words: list[str], at: list[int]) -> Iterator[tuple[int, int, int]]:
        """First and last word and number of aligned words of each place; at: where the key words are."""
        done, size = 0, len(self.words)
        for p in at:
            if p < done:
                continue
            begin, pairs = self._aligned(words, done, p)
            if pairs and len(pairs) >= self.least * size and self._named(words, begin, pairs):
                first, last = begin + pairs[0][0], begin + pairs[-1][0]
                yield first, last, len(pairs)
                done = last + 1


@lru_cache(maxsize=2)
def _templates(notices: tuple[tuple[str, ...], ...], least: float) -> tuple[list[Template], dict[str, list[Template]], str]:
    made = [Template(k, name, text, least, *names) for k, (name, text, *names) in enumerate(notices)]
    naming = {w for t in made for w in t.names}
    for t in made:
        t.others = frozenset(naming.difference(t.words))
    by_key: dict[str, list[Template]] = {}
    for t in made:
        for w in sorted(t.keys):
            by_key.setdefault(w, []).append(t)
    return made, by_key, "(?i)" + "|".join(map(re.escape, sorted(by_key)))


def found_in(text: str, notices: tuple[tuple[str, ...], ...], least: float = LEAST) -> list[tuple[str, int, int, int, float]]:
    """Name, start and end in the text, aligned words and coverage of each find, by start."""
    _, by_key, _ = _templates(notices, least)
    lower = _lower(text)
    spans = [m.span() for m in _WORD.finditer(lower)]
    words = [_plain(lower[a:b]) for a, b in spans]
    at: dict[int, tuple[Template, list[int]]] = {}
    for k, w in enumerate(words):
        for t in by_key.get(w, ()):
            at.setdefault(t.number, (t, []))[1].append(k)
    finds = [(-n, first, t.number, last, t) for t, places in at.values() for first, last, n in t.finds(words, places)]
    out: list[tuple[str, int, int, int, float]] = []
    starts: list[int] = []
    taken: list[tuple[int, int]] = []
    for n, first, _, last, t in sorted(finds, key=lambda x: x[:4]):
        k = bisect_left(starts, first)
        if (k == len(taken) or taken[k][0] > last) and (not k or taken[k - 1][1] < first):
            starts.insert(k, first)
            taken.insert(k, (first, last))
            out.append((t.name, spans[first][0], spans[last][1], -n, -n / len(t.words)))
    return sorted(out, key=lambda x: x[1])


def scan(docs: DataFrame, notices: list[tuple[str, ...]], key: str = "doc_id", text: str = "text",
         least: float = LEAST) -> DataFrame:
    """A row for each find: key, license, start, end (code points), matched (words), coverage. notices: name, text and,
    where the words that name the licence are needed, these words."""
    fixed = tuple(map(tuple, notices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = _templates(fixed, least)[2]
        for batch in slices(batches, "text"):
            texts = batch.column(1)
            at = np.flatnonzero(pc.match_substring_regex(texts, some).to_numpy(zero_copy_only=False))
            rows = [(k, *f) for k in at.tolist() for f in found_in(texts[k].as_py(), fixed, least)]
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]), *arrays[1:]],
                                             ["key", "license", "start", "end", "matched", "coverage"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return (rows.mapInArrow(run, f"key {kind}, license string, start int, end int, matched int, coverage double")
            .withColumnRenamed("key", key))
