"""Byte-level BPE: texts to token ids and back (operator 1).

A text is cut by the tokenizer's pattern; the bytes of each distinct piece are folded by ranked merges: the
adjacent pair whose joined bytes have the lowest rank merges, the leftmost of equals first, until no pair has a rank.
Decoding concatenates the binary pieces of the ids.

The fold exists twice, with equal results. `folded` is a column expression of higher-order functions over a
literal rank map; it works in any query, without Python. `encode` does the same merges for all new distinct words of a
task at once in numpy, because the column form needs about fifty times as long (figures in the README).

Edge cases: a null or empty text has no ids and decodes to no bytes. Repeated rows, repeated or null keys and
further columns don't matter: rows are independent, and only the key and the result are returned. A text of any
length is one row; a single piece of any length is folded in memory proportional to it.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skypairs.llm.columns import binary_column, binary_rows, flat, tidied
from skypairs.llm.words import Remembered, joined, row_totals, slices

NO_RANK = 2**31 - 1
#: Bytes of text encoded at once, and words (and pieces) remembered.
SLICE = 1 << 20
WORDS = 1 << 17
_BUCKETS = 1 << 16
_BLANK = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Runs of white space that can't be cut at each blank without changing the pieces.
_RUNS = rf"[{_BLANK}] [{_BLANK}]|[{_BLANK}] $"


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """Rank (and id) of each token of a tiktoken rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """The rank map as arrays: ids of bytes, and the merged id of every two tokens whose joined bytes have a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.merged = np.fromiter((pairs[k] for k in self.keys.tolist()), np.int64, len(pairs))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NO_RANK)

    def fold(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        left = []
        for k, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[k] = np.array([rank], np.int32)
            elif len(piece) > 256:
                out[k] = self._fold_long(piece)
            else:
                left.append(k)
        if left:
            sizes = np.fromiter((len(pieces[k]) for k in left), np.int64, len(left))
            ids = self.of_byte[np.frombuffer(b"".join(pieces[k] for k in left), np.uint8)]
            for k, got in zip(left, self._fold_all(ids, sizes), strict=True):
                out[k] = got
        return out

    def _fold_all(self, ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """One merge in each word at a time, until no word has one."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(ids), NO_RANK, np.int64)  # of a token and its right neighbour
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        done_ids, done_word = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(ids)))
            busy = best != NO_RANK
            if not busy.all():
                keep = np.repeat(busy, counts)
                done_ids.append(ids[~keep])
                done_word.append(word[~keep])
                ids, word, rank, best, counts = ids[keep], word[keep], rank[keep], best[busy], counts[busy]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, counts))
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
            ids[hit] = rank[hit]
            stays = np.ones(len(ids), bool)
            stays[hit + 1] = False
            at = hit - np.arange(len(hit))  # each earlier merge has taken one token away
            ids, word, rank = ids[stays], word[stays], rank[stays]
            for pos in (at, at[at > 0] - 1):
                same = pos[(pos + 1 < len(ids))]
                same = same[word[same] == word[same + 1]]
                rank[pos] = NO_RANK
                rank[same] = self._rank(ids[same], ids[same + 1])
        if not done_ids:
            return []
        ids, word = np.concatenate(done_ids).astype(np.int32), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.split(ids[order], np.cumsum(np.bincount(word, minlength=len(sizes)))[:-1])

    def _fold_long(self, piece: bytes) -> np.ndarray:
        """The same for one long piece, with a heap of pairs: n log n steps."""
        import heapq
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        ranks = self._rank(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), k) for k, r in enumerate(ranks.tolist()) if r != NO_RANK]
        heapq.heapify(heap)
        pair = ranks.tolist() + [NO_RANK]
        lookup = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in lookup:
                lookup[a, b] = int(self._rank(np.array([a]), np.array([b]))[0])
            return lookup[a, b]

        while heap:
            r, k = heapq.heappop(heap)
            if pair[k] != r:
                continue
            gone = after[k]
            ids[k], pair[gone], after[k] = r, -1, after[gone]
            if after[k] < n:
                before[after[k]] = k
            for p in (before[k], k):
                if p >= 0:
                    pair[p] = rank(ids[p], ids[after[p]]) if after[p] < n else NO_RANK
                    if pair[p] != NO_RANK:
                        heapq.heappush(heap, (pair[p], p))
        out, k = [], 0
        while k < n:
            out.append(ids[k])
            k = after[k]
        return np.array(out, np.int32)


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(ranks_of(path))


class _Encoder:
    """Ids of whole texts. Cuts at each blank that starts a piece in any text; other texts are matched as a whole."""

    def __init__(self, path: str, pattern: str):
        self.merges, self.pattern = _merges(path), regex.compile(pattern)
        self.pieces = Remembered(lambda pieces: joined(self.merges.fold([p.encode() for p in pieces])), most=WORDS)
        self.inner = Remembered(lambda words: self._ids([" " + w for w in words]), most=WORDS)

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after another, and how many each chunk has."""
        found = [self.pattern.findall(c) for c in chunks]
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        values, lengths = self.pieces(pa.array([p for f in found for p in f], pa.large_string()))
        return values, row_totals(lengths, offsets)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        whole = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
        words, offsets = flat(pc.split_pattern(texts, " "))
        values, lengths = self.inner(words)
        at = np.concatenate([[0], np.cumsum(lengths)])
        heads, head_sizes = self._ids(words.take(pa.array(offsets[:-1])).to_pylist())
        head_at = np.concatenate([[0], np.cumsum(head_sizes)])
        sizes, parts = np.empty(len(texts), np.int64), []
        for k, start in enumerate(offsets[:-1]):
            if whole[k]:
                mine = [self._ids([texts[k].as_py()])[0]]
            else:  # the first word of a text has no blank before it
                mine = [heads[head_at[k]:head_at[k + 1]], values[at[start + 1]:at[offsets[k + 1]]]]
            sizes[k] = sum(map(len, mine))
            parts += mine
        return np.concatenate(parts), sizes

    def column(self, texts: pa.Array) -> pa.Array:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        values, sizes = self(texts)
        return binary_column(values.astype("<u4"), 4 * np.concatenate([[0], np.cumsum(sizes)]))


class _Decoder:
    """Bytes of whole columns of ids."""

    def __init__(self, path: str):
        ranks = ranks_of(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())

    def column(self, ids: pa.Array) -> pa.Array:
        data, offsets = binary_rows(ids)
        got = data.view("<u4") if data.flags.aligned else np.frombuffer(data.tobytes(), "<u4")
        out, at = binary_rows(self.tokens.take(pa.array(got)))
        return binary_column(out, at[offsets // 4])


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text",
           ids: str = "ids") -> DataFrame:
    """The key and the ids of each text as little-endian unsigned 32-bit integers in a binary column.

    ranks: path of a tiktoken rank file, readable on every executor. No special tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(ranks, pattern)
        for batch in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.column(batch.column(1))], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(tidied(run, ranks_of, _merges), f"key {kind}, ids binary").toDF(key, ids)


def decode(encoded: DataFrame, ranks: str, key: str = "doc_id", ids: str = "ids", text: str = "bytes") -> DataFrame:
    """The key and the bytes that the ids stand for, concatenated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _Decoder(ranks)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), decoder.column(part.column(1))], ["key", "bytes"])

    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(tidied(run, ranks_of), f"key {kind}, bytes binary").toDF(key, text)


def round_trip(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", ids: str = "ids",
               decoded: str = "bytes", same: str = "same") -> DataFrame:
    """The key, the ids of each text as `encode` gives them, the bytes that `decode` makes of these ids, and whether these are
    the text's own.

    Both steps run in one Python worker a task, on a slice of the texts at a time: `decode` after `encode` keeps two workers a
    task alive, and sends the ids and all that the key carries to both.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _Encoder(ranks, pattern), _Decoder(ranks)
        for batch in slices(batches, "text", SLICE):
            made = encoder.column(batch.column(1))
            back = decoder.column(made)
            equal = pc.equal(back, batch.column(1).cast(pa.large_binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made, back, equal], ["key", "ids", "bytes", "same"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    types = f"key {kind}, ids binary, bytes binary, same boolean"
    return rows.mapInArrow(tidied(run, ranks_of, _merges), types).toDF(key, ids, decoded, same)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: maps from a token, its bytes read as Latin-1, in an array by the token's checksum."""
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for token, rank in ranks.items():
        name = token.decode("latin-1")
        buckets[zlib.crc32(name.encode()) % _BUCKETS][name] = rank
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(word: Column, ranks: Column) -> Column:
    """Ids of one piece (binary) by higher-order functions over the literal of rank_map; null for null."""
    def rank(piece: Column) -> Column:
        bucket = F.get(ranks, F.pmod(F.crc32(piece), F.lit(_BUCKETS)).cast("int"))
        return F.coalesce(F.try_element_at(bucket, piece), F.lit(NO_RANK))

    def merge(state: Column, _step: Column) -> Column:
        parts, known = state["parts"], state["ranks"]
        none = F.array().cast("array<int>")

        def at(k: Column) -> Column:
            def put(both: Column) -> Column:
                left = F.when(k > 0, F.array(rank(F.concat(F.get(parts, k - 1), both)))).otherwise(none)
                right = F.when(k + 2 < F.size(parts), F.array(rank(F.concat(both, F.get(parts, k + 2))))).otherwise(none)
                return F.struct(
                    F.concat(F.slice(parts, F.lit(1), k), F.array(both), F.slice(parts, k + 3, F.size(parts))).alias("parts"),
                    F.concat(F.slice(known, F.lit(1), F.greatest(k - 1, F.lit(0))), left, right,
                             F.slice(known, k + 3, F.size(known))).alias("ranks"))
            return _let(F.concat(F.get(parts, k), F.get(parts, k + 1)), put)

        low = F.array_min(known)
        return (F.when(F.coalesce(low, F.lit(NO_RANK)) == NO_RANK, state)
                .otherwise(_let((F.array_position(known, low) - 1).cast("int"), at)))

    letters = F.split(F.decode(word, "ISO-8859-1"), "")
    start = _let(letters, lambda p: F.struct(
        p.alias("parts"),
        F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), lambda a, b: rank(F.concat(a, b))).alias("ranks")))
    ids = F.aggregate(F.sequence(F.lit(1), F.size(letters)), start, merge, lambda s: F.transform(s["parts"], rank))
    return F.when(F.octet_length(word) == 0, F.array().cast("array<int>")).otherwise(ids)
