"""Quality scores by histogram gradient-boosted trees over statistics of the text (operator 6).

The statistics are shares and averages of characters, words and lines, computed by numpy for batches of texts. The
trees are grown by the driver on a sample of at most `rows` labelled documents (those whose keys hash lowest), whose
features are computed by Spark: each feature is cut into at most 64 bins at its quantiles, and a split is the best
gain between two bins from sums of first and second derivatives of the logistic loss. Trees have a fixed depth, so
all of them lie flattened in two arrays, and a batch of documents walks down every tree with one lookup a level.

Edge cases: a null or empty text has the statistics of no characters, and a score. Labels that are null are left out,
repeated labels of a key count by their mean (a tie is good). Without labels of both kinds every score is the share of
good labels, or 0.5. Rows are independent; null and repeated keys are scored; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skypairs.llm.columns import binary_rows, flat, tidied
from skypairs.llm.words import slices

SAMPLE, BINS, TREES, DEPTH, RATE, LEAST, RIDGE = 20_000, 64, 80, 4, 0.15, 20, 1.0

#: Classes of bytes: other control, letter, capital, digit, blank, line feed, stop or comma, mark, other mark, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _kind, _bytes in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r",
                                b".,", b"!?;:'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", range(128, 256)], 1):
    _CLASS[list(_bytes)] = _kind
_KINDS = 10


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _pieces(lists: pa.Array) -> list[np.ndarray]:
    """Of the pieces of each row: number, mean length, spread and largest length, share that is distinct."""
    values, offsets = flat(lists)
    n, rows = np.diff(offsets), len(lists)
    length = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.float64)
    some = np.maximum(n, 1)
    mean = _per_row(length, offsets) / some
    spread = np.sqrt(np.maximum(_per_row(length * length, offsets) / some - mean * mean, 0))
    row = np.repeat(np.arange(rows), n)
    largest = np.zeros(rows)
    np.maximum.at(largest, row, length)
    code = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = np.bincount(np.unique(row * (int(code.max(initial=0)) + 1) + code) // (int(code.max(initial=0)) + 1), minlength=rows)
    return [np.log1p(n), mean, spread, np.log1p(largest), distinct / some]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of features for each text (large_string, without nulls)."""
    data, offsets = binary_rows(texts)
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    kind = _CLASS[data]
    out = [np.log1p(size), *(_per_row(kind == k, offsets) / some for k in range(_KINDS))]
    twice = np.zeros(len(data), bool)
    twice[1:] = (data[1:] == data[:-1]) & (kind[1:] >= 6) & (kind[1:] <= 8)
    joined = np.zeros(len(data), bool)  # a mark between a letter and a blank
    joined[1:-1] = (kind[1:-1] == 8) & (kind[:-2] != 4) & (kind[2:] == 4)
    out += [_per_row(twice, offsets) / some, _per_row(joined, offsets) / some]
    out += _pieces(pc.ascii_split_whitespace(texts)) + _pieces(pc.split_pattern(texts, "\n"))
    return np.stack(out, axis=1)


N_FEATURES = 1 + _KINDS + 2 + 10


class Trees:
    """Boosted trees of one depth. Node m of a level has the children 2m+1 and 2m+2; a leaf's value stands at its place."""

    def __init__(self, start: float, features: np.ndarray, cuts: np.ndarray, leaves: np.ndarray):
        self.start, self.features, self.cuts, self.leaves = start, features, cuts, leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Fit to features and labels of 0 and 1."""
    inner, width = 2**DEPTH - 1, x.shape[1] if x.ndim == 2 else N_FEATURES
    share = (y.sum() + 1e-9) / (len(y) + 2e-9) if len(y) else 0.5
    start = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    none = Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y) or y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    slot = binned + np.arange(width) * BINS
    total = np.full(len(y), start)
    features, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        first, second = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            base, nodes = 2**level - 1, 2**level
            at = ((node - base)[:, None] * (width * BINS) + slot).reshape(-1)
            g, h, n = (np.bincount(at, np.repeat(w, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2)
                       for w in (first, second, np.ones(len(y))))
            gain = _gain(g, h) + _gain(g[:, :, -1:] - g, h[:, :, -1:] - h) - _gain(g[:, :, -1:], h[:, :, -1:])
            gain[(n < LEAST) | (n[:, :, -1:] - n < LEAST)] = -1
            gain = gain.reshape(nodes, -1)
            best = gain.argmax(axis=1)
            for m in np.flatnonzero(gain[np.arange(nodes), best] > 1e-9):
                f, b = divmod(int(best[m]), BINS)
                if b < len(edges[f]):
                    feature[base + m], cut[base + m] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = np.bincount(node - inner, first, inner + 1) / (np.bincount(node - inner, second, inner + 1) + RIDGE) * RATE
        total += leaf[node - inner]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(start, np.array(features), np.array(cuts), np.array(leaves))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _with(docs: DataFrame, key: str, text: str, make, columns: list[str], types: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), *make(batch.column(1))], ["key", *columns])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(tidied(run), f"key {kind}, {types}").withColumnRenamed("key", key)


def held_out(key: Column) -> Column:
    """Rows that are never learnt from: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = SAMPLE) -> Trees:
    """Trees from at most `rows` labelled documents outside the held-out third."""
    known = (labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
             .groupBy(key).agg((F.avg(label) >= 0.5).cast("double").alias("good"))
             .orderBy(F.xxhash64(key), key).limit(rows))
    # of rows with one key that with the least hash, then the least text
    sample = (docs.select(key, text).join(F.broadcast(known.select(key)), key)
              .groupBy(key).agg(F.min(F.struct(F.xxhash64(text).alias("hash"), F.col(text).alias("text"))).alias("row"))
              .select(key, F.col("row.text").alias(text)))

    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(list(statistics(texts)), pa.list_(pa.float64()))]

    got = (_with(sample, key, text, make, ["x"], "x array<double>").join(F.broadcast(known), key)
           .orderBy(key).toPandas())
    return grow(np.array(got["x"].tolist(), float).reshape(len(got), N_FEATURES), got["good"].to_numpy(float))


def scored(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1, higher: likelier good) of each text."""
    return _with(docs, key, text, lambda texts: [pa.array(trees.score(statistics(texts)))], ["score"], "score double")


def kept(docs: DataFrame, trees: Trees, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose text scores at least that much, as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(iter([pa.RecordBatch.from_arrays([batch.column(at), pa.array(np.arange(batch.num_rows))], ["text", "row"])]), "text"):
                good = trees.score(statistics(part.column(0))) >= least
                yield batch.take(part.column(1).filter(pa.array(good)))

    return docs.mapInArrow(tidied(run), docs.schema)
