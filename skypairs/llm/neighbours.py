"""Approximate nearest neighbours by cross-polytope hashing (operator 4).

Equal vectors are merged first, with the smallest ids of each. Vectors are lifted to the unit sphere by inverse
stereographic projection (scaled by the root mean square of their lengths), so that near vectors of any length become near
unit vectors. In each table, three rounds of random signs and a fast Hadamard transform turn a unit vector
pseudo-randomly, and the nearest of the signed axes is its bucket. A query probes the buckets of its nearest axes in each
table; the vectors found there are ranked by their exact distance to it on the original vectors, in double precision.

Buckets are packed into blocks of at most about BLOCK vectors, and a block of candidates meets a block of queries
in one row, so a crowded bucket is shared by many tasks; a block hands on only the nearest of its vectors to each query.
Queries that find too few candidates are compared with all vectors, block by block.

Recall of the ten nearest with 8 tables and a quarter of the axes probed: see the README. `rotations` of one hash
can be concatenated for finer buckets on larger tables, with more tables or probes for the same recall.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a
null id. Vectors are compared only with those of the same length. Repeated rows (equal id and vector) count once. An
id with several vectors is as near as its nearest one, and asks with each; it has one rank, among the k + 1 nearest vectors.
Queries with fewer other vectors than k have them all. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skypairs.llm.columns import written

TABLES, SHARE, ROTATIONS, BLOCK = 8, 0.25, 1, 512
_SALTS = 64


def _turn(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform; the width is a power of two."""
    n = x.shape[1]
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], n)
        half = 1
        while half < n:
            y = x.reshape(len(x), -1, 2, half)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
            half *= 2
        x = x / np.sqrt(n)
    return x


def _lifted(x: np.ndarray, scale: float) -> np.ndarray:
    x = x / scale
    square = (x * x).sum(axis=1, keepdims=True)
    y = np.concatenate([2 * x, square - 1], axis=1) / (square + 1)
    return np.pad(y, ((0, 0), (0, (1 << (y.shape[1] - 1).bit_length()) - y.shape[1])))


def buckets(x: np.ndarray, scale: float, tables: int, rotations: int, share: float | None) -> Iterator[np.ndarray]:
    """For each table the bucket of each vector or, with a share, the buckets it probes (one column each)."""
    y = _lifted(x, scale)
    for table in range(tables):
        code = np.zeros((len(x), 1), np.int64)
        for r in range(rotations):
            turned = _turn(y, np.random.default_rng((table, r, y.shape[1])))
            signed = np.concatenate([turned, -turned], axis=1)
            probes = 1 if share is None else max(1, int(share * signed.shape[1]))
            axes = np.argmax(signed, axis=1)[:, None] if probes == 1 else np.argpartition(-signed, probes - 1, axis=1)[:, :probes]
            code = (code[:, :, None] * signed.shape[1] + axes[:, None, :]).reshape(len(x), -1)
        yield code


def _hashed(scale: float, tables: int, rotations: int, share: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).cast(pa.list_(pa.float64()))
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes):
                rows = pa.array(np.flatnonzero(sizes == size))
                part, ids = lists.take(rows), batch.column(0).take(rows)
                x = part.values.to_numpy().reshape(len(rows), size)
                for table, code in enumerate(buckets(x, scale, tables, rotations, share)):
                    name = (code * tables + table) * 4096 + int(size) % 4096
                    probes = code.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name.reshape(-1)), ids.take(pa.array(np.repeat(np.arange(len(rows)), probes)))], ["bucket", "vid"])
    return run


def _nearest(k: int):
    """Of each pair of blocks: the k nearest vectors of the right one to each of the left one."""
    def side(rows: pa.StructArray) -> tuple[np.ndarray, list[np.ndarray]]:
        vectors = rows.field("vector").cast(pa.list_(pa.float64()))
        return rows.field("vid").to_numpy(), np.split(vectors.values.to_numpy()[vectors.offsets[0].as_py():vectors.offsets[-1].as_py()],
                                                      vectors.offsets.to_numpy()[1:-1] - vectors.offsets[0].as_py())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
            for n in range(batch.num_rows):
                (ids, queries), (others, vectors) = side(batch.column(0)[n].values), side(batch.column(1)[n].values)
                for one, q in zip(ids, queries, strict=True):
                    same = np.array([len(v) == len(q) for v in vectors])
                    them = others[same]
                    if not len(them):
                        continue
                    x = np.stack([v for v, s in zip(vectors, same, strict=True) if s]) if not same.all() else np.stack(vectors)
                    far = np.sqrt(((x - q) ** 2).sum(axis=1))
                    best = np.lexsort((them, far))[:k]
                    out[0].append(np.full(len(best), one))
                    out[1].append(them[best])
                    out[2].append(far[best])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query", "vid", "score"])
    return run


def _packed(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.collect_list(F.struct("vid", "vector")).alias(name))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
            tables: int = TABLES, share: float = SHARE, rotations: int = ROTATIONS, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), the key and score (Euclidean distance) of the k nearest found of each query, not itself.

    queries: the ids (a column named as the key) of rows of the vectors.
    """
    x = F.col("vector")
    good = (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & good).select("id", F.transform("vector", lambda v: v + F.lit(0.0)).alias("vector"))

    # equal vectors: the k + 1 smallest ids, first of each of a number of salted parts, then of all
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)))
    first = Window.partitionBy("vector", "salt").orderBy("id")
    few = salted.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    # an id can have several vectors, so each distinct vector has a number of its own, in the order of the smallest id
    distinct = (few.groupBy("vector").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
                .withColumn("least", F.get("ids", F.lit(0))))
    distinct = written(distinct.repartitionByRange("least", "vector").sortWithinPartitions("least", "vector")
                       .select(F.monotonically_increasing_id().alias("vid"), "vector", "ids"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)
    scale, count = distinct.agg(F.sqrt(F.avg(square)), F.count("*")).first()
    named = written(rows.join(queries.select(F.col(key).cast("long").alias("id")), "id", "left_semi").distinct()
                    .join(distinct.select("vid", "vector"), "vector").select("id", "vid"))
    asked = distinct.join(named.select("vid").distinct(), "vid", "left_semi").select("vid", "vector")

    def part(seed: int, n: Column) -> Column:
        return F.pmod(F.xxhash64("vid", F.lit(seed)), n)

    def blocks(hashes: DataFrame, table: DataFrame, name: str, seed: int) -> DataFrame:
        sizes = hashes.groupBy("bucket").agg(F.ceil(F.count("*") / block).alias("parts"))
        split = hashes.join(sizes, "bucket").withColumn("part", part(seed, F.col("parts"))).drop("parts")
        return _packed(split.join(table, "vid"), ["bucket", "part"], name).drop("part")

    index = written(distinct.select("vid", "vector").mapInArrow(_hashed(scale or 1.0, tables, rotations, None), "bucket long, vid long"))
    probes = written(asked.mapInArrow(_hashed(scale or 1.0, tables, rotations, share), "bucket long, vid long"))
    pairs = blocks(probes, asked, "left", 1).join(blocks(index, distinct.select("vid", "vector"), "right", 2), "bucket")
    best = Window.partitionBy("query").orderBy("score", "vid")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")

    kind = "query long, vid long, score double"
    found = written(top(pairs.select("left", "right").mapInArrow(_nearest(k + 1), kind).distinct()))

    # all vectors, block by block, for those that have met too few
    enough = found.groupBy("query").agg(F.count("*").alias("met")).filter(F.col("met") > k)
    short = written(asked.join(enough.select(F.col("query").alias("vid")), "vid", "left_anti"))
    if short.limit(1).count() and count:
        parts = -(-count // block)
        every = _packed(distinct.select("vid", "vector").withColumn("part", part(3, F.lit(parts))), ["part"], "right")
        these = _packed(short.withColumn("chunk", part(4, F.lit(-(-short.count() // block)))), ["chunk"], "left")
        these = these.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        exact = these.join(every, "part").select("left", "right").mapInArrow(_nearest(k + 1), kind)
        found = found.join(short.select(F.col("vid").alias("query")), "query", "left_anti").union(top(exact))

    each = found.join(distinct.select("vid", F.explode("ids").alias("other")), "vid")
    ahead = Window.partitionBy("query").orderBy("score", "other")
    each = each.withColumn("n", F.row_number().over(ahead)).filter(F.col("n") <= k + 1).drop("n", "vid")
    out = (named.join(each, named["vid"] == each["query"]).filter("id <> other")
           .groupBy("id", "other").agg(F.min("score").alias("score")))
    last = Window.partitionBy("id").orderBy("score", "other")
    return (out.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
            .select(F.col("id").alias("query_id"), "rank", F.col("other").alias(key), "score"))
