"""Near-copies by DartMinHash signatures and a banded join (operator 10).

A document is the multiset of its runs of five words; two documents are linked if the weighted Jaccard similarity of
their multisets is at least 0.8, and a class is a connected component of links.

1. Documents with equal multisets are merged; the smallest key stands for them.
2. Each gets a DartMinHash signature of 25 bands of 5 coordinates. Documents that agree in a band share a bucket; a
   pair at 0.8 shares none with probability 5e-5.
3. Each member of a bucket is compared with the smallest one. Signatures rule out pairs that agree in fewer than 80 of
   125 coordinates (at 0.8, a chance of 4e-6); all others are decided exactly from their shingles.
4. Members that are not yet in the component of the smallest one are compared with all others of the bucket, first
   with the likeliest of each block, then, where still apart, with all. So no link that could join two classes is
   left out, while the many pairs inside a class are neither compared nor written. Pairs are ruled out by sketches of
   the shingles' smallest hashes in each of 1,024 bins, 4.5 standard deviations below 0.8 (a chance of 4e-6).

Buckets are split into blocks of about BLOCK bytes, and pairs of blocks are compared where they meet: no task holds a
whole bucket, and only links are written. Nothing but counts reaches the
driver. Shingles are compared as 32-bit hashes with the occurrence number mixed in: a pair of documents of 1,000 words
has a chance of 2e-4 that its similarity is off by 0.001.

Edge cases: a document of one to four words has its words as the one run. Null texts and texts without words are
linked to nothing, not even to each other. Repeated rows are copies; keys may repeat with other texts. Rows with a
null key take part, but a class is null only if it has no other key. Further columns don't matter. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skypairs.llm.columns import binary_column, binary_rows, flat, fresh, ranges, written
from skypairs.llm.components import components
from skypairs.llm.dart import mix, signatures
from skypairs.llm.shingles import counted, shingled, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
AGREE = 80
BINS, DEVIATIONS = 1024, 4.5
BLOCK = 1 << 20
NO_KEY = 2**63 - 1


def _parts(batches: Iterator[pa.RecordBatch], values: int) -> Iterator[pa.RecordBatch]:
    """Rows in runs that hold about so many list values in the second column."""
    for batch in batches:
        begin = 0
        ends = flat(batch.column(1))[1][1:]
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + values, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _digests(elements: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Equal for equal multisets only (128 bits)."""
    both = mix(elements + counts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return [hashlib.blake2b(both[e - s:e].tobytes(), digest_size=16).digest()
            for s, e in zip(sizes, np.cumsum(sizes), strict=True)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches, 100_000):
        hashes, offsets = flat(batch.column(1))
        runs, row = shingled(hashes.to_numpy(), offsets, WORDS)
        elements, weights, row = counted(runs, row)
        some, sizes = np.unique(row, return_counts=True)
        found = signatures(elements, weights.astype(float), sizes, BANDS * ROWS)
        bands = np.zeros((len(some), BANDS), np.uint64)
        for k in range(ROWS):
            bands = mix(bands + found[:, k::ROWS])
        bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64))
        same = _digests(elements, weights, sizes)
        short = np.ascontiguousarray((found & np.uint64(255)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(some)), pa.array(same, pa.binary()),
             binary_column(short.reshape(-1), np.arange(len(some) + 1) * BANDS * ROWS),
             pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS),
                                      pa.array(bands.reshape(-1).view(np.int64)))],
            ["row", "same", "signature", "bands"])


def _bins(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """A byte for each bin and row: of the smallest hash there, 0 for none."""
    hashes = mix(values + np.uint64(0x9E3779B97F4A7C15))
    slot = row * BINS + (hashes >> np.uint64(54)).astype(np.int64)
    least = np.full(rows * BINS, np.uint64(2**64 - 1))
    np.minimum.at(least, slot, hashes & np.uint64(2**54 - 1))
    found = np.where(least == np.uint64(2**64 - 1), np.uint64(0), least % np.uint64(255) + np.uint64(1))
    return found.astype(np.uint8).reshape(rows, BINS)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches, 500_000):
        hashes, offsets = flat(batch.column(1))
        values, counts, row = counted(*shingled(hashes.to_numpy(), offsets, WORDS))
        same = _digests(values, counts, np.unique(row, return_counts=True)[1])
        number = ranges(np.zeros(len(values), np.int64), counts)
        some, row = np.unique(np.repeat(row, counts), return_inverse=True)
        values = mix(np.repeat(values, counts) + number.astype(np.uint64))
        sketch = _bins(values, row, len(some))
        values = values.astype(np.uint32)
        values = values[np.lexsort((values, row))]
        sizes = np.bincount(row, minlength=len(some))
        yield pa.RecordBatch.from_arrays(
            [pa.array(same, pa.binary()), binary_column(values, 4 * np.concatenate([[0], np.cumsum(sizes)])),
             binary_column(sketch.reshape(-1), np.arange(len(some) + 1) * BINS)], ["same", "elements", "sketch"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (binary_rows(batch.column(k))[0].reshape(batch.num_rows, -1) for k in (2, 3))
        near = pa.array((left == right).sum(axis=1) >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(near) for k in (0, 1)], ["a", "b"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (left, lo), (right, ro) = (binary_rows(batch.column(k)) for k in (2, 3))
        left, right = np.frombuffer(left.tobytes(), np.uint32), np.frombuffer(right.tobytes(), np.uint32)
        linked = []
        for k in range(batch.num_rows):
            a, b = left[lo[k] // 4:lo[k + 1] // 4], right[ro[k] // 4:ro[k + 1] // 4]
            linked.append(bool(_enough(_shared(a, b, np.array([0, len(b)])), np.array([len(a) + len(b)]))[0]))
        keep = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])


def _shared(one: np.ndarray, flat_others: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many elements each of the others has in common with one (sorted)."""
    at = np.minimum(np.searchsorted(one, flat_others), len(one) - 1)
    total = np.concatenate([[0], np.cumsum(one[at] == flat_others)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _across(every: bool):
    """Links between a chunk of stray members and a block of members of the same bucket, of different components: of
    each stray with the likeliest of the block, or with all."""
    def side(rows: pa.StructArray) -> tuple[np.ndarray, ...]:
        sketch, _ = binary_rows(rows.field("sketch"))
        elements, offsets = binary_rows(rows.field("elements"))
        return (rows.field("key").to_numpy(), rows.field("label").to_numpy(), sketch.reshape(len(rows), BINS),
                np.frombuffer(elements.tobytes(), np.uint32), offsets // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k in range(batch.num_rows):
                key, label, sketch, elements, starts = side(batch.column(0)[k].values)
                others, labels, them, their, offsets = side(batch.column(1)[k].values)
                sizes = np.diff(offsets)
                for n, mine in enumerate(sketch):
                    used = np.maximum(((them > 0) | (mine > 0)).sum(axis=1), 1)
                    agree = ((them == mine) & (mine > 0)).sum(axis=1)
                    spread = np.sqrt(SIMILARITY * (1 - SIMILARITY) * used)
                    near = np.flatnonzero((agree >= SIMILARITY * used - DEVIATIONS * spread) & (labels != label[n]))
                    if not len(near):
                        continue
                    if not every:
                        near = near[[np.argmax(agree[near] / used[near])]]
                    own = elements[starts[n]:starts[n + 1]]
                    common = _shared(own, their[ranges(offsets[near], sizes[near])], np.concatenate([[0], np.cumsum(sizes[near])]))
                    near = near[_enough(common, len(own) + sizes[near])]
                    out_a.append(np.minimum(key[n], others[near]))
                    out_b.append(np.maximum(key[n], others[near]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b)], ["a", "b"])
    return run


def _enough(common: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether so many common elements of so many in both sets make the similarity."""
    return common >= SIMILARITY * (sizes - common) * (1 - 1e-12)


def _classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with words (key, mark, same, id), those without (key, mark), and of each multiset (same) its smallest key
    (least), the key of its class (class_id), and whether it stands for the class (chosen)."""
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.col(text).alias("text"))
    rows = texts.select("key", F.xxhash64("text").alias("mark"), word_hashes(F.col("text")).alias("words"))
    sketches = written(rows.select(F.struct("key", "mark").alias("row"), "words")
                       .mapInArrow(_sketches, "row struct<key:long,mark:long>, same binary, signature binary, bands array<long>")
                       .select("row.*", "same", "signature", "bands", F.monotonically_increasing_id().alias("id")))
    # one row of each multiset stands for it; ids are used within, since keys can repeat
    first = written(sketches.groupBy("same").agg(F.min("id").alias("id"), F.min("key").alias("least")))
    reps = sketches.join(first.select("id"), "id").select("id", "signature", "bands")
    reps = written(reps.withColumnRenamed("id", "key"))
    banded = reps.select("key", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("key").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    members = written(banded.join(buckets, "bucket"))
    signature = reps.select("key", "signature")

    shared = first.join(members.select(F.col("key").alias("id")).distinct(), "id", "left_semi")
    # sort-merge joins at every size: both sides grow with the table, and texts go before their hashes are made
    elements = written(texts.join(shared.select(F.col("least").alias("key")).hint("merge"), "key", "left_semi")
                       .select("key", word_hashes(F.col("text")).alias("words")).mapInArrow(_elements, "same binary, elements binary, sketch binary")
                       .join(shared.hint("merge"), "same").dropDuplicates(["id"])
                       .select(F.col("id").alias("key"), "elements", "sketch"))

    def side(table: DataFrame, name: str, value: str) -> DataFrame:
        return table.select(F.col("key").alias(name), F.col(value).alias(f"{name}_{value}"))

    def with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        return (pairs.join(side(table, "b", value).hint("merge"), "b").join(side(table, "a", value).hint("merge"), "a")
                .select("a", "b", f"a_{value}", f"b_{value}"))

    pairs = members.filter("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    likely = with_both(pairs, signature, "signature").mapInArrow(_agreeing, "a long, b long")
    links = written(with_both(likely, elements, "elements").mapInArrow(_similar, "a long, b long"))
    for every in (False, True):
        links = links.union(written(_stray_links(members, elements, components(links), every)))
    labels = components(links)

    label = first.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    names = label.groupBy("label").agg(F.min(F.struct("least", "id")).alias("name"))
    multisets = label.join(names, "label").select("same", "least", F.col("name.least").alias("class_id"),
                                                  (F.col("id") == F.col("name.id")).alias("chosen"))
    without = rows.filter(F.size("words") == 0).select("key", "mark")
    return sketches.select("key", "mark", "same", "id"), without, multisets


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its key and class_id (long), the smallest key of its class."""
    rows, without, multisets = _classes(docs, key, text)
    classes = rows.join(multisets, "same").select("key", "class_id").union(without.select("key", F.col("key").alias("class_id")))
    known = lambda c: F.when(F.col(c) != NO_KEY, F.col(c))
    return classes.select(known("key").alias(key), known("class_id").alias("class_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stand for their classes, as they are; of rows with equal key and text, one."""
    names = fresh(docs.columns, 2)
    all_rows, without, multisets = _classes(docs, key, text)
    chosen = multisets.filter("chosen").select("same", F.col("least").alias("key"))
    # rows of one key and multiset can still differ in letter case or punctuation; one of them stays
    one = all_rows.join(chosen.hint("merge"), ["same", "key"]).groupBy("same").agg(F.min(F.struct("key", "mark")).alias("row"))
    stay = one.select("row.*").union(without).toDF(*names)
    rows = docs.withColumn(names[0], F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))).withColumn(names[1], F.xxhash64(text))
    return rows.join(stay.hint("merge"), names, "left_semi").dropDuplicates(names).drop(*names)


def _stray_links(members: DataFrame, elements: DataFrame, labels: DataFrame, every: bool) -> DataFrame:
    """Links (a, b) of members that aren't in the component of the first of their bucket, with others of the bucket."""
    label = labels.withColumnRenamed("node", "key")
    size = elements.select("key", (F.octet_length("elements") + BINS).alias("size"))
    of = (members.filter("n > 2").join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
          .join(labels.select(F.col("node").alias("leader"), F.col("label").alias("main")), "leader", "left")
          .withColumn("stray", F.col("label") != F.coalesce("main", "leader")).join(size, "key"))
    total = of.groupBy("bucket").agg(F.sum("size").alias("all_bytes"), F.sum(F.when(F.col("stray"), F.col("size"))).alias("stray_bytes"))
    of = written(of.select("key", "bucket", "label", "stray").join(total.filter("stray_bytes > 0"), "bucket"))
    part = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.ceil(F.col(n) / BLOCK))
    chunked = of.filter("stray").withColumn("part", part("stray_bytes", 1))
    blocked = of.withColumn("part", part("all_bytes", 2))

    def packed(rows: DataFrame, name: str) -> DataFrame:
        return (rows.select("key", "bucket", "label", "part").join(elements, "key").groupBy("bucket", "part")
                .agg(F.collect_list(F.struct("key", "label", "sketch", "elements")).alias(name)).drop("part"))

    both = packed(chunked, "left").join(packed(blocked, "right"), "bucket")
    return both.select("left", "right").mapInArrow(_across(every), "a long, b long").distinct()
