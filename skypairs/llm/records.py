"""Token ids as length-delimited binary records, with an offset index for shuffled reads (operator 7).

A record file is a run of frames: payload length (unsigned 64-bit), masked checksum of those eight bytes (unsigned
32-bit), payload, masked checksum of the payload, one line feed. Payload: key (signed 64-bit), then the ids (unsigned
16-bit if every id of the vocabulary fits, else 32-bit). All numbers are little-endian. The checksum is CRC-32,
rotated right by 15 bits plus 0xa282ead8. Files are named shard=N/...; N and, within a file, the records ascend by
key. The index is a Parquet table: shard, record, key, offset, length (of the frame), n_tokens, ids_crc32.

Frames are written by Spark's own text writer (a row per frame, a line feed after it), so commits, retries of lost
tasks and the choice of file system are Spark's. Files are read back by the binaryFile source.

Edge cases: a null text is an empty one and still gets the end id. A null key is stored as the smallest 64-bit
integer and comes first; rows with equal keys are all kept, ordered by their frames. An empty table gives no file and
an empty index. Further columns don't matter.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from skypairs.llm.columns import flat, ranges, shared_folder, tidied
from skypairs.llm.words import Remembered, joined, slices

NULL_KEY = -2**63
SHARD_BYTES = 32 << 20
INDEX = "shard int, record long, key long, offset long, length long, n_tokens long, ids_crc32 long"
#: Between a precomposed Latin letter and ASCII punctuation or a digit the tokenizer's pattern always parts, so a blank
#: put there changes no id. The apostrophe is left alone, since it begins the contractions.
_PART = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~0-9])"
#: Words that are one piece of the pattern whatever stands around them.
_LETTERS = re.compile(r"[a-zà-öø-ÿ]+")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record without its line feed."""
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and payload of each record of a file; ValueError where a checksum doesn't match."""
    at = 0
    while at < len(data):
        size, head = struct.unpack_from("<QI", data, at)
        payload = data[at + 12:at + 12 + size]
        if (head != masked(data[at:at + 8]) or len(payload) < size
                or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload)):
            raise ValueError(f"damaged record at byte {at}")
        yield at, size + 17, payload
        at += size + 17


class _Words:
    """Ids of words without blanks by the tokenizers library; words of letters only go there in one call."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [(t.content, t.normalized) for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [k for k, w in enumerate(words) if _LETTERS.fullmatch(w)]
        others = sorted(set(range(len(words))).difference(plain))
        lengths = np.empty(len(words), np.int64)
        values = []
        for part in _chunks(plain):
            got = self.tokenizer.encode(" ".join([words[k] for k in part]), add_special_tokens=False)
            lengths[part] = np.bincount(np.array(got.word_ids, np.int64), minlength=len(part))
            values.append(np.array(got.ids, np.int32))
        for part in _chunks(others):
            got = self.tokenizer.encode_batch_fast([words[k] for k in part], add_special_tokens=False)
            some, lengths[part] = joined([np.array(e.ids, np.int32) for e in got])
            values.append(some)
        order = np.array(plain + others, np.int64)
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate([np.empty(0, np.int32), *values])[ranges(starts, lengths)], lengths


def _chunks(places: list[int], size: int = 1024) -> Iterator[list[int]]:
    """So many at a time: what the library keeps of a call is many times its text."""
    return (places[k:k + size] for k in range(0, len(places), size))


def _units(texts: pa.Array) -> pa.Array:
    """Lists of words, A-Z lower-cased as the tokenizer does, with letters parted from punctuation; many are empty."""
    texts = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
    return pc.split_pattern(pc.replace_substring_regex(texts, _PART, r"\1 \2"), " ")


@lru_cache(maxsize=2)
def _remembered(path: str) -> tuple[Remembered, type]:
    words = _Words(path)
    return Remembered(words), "<u2" if words.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _shards(docs: DataFrame, key: str, text: str, shard_bytes: int) -> list[int]:
    """Keys that part the table into shards of about that much text, from counts over all rows."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)))).first()[0] or 0
    n = -(-total // shard_bytes)
    if n < 2:
        return []
    parts = [k / n for k in range(1, n)]
    return docs.agg(F.percentile_approx(key, parts, max(10_000, 20 * n))).first()[0] or []


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text",
          shard_bytes: int = SHARD_BYTES) -> None:
    """Encode each text, append the end id, and write all records in ascending key order. tokenizer: path of a
    tokenizer file of the tokenizers library, readable on every executor."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"), F.col(text).alias("text"))
    bounds = np.array(sorted(set(_shards(rows, "key", "text", shard_bytes))), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered, dtype = _remembered(tokenizer)
        for batch in slices(batches, "text"):
            keys = batch.column(0).to_numpy()
            words, offsets = flat(_units(batch.column(1)))
            values, lengths = remembered(words)
            at = np.concatenate([[0], np.cumsum(lengths)])[offsets]
            whole = {}  # texts with the string of an added token, which the library takes before it cuts into words
            odd = np.zeros(batch.num_rows, bool)
            for content, normalized in remembered.work.added:
                odd |= pc.match_substring(batch.column(1), content, ignore_case=normalized).to_numpy(zero_copy_only=False)
            for row in np.flatnonzero(odd).tolist():
                got = remembered.work.tokenizer.encode(batch.column(1)[row].as_py(), add_special_tokens=False)
                whole[row] = np.array([*got.ids, end], dtype).tobytes()
            values, tail = values.astype(dtype), np.array([end], dtype).tobytes()
            out = [frame(k.tobytes() + (whole.get(row) or values[a:b].tobytes() + tail))
                   for row, (k, a, b) in enumerate(zip(keys.astype("<i8"), at[:-1], at[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(bounds, keys).astype(np.int32)), batch.column(0), pa.array(out, pa.binary())],
                ["shard", "key", "frame"])

    made = rows.mapInArrow(tidied(run), "shard int, key long, frame binary")
    files = len(bounds) + 1
    (made.repartition(files, "shard").sortWithinPartitions("shard", "key", "frame")
     .select("shard", F.col("frame").cast("string").alias("value"))
     .write.partitionBy("shard").option("lineSep", "\n").text(f"{folder}/records"))
    index = scan(spark, folder, tokenizer)
    index.write.parquet(f"{folder}/index")


def scan(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """The index, from the record files themselves; all checksums are tested."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dtype = _remembered(tokenizer)
        size = np.dtype(dtype).itemsize
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out: list[tuple] = []
                for n, (at, length, payload) in enumerate(frames(content.as_py())):
                    ids = np.frombuffer(payload, dtype, offset=8)
                    out.append((shard, n, int.from_bytes(payload[:8], "little", signed=True), at, length,
                                (len(payload) - 8) // size, zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), *[pa.int64()] * 6])],
                    ["shard", "record", "key", "offset", "length", "n_tokens", "ids_crc32"])

    try:
        files = spark.read.format("binaryFile").load(f"{folder}/records")
    except Exception as error:
        if "UNABLE_TO_INFER_SCHEMA" not in str(error) and "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], INDEX)
    if "shard" not in files.columns:  # an empty table leaves a folder without shards
        return spark.createDataFrame([], INDEX)
    return files.select("shard", "content").mapInArrow(run, INDEX)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def starts(index: DataFrame) -> DataFrame:
    """The index with `start`, the number of ids of all records before each. One row a shard is summed in one task."""
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("all_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("all_tokens").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    return (index.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
            .join(shards, "shard").withColumn("start", F.col("shard_start") + F.col("within"))
            .drop("within", "shard_start"))


def read(spark: SparkSession, folder: str, wanted: DataFrame, tokenizer: str) -> DataFrame:
    """key and ids (array<int>) of the records that rows of the index name, in any choice and order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dtype = _remembered(tokenizer)
        for batch in batches:
            for content, at in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                got = [next(frames(bytes(data[x["offset"]:x["offset"] + x["length"]])))[2] for x in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int.from_bytes(p[:8], "little", signed=True) for p in got], pa.int64()),
                     pa.array([np.frombuffer(p, dtype, offset=8).astype(np.int32) for p in got], pa.list_(pa.int32()))],
                    ["key", "ids"])

    at = wanted.groupBy("shard").agg(F.collect_list(F.struct("offset", "length")).alias("at"))
    files = spark.read.format("binaryFile").load(f"{folder}/records").select("shard", "content")
    return files.join(at, "shard").select("content", "at").mapInArrow(run, "key long, ids array<int>")


def packed(docs: DataFrame, tokenizer: str, end: int, folder: str | None = None) -> DataFrame:
    """Write the records and their index, and return the index as read back, with the start of each record."""
    folder = folder or shared_folder(docs.sparkSession)
    write(docs, folder, tokenizer, end)
    return starts(read_index(docs.sparkSession, folder))
