"""Small helpers shared by the operators of this subpackage: Arrow columns as numpy arrays, and the shared folder."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column and the offsets of its rows in them; a null row has no values."""
    if column.null_count:
        column = column.fill_null([])
    offsets = column.offsets.to_numpy()
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]), (offsets - offsets[0]).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + length), one range after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - ends + lengths, lengths)


def binary_column(data: np.ndarray | bytes, offsets: np.ndarray) -> pa.Array:
    """One binary value for each gap between two offsets (in bytes) into the data."""
    size = len(data) if isinstance(data, bytes) else data.nbytes
    assert offsets[-1] == size
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def binary_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and the offsets of its rows in them; a null row has none."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def tidied(run: Callable[[Iterator], Iterator], *caches) -> Callable[[Iterator], Iterator]:
    """The same work on batches; at its end the caches are emptied and free memory goes back to the system, because Python
    workers live on and do other work next."""
    def outer(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache.cache_clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return outer


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def fresh(taken: list[str], n: int) -> list[str]:
    """So many column names that are not among those taken, in any case."""
    used = {name.lower() for name in taken}
    return [name for name in (f"_c{k}" for k in range(len(used) + n)) if name not in used][:n]


def shared_folder(spark: SparkSession) -> str:
    """A new folder, seen by all executors, under the one that the session names in spark.checkpoint.dir. Where none is
    named and all runs in one process, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="skypairs-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read from there: later jobs don't depend on its lineage."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
