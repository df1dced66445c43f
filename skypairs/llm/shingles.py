"""Words and word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from skypairs.llm.columns import ascii_lower
from skypairs.llm.dart import mix

#: What parts words: ASCII characters that are neither letters nor digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    found = F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingled(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of each row, and the row of each; a row of fewer words is one run."""
    lengths = np.diff(offsets)
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    row = np.repeat(np.arange(len(lengths)), counts)
    first = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][row]
    size = np.minimum(lengths, width)[row]
    values = mix(hashes.view(np.uint64))
    out = np.zeros(len(row), np.uint64)
    for k in range(width):
        inside = k < size
        out[inside] = mix(out[inside] * np.uint64(0x9E3779B97F4A7C15) + values[first[inside] + k] + np.uint64(k + 1))
    return out, row


def counted(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending order, their counts and their rows."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (row[1:] != row[:-1])])[:len(values)])
    return values[first], np.diff(np.append(first, len(values))), row[first]
