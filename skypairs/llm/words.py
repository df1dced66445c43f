"""Work done once for each distinct word of a task and looked up for every occurrence.

A text column is cut at ASCII blanks by Arrow, its words become numbers, and only words that the task has not met
yet are worked on. What a word stands for is an array of integers; a document's result is the concatenation of its
words' arrays, gathered by numpy. Memory is bounded: slices of at most SLICE bytes of text (a longer text is a slice
of its own) and at most WORDS remembered words, after which the memory is emptied and refilled as words come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skypairs.llm.columns import ranges

SLICE = 2 << 20
WORDS = 1 << 18


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows that hold about that many bytes of text; null texts become empty ones."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        whole = batch.column(at).cast(pa.large_string())
        batch = batch.set_column(at, text, whole.fill_null("") if whole.null_count else whole)
        total = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + size, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
        pa.default_memory_pool().release_unused()


def joined(arrays: list[np.ndarray], dtype=np.int32) -> tuple[np.ndarray, np.ndarray]:
    """The arrays one after another, and their lengths."""
    lengths = np.fromiter(map(len, arrays), np.int64, len(arrays))
    return np.concatenate([np.empty(0, dtype), *arrays]), lengths


class Remembered:
    """Arrays of numbers by word, of so many words at most; `work` makes them for a list of new words: all values, and how many
    each word has."""

    def __init__(self, work: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype=np.int32, most: int = WORDS):
        self.work, self.dtype, self.most = work, dtype, most
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values = np.empty(1 << 16, self.dtype)
        self.used = 0
        self.starts = np.empty(1 << 12, np.int64)
        self.lengths = np.empty(1 << 12, np.int64)

    def _add(self, words: list[str]) -> None:
        values, lengths = self.work(words)
        size, have = int(lengths.sum()), len(self.known)
        while self.used + size > len(self.values):
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        while have + len(words) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        self.values[self.used:self.used + size] = values
        self.starts[have:have + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[have:have + len(words)] = lengths
        self.used += size
        self.known.update(zip(words, range(have, have + len(words)), strict=True))

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All values of the words one after another, and the number of values of each word."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.most:
            self.forget()
        known = self.known
        if new := [w for w in distinct if w not in known]:
            self._add(new)
        codes = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        codes = codes[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else codes
        lengths = self.lengths[codes]
        return self.values[ranges(self.starts[codes], lengths)], lengths


def row_totals(lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the lengths between each two offsets."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    return total[offsets[1:]] - total[offsets[:-1]]
