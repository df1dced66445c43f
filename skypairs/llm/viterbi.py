"""Token counts by a count-only Viterbi pass over a unigram vocabulary (operator 9).

An Aho-Corasick automaton lists the vocabulary pieces that end at each character of a word; dynamic programming
carries, for each prefix, only the best score and the number of pieces on its path. No path is kept.

Rules, as the tokenizers library's Unigram model has them: blanks become U+2581, one is put before a text that isn't
empty; a path replaces another that ends at the same place only if its score is strictly higher, paths being tried in
the order of where their last piece starts; a character with no piece of its own may be taken at ten below the lowest
score, and counts one token for each of its UTF-8 bytes. Scores are added as doubles.

A text is worked on by runs of blanks with the word that follows, each distinct one of a task once. That gives the
result for whole texts, because no piece crosses from a word into a blank; a vocabulary that has such a piece is refused.

Edge cases: a null or empty text has no tokens and score 0. Rows are independent: repeated rows, null or repeated
keys and further columns don't matter; only the key and the counts are returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skypairs.llm.columns import flat, tidied
from skypairs.llm.words import Remembered, row_totals, slices

BLANK = "▁"
PENALTY = 10.0
_LOWEST = float("-inf")
_RUN = re.compile(f"{BLANK}+[^{BLANK}]*")


def vocabulary(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a sentencepiece model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda k: model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k)
    return {model.id_to_piece(k): model.get_score(k) for k in range(model.get_piece_size()) if not odd(k)}


class Counter:
    """Tokens and score of a word, blank included."""

    def __init__(self, scores: dict[str, float]):
        if odd := [p for p in scores if BLANK in p.lstrip(BLANK)]:
            raise ValueError(f"pieces cross from a word into a blank: {odd[:5]}")
        self.unknown = min(scores.values()) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def __call__(self, word: str) -> tuple[int, float]:
        best, count = [0.0], [0]
        ends: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, piece in self.automaton.iter(word):
            ends[end].append(piece)
        for end, found in enumerate(ends):
            top, pieces, single = _LOWEST, 0, False
            for length, score in sorted(found, reverse=True):  # the piece that starts first is tried first
                start = end + 1 - length
                if (total := best[start] + score) > top:
                    top, pieces = total, count[start] + 1
                single |= length == 1
            if not single and best[end] + self.unknown > top:
                top, pieces = best[end] + self.unknown, count[end] + len(word[end].encode())
            best.append(top)
            count.append(pieces)
        return count[-1], best[-1]


@lru_cache(maxsize=2)
def _remembered(path: str) -> Remembered:
    counter = Counter(vocabulary(path))

    def work(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([counter(BLANK + w) for w in words]).reshape(-1), np.full(len(words), 2)

    return Remembered(work, np.float64)


def _chunks(texts: pa.Array) -> pa.Array:
    """Lists of what follows the first blank of each run of blanks, the one put before the text included."""
    single = pc.split_pattern(texts, " ")
    runs = pc.match_substring_regex(texts, f"  |^ | $|{BLANK}").to_numpy(zero_copy_only=False)
    if not runs.any():
        return single
    rows = [[c[1:] for c in _RUN.findall(BLANK + t.as_py().replace(" ", BLANK))] if odd else w.as_py()
            for t, w, odd in zip(texts, single, runs, strict=True)]
    return pa.array(rows, single.type)


def token_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens (long), score (double) of each text. model: path of a sentencepiece model, its scores taken as
    those of a unigram vocabulary; readable on every executor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = _remembered(model)
        for batch in slices(batches, "text"):
            texts = batch.column(1)
            words, offsets = flat(_chunks(texts))
            values, _ = remembered(words)
            values = values.reshape(-1, 2)
            filled = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
            tokens = np.where(filled, row_totals(values[:, 0].astype(np.int64), offsets), 0)
            scores = np.where(filled, row_totals(values[:, 1], offsets), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.array(scores)],
                                             ["key", "n_tokens", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(tidied(run, _remembered), f"key {kind}, n_tokens long, score double").toDF(key, "n_tokens", "score")
