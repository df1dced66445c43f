"""Phrases whose words stand together more often than they stand apart (operator 11).

Every word begins one padded window of the longest width, and only those windows are counted: the lead columns w1 to w4 (for
four words) hold the words that follow in the same piece, and nothing past its end. Spark's ROLLUP then sums the windows by ever
shorter prefixes, which are the counts of all shorter phrases; phrases of two and three words are never listed from the
texts. Cuts and containment are joins between the phrases that are frequent enough.

Words with fewer than `least` occurrences are in no phrase that counts, so a window ends before them. A first count of
the words tells which. If the others are counted to be few enough (LISTED words, LISTED_BYTES), they are broadcast as a
numbered list, and the lead columns hold numbers; if not, the lead columns hold the words themselves, and a bit map of fixed
size over checksums tells which words are frequent (a bit that two words share only lets a needless word through). Both give
the same. Windows are summed by chunks of texts before they leave a task, so a frequent one leaves it a few times.

The arithmetic is exact: counts are longs, the score is a quotient of decimals of 38 digits.

Edge cases: a null text has no words, a null language is `und`, empty pieces have no words. Repeated rows count each time. A text
of any length is one row. Keys don't matter and may be null; further columns don't matter. Of an empty table nothing is returned. Equal
scores and counts are ordered by the bytes of the phrase.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skypairs.llm.columns import binary_rows, written

UNDEFINED = "und"
#: Characters that end a piece, and those that part words.
ENDS = ".,;:!?\n\x0b\f\r"
BLANKS = " \t"
#: Bytes of text summed at once.
CHUNK = 8 << 20
#: The longest list of frequent words that is broadcast: three numbers of a window make one long.
LISTED, LISTED_BYTES = (1 << 21) - 2, 64 << 20
#: Bits of the map of frequent words: 4 MB.
BITS = 25
_CODE = 31


def _table(change: dict[str, int], default: np.ndarray) -> np.ndarray:
    table = default.copy()
    for chars, value in change.items():
        table[list(chars.encode())] = value
    return table


_LOWER = _table({chr(c): c + 32 for c in range(65, 91)}, np.arange(256, dtype=np.uint8))
_KIND = _table({BLANKS: 1, ENDS: 2}, np.zeros(256, np.uint8))


class Words:
    """Words of the texts of a chunk in their order, with the piece and the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = _KIND[data]
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        first[begins] = inside[begins]
        starts = np.flatnonzero(first)
        self.row = np.searchsorted(offsets, starts, "right") - 1
        self.piece = np.cumsum(kind == 2)[starts] + self.row  # both grow, so the sum changes if either does
        ends = np.concatenate([[0], np.cumsum(inside)])[np.append(starts, len(data))]
        letters = _LOWER[data[inside]]
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        self.distinct = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Bytes of texts, the offsets of their rows, and their languages; about CHUNK bytes at once, a longer text by itself."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, offsets = binary_rows(batch.column(1))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK - size, "right")) - 1)
            held.append(batch.slice(begin, end - begin))
            size += int(offsets[end] - offsets[begin])
            begin = end
            if size >= CHUNK or begin < batch.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    table = pa.Table.from_batches(held).combine_chunks()
    data, offsets = binary_rows(table.column(1).chunk(0))
    return data, offsets, table.column(0).chunk(0)


def _summed(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples in ascending order, and how often each occurs."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.diff(np.append(at, len(order)))


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNDEFINED)).alias("lang"), F.col(text).alias("text"))


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, word, f: occurrences of each word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, langs in _chunks(batches):
            words, langs = Words(data, offsets), langs.dictionary_encode()
            language = langs.indices.to_numpy(zero_copy_only=False)[words.row].astype(np.int64)
            (key,), counts = _summed([language << _CODE | words.code])
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(key >> _CODE)), words.distinct.take(pa.array(key & (1 << _CODE) - 1)).cast(pa.large_string()).cast(pa.string()),
                 pa.array(counts)], ["lang", "word", "f"])

    found = _rows(docs, text, lang).mapInArrow(run, "lang string, word string, f long")
    return found.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _bit_map(words: DataFrame, bits: int) -> np.ndarray:
    """Bits of the checksums of the words. At most 2^bits / 64 numbers reach the driver, whatever the table."""
    bit = F.crc32("word").bitwiseAND(F.lit((1 << bits) - 1))
    parts = (words.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at"))
             .agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("part")).toPandas())
    out = np.zeros(max(1, (1 << bits) // 64), np.int64)
    out[parts["at"].to_numpy(np.int64)] = parts["part"].to_numpy(np.int64)
    return out


def _leads(first: np.ndarray, at: np.ndarray, words: Words, width: int) -> list[np.ndarray]:
    """The lead columns of the windows that begin at the words `at`: their numbers, 0 past the end of the piece or before a word numbered 0."""
    columns = [first[at]]
    inside = np.ones(len(at), bool)
    for k in range(1, width):
        following = np.minimum(at + k, len(first) - 1)
        inside &= (at + k < len(first)) & (words.piece[following] == words.piece[at]) & (first[following] > 0)
        columns.append(np.where(inside, first[following], 0))
    return columns


def windows(docs: DataFrame, frequent: np.ndarray, width: int = 4, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, w1 ... w<width>, f: padded windows (the empty string past the end) that begin at each word whose bit is set."""
    names = [f"w{k + 1}" for k in range(width)]
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        mask, low = 64 * len(bits) - 1, (1 << _CODE) - 1
        for data, offsets, langs in _chunks(batches):
            words, langs = Words(data, offsets), langs.dictionary_encode()
            sums = np.fromiter(map(zlib.crc32, words.distinct.to_pylist()), np.int64, len(words.distinct)) & mask
            known = (bits[sums >> 6] >> (sums & 63) & 1).astype(bool)
            number = np.where(known[words.code], words.code + 1, 0)
            at = np.flatnonzero(number)
            language = langs.indices.to_numpy(zero_copy_only=False)[words.row[at]].astype(np.int64)
            columns = _leads(number, at, words, width)
            packed = [language << _CODE | columns[0]]
            for k in range(1, width, 2):
                packed.append(columns[k] << _CODE | (columns[k + 1] if k + 1 < width else 0))
            keys, counts = _summed(packed)
            parts = [keys[0] & low, *(p for key in keys[1:] for p in (key >> _CODE, key & low))][:width]
            strings = _strings(pa.concat_arrays([pa.array([b""], pa.large_binary()), words.distinct]))
            for some in _slices(len(counts)):
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(keys[0][some] >> _CODE)), *(strings.take(pa.array(p[some])) for p in parts), pa.array(counts[some])],
                    ["lang", *names, "f"])

    schema = ", ".join(f"{c} string" for c in ["lang", *names]) + ", f long"
    found = _rows(docs, text, lang).mapInArrow(run, schema)
    # summed in the tasks already, so they are dealt out before Spark sums them again
    return found.repartition("lang", *names[:-1]).groupBy("lang", *names).agg(F.sum("f").alias("f"))


def _strings(words: pa.Array) -> pa.Array:
    return words.cast(pa.large_string()).cast(pa.string())


def _slices(n: int, size: int = 1 << 16) -> Iterator[slice]:
    return (slice(begin, begin + size) for begin in range(0, n, size))


class Listed:
    """The frequent words of all languages, numbered from 1 on."""

    def __init__(self, langs: list[str], words: list[str]):
        order = sorted(range(len(langs)), key=lambda k: langs[k])
        self.langs = [langs[k] for k in order]
        self.words = pa.array([words[k] for k in order], pa.string())
        self.begin: dict[str, int] = {}
        for k, lang in enumerate(self.langs):
            self.begin.setdefault(lang, k)
        ends = [*self.begin.values(), len(order)][1:]
        self.of_lang = {lang: self.words.slice(begin, end - begin).cast(pa.large_string()).cast(pa.large_binary())
                        for (lang, begin), end in zip(self.begin.items(), ends, strict=True)}

    def numbers(self, words: Words, langs: pa.Array) -> np.ndarray:
        """The number of each word of a chunk, 0 for those not listed."""
        out = np.zeros(len(words.code), np.int64)
        language = langs.indices.to_numpy(zero_copy_only=False)[words.row]
        number = np.zeros(len(words.distinct), np.int64)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            if lang in self.of_lang:
                mine = np.flatnonzero(language == k)
                codes = np.unique(words.code[mine])
                place = pc.index_in(words.distinct.take(pa.array(codes)), value_set=self.of_lang[lang]).fill_null(-1).to_numpy(zero_copy_only=False)
                number[codes] = np.where(place < 0, 0, place + self.begin[lang] + 1)
                out[mine] = number[words.code[mine]]
        return out


def numbered_windows(docs: DataFrame, listed: Broadcast, text: str = "text", lang: str = "lang") -> DataFrame:
    """three, w4, f: padded windows of four (0 past the end) by the numbers of listed words, which tell the language too; the first
    three are one long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, langs in _chunks(batches):
            words = Words(data, offsets)
            number = listed.value.numbers(words, langs.dictionary_encode())
            w1, w2, w3, w4 = _leads(number, np.flatnonzero(number), words, 4)
            (three, last), counts = _summed([w1 << 42 | w2 << 21 | w3, w4])
            for some in _slices(len(counts)):
                yield pa.RecordBatch.from_arrays([pa.array(three[some]), pa.array(last[some]), pa.array(counts[some])], ["three", "w4", "f"])

    found = _rows(docs, text, lang).mapInArrow(run, "three long, w4 long, f long")
    return found.repartition("three").groupBy("three", "w4").agg(F.sum("f").alias("f"))


def phrases(longest: DataFrame, least: int, leads: dict[str, Column], last: str, pad: str | int) -> DataFrame:
    """The lead columns, the last one and f: phrases with at least so many occurrences; columns past the end of a phrase are null.

    longest: counts of the longest windows, dealt out by their columns but the last two. leads: the columns of a window but
    the last, computed from those by which it was dealt out. The first sum, over the last word, stays in its partition;
    the shorter prefixes are rolled up from there.
    """
    dealt = [c for c in longest.columns if c not in (last, "f")]
    names = [*leads]
    shorter = longest.groupBy(*dealt).agg(F.sum("f").alias("f")).select(*(c.alias(n) for n, c in leads.items()), "f")
    rolled = shorter.rollup(*names[:-1]).agg(F.sum("f").alias("f"), F.grouping_id().alias("level"))
    # a prefix is a phrase where its last column is filled and those after it are rolled up
    end = F.coalesce(*(F.when(F.col("level") == (1 << len(names) - 2 - k) - 1, F.col(names[k])) for k in range(len(names) - 1)))
    rolled = rolled.filter((F.col("f") >= least) & (end != F.lit(pad)))

    def whole(counts: DataFrame, column: str) -> DataFrame:
        # one condition on both, so that none of it is asked before the exchange, which all branches read
        return counts.filter(F.col("f") * F.when(F.col(column) != F.lit(pad), 1).otherwise(0) >= least)

    longest = longest.select(*(c.alias(n) for n, c in leads.items()), last, "f")
    return (whole(longest, last).unionByName(whole(shorter, names[-1]), allowMissingColumns=True)
            .unionByName(rolled.select(*names[:-1], "f"), allowMissingColumns=True))


def _spelled(found: DataFrame, listed: Broadcast) -> DataFrame:
    """lang, words, f for phrases of numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = listed.value
            rows = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns[:4]], axis=1)
            sizes = (rows > 0).sum(axis=1)
            words = table.words.take(pa.array(rows[rows > 0] - 1))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            langs = pa.array([table.langs[k - 1] for k in rows[:, 0].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([langs, pa.ListArray.from_arrays(offsets, words), batch.column(4)], ["lang", "words", "f"])

    return found.select("w1", "w2", "w3", "w4", "f").mapInArrow(run, "lang string, words array<string>, f long")


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int, width: int, text: str, lang: str, listed: int, bits: int) -> DataFrame:
    """lang, words, f: phrases of one to `width` words with at least `least` occurrences. words: as word_counts gives them."""
    frequent = words.filter(F.col("f") >= least)
    count, size = frequent.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang")), F.lit(0))).first()
    if width == 4 and count <= listed and size <= LISTED_BYTES:
        rows = frequent.select("lang", "word").toPandas()
        shared = docs.sparkSession.sparkContext.broadcast(Listed(rows["lang"].tolist(), rows["word"].tolist()))
        leads = {f"w{k + 1}": F.shiftright("three", 42 - 21 * k).bitwiseAND(F.lit((1 << 21) - 1)) for k in range(3)}
        return _spelled(phrases(numbered_windows(docs, shared, text, lang), least, leads, "w4", 0), shared)
    names = [f"w{k + 1}" for k in range(width)]
    longest = windows(docs, _bit_map(frequent.select("word").distinct(), bits), width, text, lang)
    found = phrases(longest, least, {c: F.col(c) for c in ["lang", *names[:-1]]}, names[-1], "")
    return found.filter(F.col("w1").isNotNull()).select("lang", F.array_compact(F.array(*names)).alias("words"), "f")


def _part(words: Column, begin: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def scored(found: DataFrame) -> DataFrame:
    """lang, words, phrase, a, k, l, r, score: phrases of two words or more with their lowest-scoring cut."""
    counts = found.select("lang", "phrase", "f")
    cuts = (found.filter(F.size("words") > 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
            .withColumn("first", _part(F.col("words"), F.lit(1), F.col("k")))
            .withColumn("rest", _part(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")))
            .withColumnRenamed("f", "a"))
    cuts = (cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    score = F.expr("(CAST(2000000 AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return (cuts.groupBy("lang", "phrase").agg(lowest, F.first("words").alias("words"), F.first("a").alias("a"))
            .select("lang", "words", "phrase", "a", "cut.k", "cut.l", "cut.r", "cut.score"))


def contained(found: DataFrame, share: int) -> DataFrame:
    """lang, phrase: phrases of two words or more inside a longer one that has at least `share` hundredths of their occurrences."""
    size = F.size("words")
    inner = (found.filter(size > 2).withColumn("n", F.explode(F.sequence(F.lit(2), size - 1)))
             .withColumn("begin", F.explode(F.sequence(F.lit(1), size - F.col("n") + 1)))
             .groupBy("lang", _part(F.col("words"), F.col("begin"), F.col("n")).alias("phrase")).agg(F.max("f").alias("longer")))
    few = F.lit(100).cast("decimal(20,0)") * F.col("longer") >= F.lit(share).cast("decimal(20,0)") * F.col("f")
    return found.select("lang", "phrase", "f").join(inner, ["lang", "phrase"]).filter(few).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000, width: int = 4, text: str = "text",
                 lang: str = "lang", listed: int = LISTED, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    least: occurrences that a phrase needs. share: a phrase goes if a longer one has so many hundredths of its occurrences. top: phrases
    of a language. width: longest phrase, in words. listed, bits: how many frequent words are broadcast by number, and beyond
    that the map of frequent words has 2^bits (both for tuning only).
    """
    words = written(word_counts(docs, text, lang))
    found = written(frequent_phrases(docs, words, least, width, text, lang, listed, bits)
                    .withColumn("phrase", F.array_join("words", " ")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (scored(found).join(contained(found, share), ["lang", "phrase"], "left_anti")
              .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
