"""Benchmark decontamination by a positional inverted index (operator 5), in DataFrame operations only.

1. The benchmark's words are cut into windows of ten (an item of fewer words is one window) and equal windows merged.
2. The training texts are counted for the benchmark's terms; windows with a term that never occurs are dropped.
3. The index holds the postings (document, position) of the two rarest terms of each window.
4. Postings of the rarest term, less its offset in the window, are candidate starts; they are intersected with the
   offset-adjusted postings of the second, and the survivors compared with the document's words there. What is left are
   the exact phrase matches.

The benchmark's terms and windows are broadcast if they are counted to be at most SMALL rows, and joined by shuffle
otherwise. Nothing but such counts reaches the driver.

Edge cases: null texts and texts without words have no windows and no hits; null benchmark texts likewise. Repeated
items or rows don't matter: each row of the table gives a row, each item_id counts once. Null keys are kept; an item
with a null item_id marks words but is not counted. Further columns don't matter. An empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skypairs.llm.columns import ascii_lower, fresh, written
from skypairs.llm.shingles import SEPARATORS, words

WINDOW = 10
SMALL = 500_000
_KEY = ["doc", "mark"]


def _small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if the (written) table has at most SMALL rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def windows(items: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows: words (array), items (array of the ids, as strings, that have it)."""
    cut = items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("all")).filter(F.size("all") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1))))
    return (cut.select("item", "all", at.alias("at")).select("item", F.slice("all", F.col("at"), F.lit(size)).alias("words"))
            .groupBy("words").agg(F.collect_set("item").alias("items")))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc and mark (a hash of the text) name a row; equal rows share them and have equal results."""
    return docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def _tokens(text: Column) -> Column:
    return F.split(ascii_lower(text), SEPARATORS)


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """term, n: how often each of the terms occurs in all texts; terms that never occur are absent."""
    return (docs.select(F.explode(_tokens(F.col(text))).alias("term")).join(terms, "term")
            .groupBy("term").agg(F.count("*").alias("n")))


def postings(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: term, doc, mark, pos (from 0) of every occurrence of the terms."""
    found = _rows(docs, key, text).select(*_KEY, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return found.join(terms, "term").select("term", *_KEY, "pos")


def proximity_matches(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """query, doc, mark, pos: places from which all terms of a query (query, terms) occur within `span` words."""
    want = queries.select("query", F.size(F.array_distinct("terms")).alias("n"), F.explode(F.array_distinct("terms")).alias("term"))
    places = (index.join(want, "term").groupBy("query", "n", *_KEY)
              .agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("at")))

    def whole(here: Column) -> Column:
        near = F.filter("at", lambda p: (p["pos"] >= here["pos"]) & (p["pos"] < here["pos"] + span))
        return F.size(F.array_distinct(F.transform(near, lambda p: p["term"]))) == F.col("n")

    return places.select("query", *_KEY, F.explode(F.filter("at", whole)).alias("hit")).select("query", *_KEY, "hit.pos")


def phrase_candidates(docs: DataFrame, of: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, mark, start, words, items: places where the two rarest terms of a window lie as in the window."""
    parts = of.select("words", F.posexplode("words").alias("offset", "term"))
    terms = _small(written(parts.select("term").distinct()))
    counts = written(term_counts(docs, terms, text))
    ranked = (parts.join(counts, "term").groupBy("words")
              .agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("rare"))
              .filter(F.size("rare") == F.size("words")))
    first, second = F.get("rare", F.lit(0)), F.coalesce(F.get("rare", F.lit(1)), F.get("rare", F.lit(0)))
    plan = written(ranked.join(of, "words").select(
        "words", "items", first["term"].alias("term"), first["offset"].alias("offset"),
        second["term"].alias("next"), second["offset"].alias("next_offset")))
    wanted = _small(written(plan.select("term").union(plan.select("next")).distinct()))
    index = written(postings(docs, wanted, key, text))
    starts = (index.join(_small(plan), "term").withColumn("start", F.col("pos") - F.col("offset"))
              .filter("start >= 0").withColumn("pos", F.col("start") + F.col("next_offset")).drop("term"))
    again = index.withColumnRenamed("term", "next")
    # keys can be null, and a null key equals itself here
    both = (starts["doc"].eqNullSafe(again["doc"]) & (starts["mark"] == again["mark"])
            & (starts["next"] == again["next"]) & (starts["pos"] == again["pos"]))
    return starts.join(again, both, "left_semi").select(*_KEY, "start", "words", "items")


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: the key, n_words, hits (array of start, length of the exact phrase matches) and items
    (ids of the items found, as sorted strings)."""
    of = written(windows(items))
    found = (phrase_candidates(docs, of, key, text).groupBy(*_KEY)
             .agg(F.collect_list(F.struct("start", "words", "items")).alias("found")))
    rows = _rows(docs, key, text)
    same = rows["doc"].eqNullSafe(found["doc"]) & (rows["mark"] == found["mark"])
    all_words = rows.join(found, same, "left").select(rows["doc"], words(F.col("text")).alias("words"), "found")
    none = F.array().cast(found.schema["found"].dataType)

    def exact(c: Column) -> Column:
        return F.slice("words", c["start"] + 1, F.size(c["words"])) == c["words"]

    exactly = all_words.select("doc", F.size("words").alias("n_words"),
                               F.when(F.col("found").isNull(), none).otherwise(F.filter("found", exact)).alias("found"))
    return exactly.select(
        F.col("doc").alias(key), "n_words",
        F.transform("found", lambda c: F.struct(c["start"].alias("start"), F.size(c["words"]).alias("length"))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.transform("found", lambda c: c["items"])))).alias("items"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without an exact phrase match, as they are."""
    *names, matches = fresh(docs.columns, 3)
    found = (phrase_candidates(docs, written(windows(items)), key, text).groupBy(*_KEY)
             .agg(F.collect_list(F.struct("start", "words")).alias(matches)))
    found = found.select(F.col("doc").alias(names[0]), F.col("mark").alias(names[1]), matches)
    rows = docs.withColumn(names[1], F.xxhash64(text))
    both = rows.join(found, rows[key].eqNullSafe(found[names[0]]) & (rows[names[1]] == found[names[1]]), "left")
    tokens = words(F.col(text))
    hit = F.exists(matches, lambda c: F.slice(tokens, c["start"] + 1, F.size(c["words"])) == c["words"])
    return both.filter(F.col(matches).isNull() | ~hit).select(*[rows[c] for c in docs.columns])


def hit_words(hits: Column) -> Column:
    """Number of words inside any of the hits."""
    places = F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))
    return F.size(F.array_distinct(F.flatten(places)))
