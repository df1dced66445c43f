"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skypairs.llm import (bpe, collocations, decontaminate, licenses, merkle, neardup, neighbours, oracles, pieces, pii,
                          quality, records, repeats, viterbi)
from skypairs.llm.columns import ascii_lower
from skypairs.llm.license_texts import NOTICES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def _span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(_span_text("base"), 256).alias("base_sha256"),
                        _span_text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), NOTICES)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words(F.col("hits")).cast("long")
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("hits") > 0).alias("contaminated"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, trees).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = records.packed(table(spark, sf_dir, "documents"), WORD_TOKENIZER, END)
    key = F.when(F.col("key") != records.NULL_KEY, F.col("key"))
    return index.select(key.alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.token_counts(table(spark, sf_dir, "documents"), PIECES)


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_copies(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = merkle.leaf([F.col(c) for c in columns])
    tampered = merkle.leaf([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in columns])
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, tampered)
    return merkle.manifest(table(spark, sf_dir, "documents"), "doc_id", "source", leaf, shown)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = pieces.encode(table(spark, sf_dir, "documents"), PIECES)
    ids = ids.select(F.struct("doc_id", "ids", "agrees").alias("row"), "ids")
    back = pieces.decode(ids, PIECES, key="row")
    return back.select("row.doc_id", F.expr("octet_length(row.ids) div 4").cast("long").alias("n_tokens"),
                       F.sha2("row.ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                       "row.agrees")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_pii": op2_pii,
    "op3_licenses": op3_licenses,
    "op4_neighbours": op4_neighbours,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_token_records": op7_token_records,
    "op8_repeats": op8_repeats,
    "op9_token_counts": op9_token_counts,
    "op10_near_copies": op10_near_copies,
    "op11_collocations": op11_collocations,
    "op12_manifest": op12_manifest,
    "op13_pieces": op13_pieces,
}

#: The other queries need a tokenizer, a fitted model or signatures; they are tested against brute force.
SQL = {"op5_decontamination": oracles.DECONTAMINATION, "op8_repeats": oracles.REPEATS,
       "op11_collocations": oracles.COLLOCATIONS, "op12_manifest": oracles.MANIFEST}
