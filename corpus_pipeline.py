"""Stages that turn the table of documents into a training corpus, each calling one operator.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. Documents of low quality go; one
document of each class of near-copies stays; documents with a passage of the benchmark go; personal data are masked by
their kind in brackets; and the texts become token ids, whose decoding is compared with the text.

Nulls, empty texts, repeated rows, empty tables and further columns are handled as the operators' docstrings say: a
document with a null text is scored like an empty one, is a class of its own, is never contaminated, holds no personal
data, and has no ids. Equal rows are one document after the second stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skypairs.llm import bpe, decontaminate, neardup, pii, quality
from skypairs.llm.columns import written
from skypairs.llm.queries import RANKS, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.masked(docs, pii.train(docs))
    return masked.withColumn("n_chars", F.char_length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and whether they decode to the text."""
    rows = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens").cast("long"), "ids",
                       F.col("same").alias("round_trip"))


STAGES = [
    ("quality", good_quality),
    ("near_copies", without_near_copies),
    ("decontamination", decontaminated),
    ("personal_data", without_personal_data),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


#: SQL expresses neither the trees nor the signatures nor the field; the tests compare each stage with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
