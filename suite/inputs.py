"""Inputs the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skypairs.functions.binning import Binning
from skypairs.functions.geometry import with_angles, with_unit_vector

BINS = Binning.log(2.5, 250.0, 20)
LINEAR = Binning.linear(2.5, 252.5, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sky position for every order: (id, ra, dec) in degrees, from its key by modular arithmetic."""
    k = F.col("o_orderkey")
    p, q = 999983, 1000003
    a, b = k % p, k % q
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        (F.lit(360.0) * ((a * a * 7919 + a * 104729) % p) / float(p)).alias("ra"),
        F.degrees(F.asin(F.lit(2.0) * ((b * b * 15485 + b * 32452843) % q) / float(q) - 1.0)).alias("dec"))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_angles(sky(spark, sf_dir)).select("id", "theta", "phi")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_unit_vector(angles(spark, sf_dir))


def next_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the one that has the next key, as suffixes _s and _t."""
    v = vectors(spark, sf_dir)
    s = v.select(*(F.col(c).alias(f"{c}_s") for c in v.columns))
    t = v.select((F.col("id") - 1).alias("before"), *(F.col(c).alias(f"{c}_t") for c in v.columns))
    return s.join(t, F.col("id_s") == F.col("before")).drop("before")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *(F.get("embedding", k).cast("double").alias(c) for k, c in enumerate("xyz")))


def customer_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smaller sky: a position for every customer, from its key as in ``sky``."""
    k = F.col("c_custkey")
    p, q = 999983, 1000003
    a, b = k % p, k % q
    return table(spark, sf_dir, "customer").select(
        k.alias("id"),
        (F.lit(360.0) * ((a * a * 7919 + a * 104729) % p) / float(p)).alias("ra"),
        F.degrees(F.asin(F.lit(2.0) * ((b * b * 15485 + b * 32452843) % q) / float(q) - 1.0)).alias("dec"))


def twin_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer twice, 0.001 arcmin apart."""
    twin = F.explode(F.sequence(F.lit(0), F.lit(1)))
    return customer_sky(spark, sf_dir).select("id", "ra", "dec", twin.alias("twin")).select(
        (F.col("id") * 2 + F.col("twin")).alias("id"), "ra",
        (F.col("dec") + F.when(F.col("dec") > 0, -1.0).otherwise(1.0) * F.col("twin") / 60000.0).alias("dec"))


def crowded_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in three patches of half a degree, by customer; some share a position."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        (F.lit(40.0) + F.col("o_custkey") % 3 * 30 + (k * 7919) % 199 / 398.0).alias("ra"),
        (F.lit(10.0) + (k * 104729) % 211 / 422.0).alias("dec"))


def uneven_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders around one place: half within a tenth of a degree, a quarter within one and a quarter within twenty
    degrees, so the densities differ more than 10,000-fold."""
    k = F.col("o_orderkey")
    wide = F.when(k % 4 < 2, 0.1).when(k % 4 == 2, 1.0).otherwise(20.0)
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), (F.lit(40.0) + wide * ((k * 7919) % 9973) / 9973.0).alias("ra"),
        (F.lit(10.0) + wide * ((k * 104729) % 10007) / 10007.0).alias("dec"))


def sky_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sky with right ascensions and declinations that are NaN, infinite or null."""
    k, nan = F.col("id"), F.lit(float("nan"))
    return sky(spark, sf_dir).select(
        "id", F.when(k % 7 == 0, nan).when(k % 7 == 1, F.lit(float("inf"))).otherwise(F.col("ra")).alias("ra"),
        F.when(k % 5 == 0, nan).when(k % 5 != 1, F.col("dec")).alias("dec"))


def log_lines(spark: SparkSession, sf_dir: str, reduced: bool) -> DataFrame:
    """A run-log line per line item: its numbers stand in for those of a job."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    fixed = [F.lit("r@@" if reduced else "x@@"), F.col("l_linenumber"), F.col("l_linenumber") + 4,
             F.col("l_orderkey"), F.col("l_partkey"), F.col("l_extendedprice"), F.col("l_suppkey")]
    if reduced:
        fixed += [F.col("l_suppkey") * 6, q]
    nodes = F.pmod("l_suppkey", F.lit(5)) * 8 + 8
    fixed += [F.col("l_partkey") * 6, nodes, q, q, q]
    phases = [q + 1, q + 2, F.lit(0), q * 2 + 1, F.col("l_tax") + F.col("l_quantity")]
    if reduced:
        phases.insert(0, q + 3)
    return li.select(F.concat_ws(" ", *(c.cast("string") for c in fixed + phases)).alias("value"))
