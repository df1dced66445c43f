"""Run logs: lines of a tag and blank-separated values, one line per finished job."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the log lines, by tag (exact and reduced jobs).
FIELDS = {
    "x@@": "imin imax Ndata Ndup nedges Nj NpixJ nodes part1 part2 part3 ts td tj tb t",
    "r@@": "imin imax Ndata Ndup nedges nbaseD NpixD nbaseJ NpixJ nodes part1 part2 part3 tr ts td tj tb t",
}
PHASES = {"x@@": ("ts", "td", "tj", "tb"), "r@@": ("tr", "ts", "td", "tj", "tb")}


def parse_run_log(lines: DataFrame, tag: str, column: str = "value") -> DataFrame:
    """Typed rows of the lines that start with ``tag``; other lines are left out. A value that is
    not a number becomes null."""
    # the tag is looked for in the line itself, so that only its lines are cut, and each once
    mine = lines.where(F.col(column).rlike(rf"^\s*{re.escape(tag)}(\s|$)"))
    rows = mine.select(F.split(F.trim(F.col(column)), r"\s+").alias("p"))
    wide = {"nedges", "t"}
    return rows.select(*(F.get("p", k + 1).try_cast("double" if f in wide else "long").alias(f)
                         for k, f in enumerate(FIELDS[tag].split())))


def read_run_log(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return parse_run_log(spark.read.text(path), tag)


SETTINGS = ("Ndata", "imin", "imax", "NpixJ", "NpixD")


def time_by_nodes(log: DataFrame) -> DataFrame:
    """Runs, mean and population stdev of the run time, mean of each phase, and the least of each setting, per cluster
    size. Runs of one log share their settings."""
    phases = [c for c in ("tr", "ts", "td", "tj", "tb") if c in log.columns]
    return (log.groupBy("nodes").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("t").alias("t"), F.stddev_pop("t").alias("sig"),
        *(F.avg(c).alias(c) for c in phases),
        *(F.min(c).alias(c) for c in SETTINGS if c in log.columns)).orderBy("nodes"))


def phase_shares(times: DataFrame) -> DataFrame:
    """Each phase in percent of all phases; join and binning count as one."""
    parts = {"reduction": F.col("tr")} if "tr" in times.columns else {}
    parts |= {"source": F.col("ts"), "duplicate": F.col("td"), "join": F.col("tj") + F.col("tb")}
    whole = sum(list(parts.values())[1:], list(parts.values())[0])
    return times.select("nodes", *(F.try_divide(c * 100.0, whole).alias(k) for k, c in parts.items()))
