"""Column statistics and histograms, each a single lazy plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def min_max(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*(f(c).alias(f"{name}_{c}") for c in columns
                    for name, f in (("min", F.min), ("max", F.max))))


def _is_missing(df: DataFrame, c: str) -> Column:
    missing = F.col(c).isNull()
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(c)
    return missing


def _any_missing(df: DataFrame, column: str | None) -> Column:
    out = F.lit(False)
    for c in [column] if column else df.columns:
        out = out | _is_missing(df, c)
    return out


def missing_count(df: DataFrame, column: str | None = None) -> DataFrame:
    """Rows where the column (or any column) is null or NaN, in one pass."""
    return df.agg(F.count_if(_any_missing(df, column)).alias("n_missing"))


def missing_fraction(df: DataFrame, column: str | None = None) -> DataFrame:
    bad = F.count_if(_any_missing(df, column))
    return df.agg(F.try_divide(bad, F.count(F.lit(1))).alias("missing_fraction"))


def _present(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).na.drop()


def _range(df: DataFrame, column: str, bounds, pad: float = 0.0) -> tuple[Column, Column]:
    """Lower and upper bound as Columns: literals, or the extremes of the data as a subquery."""
    if bounds is not None:
        return F.lit(float(bounds[0])), F.lit(float(bounds[1]))
    lo = df.agg(F.min(column).cast("double")).scalar()
    hi = df.agg(F.max(column).cast("double")).scalar()
    return lo - (hi - lo) * pad, hi + (hi - lo) * pad


def histogram(df: DataFrame, column: str, bins: int = 50,
              bounds: tuple[float, float] | None = None, weight: str | None = None) -> DataFrame:
    """(loc, count) of the non-empty bins, by bin centre; with ``weight`` its sum in place of the count.

    The last bin is open on the right: a value equal to the upper bound is not counted, with or
    without ``bounds``. If all values are equal there is nothing to bin and no row comes out.
    """
    df = _present(df, column, *([weight] if weight else []))
    value = F.col(column).cast("double")
    lo, hi = _range(df, column, bounds)
    if bounds is not None:
        df = df.where(value.between(lo, hi))
    step = (hi - lo) / bins
    slot = F.try_divide(value - lo, step).cast("int")
    each = F.lit(1).cast("long") if weight is None else F.col(weight)
    return (df.select(slot.alias("bin"), each.alias("each")).groupBy("bin").agg(F.sum("each").alias("count"))
            .where(F.col("bin") != bins)
            .select("bin", (lo + step / 2.0 + F.col("bin") * step).alias("loc"), "count")
            .orderBy("bin").select("loc", "count"))


def histogram2d(df: DataFrame, col1: str, col2: str, bins1: int = 50, bins2: int = 50,
                bounds=None, dense: bool = False) -> DataFrame:
    """(bin1, bin2, loc1, loc2, count) of the non-empty cells, or of all cells when ``dense``.

    Without bounds the range is widened by 1e-6 of itself on both ends, so every value is counted;
    with bounds a value equal to an upper bound is not.
    """
    df = _present(df, col1, col2)
    spark = df.sparkSession
    v1, v2 = F.col(col1).cast("double"), F.col(col2).cast("double")
    lo1, hi1 = _range(df, col1, bounds and bounds[0], 1e-6)
    lo2, hi2 = _range(df, col2, bounds and bounds[1], 1e-6)
    if bounds is not None:
        df = df.where(v1.between(lo1, hi1) & v2.between(lo2, hi2))
    s1, s2 = (hi1 - lo1) / bins1, (hi2 - lo2) / bins2
    counts = (df.select(F.try_divide(v1 - lo1, s1).cast("int").alias("bin1"),
                        F.try_divide(v2 - lo2, s2).cast("int").alias("bin2"))
              .groupBy("bin1", "bin2").agg(F.count(F.lit(1)).alias("count"))
              .where((F.col("bin1") != bins1) & (F.col("bin2") != bins2)))
    if dense:
        cells = spark.range(bins1 * bins2).select(F.floor(F.col("id") / bins2).cast("int").alias("bin1"),
                                                  (F.col("id") % bins2).cast("int").alias("bin2"))
        counts = (cells.join(counts, ["bin1", "bin2"], "left")
                  .withColumn("count", F.coalesce("count", F.lit(0).cast("long"))))
    return counts.select("bin1", "bin2", (lo1 + s1 / 2.0 + F.col("bin1") * s1).alias("loc1"),
                         (lo2 + s2 / 2.0 + F.col("bin2") * s2).alias("loc2"), "count")


def column_statistics(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("stddev"),
                  F.min(c).alias("min"), F.max(c).alias("max"))


def histogram_moments(hist: DataFrame, x: str = "loc", y: str = "count") -> DataFrame:
    """N, mode, mean, population stdev, skew and excess kurtosis of a histogram.

    Sums of powers about zero would cancel, so the mean is a first pass (a one-row subquery) and the
    central moments a second.
    """
    xs, w = F.col(x), F.col(y).cast("double")
    mean = hist.agg((F.sum(xs * w) / F.sum(w)).alias("m")).scalar()
    d = xs - mean
    m = hist.agg(F.sum(y).cast("long").alias("n"),
                 F.max_by(F.struct(x), F.struct(F.col(y), -xs)).getField(x).alias("mode"),
                 (F.sum(xs * w) / F.sum(w)).alias("mean"),
                 *((F.sum(F.pow(d, F.lit(float(k))) * w) / F.sum(w)).alias(f"m{k}") for k in (2, 3, 4)))
    var = F.col("m2")
    return m.select("n", "mode", "mean", F.sqrt(var).alias("stdev"),
                    F.try_divide(F.col("m3"), F.pow(var, F.lit(1.5))).alias("skew"),
                    (F.try_divide(F.col("m4"), var * var) - 3.0).alias("kurtosis"))


def histogram_fwhm(hist: DataFrame, x: str = "loc", y: str = "count") -> DataFrame:
    """Full width at half maximum. On each side of the mode that has more than five bins (the mode
    among them) the half-height crossing is interpolated between the bins whose heights enclose it;
    a shorter side ends at the mode. Null when a long side stays above half height."""
    peak = hist.agg(F.max(F.struct(F.col(y).cast("double").alias("y"), (-F.col(x)).alias("nx"))).alias("p"))
    top = peak.select("p.y").scalar()
    mode = peak.select(-F.col("p.nx")).scalar()
    point = F.struct(F.col(y).cast("double").alias("y"), F.col(x).alias("x"))
    half = top / 2.0
    rows = hist.where(F.col(y).isNotNull())

    def side(cond):
        low = F.max(F.when(cond & (F.col(y) <= half), point))
        high = F.min(F.when(cond & (F.col(y) >= half), point))
        return low, high, F.count_if(cond)

    lo_r, hi_r, n_r = side(F.col(x) >= mode)
    lo_l, hi_l, n_l = side(F.col(x) <= mode)
    wide = rows.agg(lo_r.alias("lo_r"), hi_r.alias("hi_r"), n_r.alias("n_r"), lo_l.alias("lo_l"),
                    hi_l.alias("hi_l"), n_l.alias("n_l"))

    def crossing(s):
        y0, y1, x0, x1 = (F.col(f"{k}_{s}.{v}") for v in "yx" for k in ("lo", "hi"))
        inside = x0 + F.coalesce(F.try_divide(half - y0, y1 - y0), F.lit(0.0)) * (x1 - x0)
        return F.when(F.col(f"n_{s}") > 5, inside).otherwise(mode)

    return wide.select((crossing("r") - crossing("l")).alias("fwhm"))


def in_bounds(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    return df.na.drop(subset=[column]).where(F.col(column).between(lo, hi))
