"""Separation bins: the edges as a table, and the bin of a squared separation as a Column.

Edges are arcminutes. They become radians and, with the default ``metric="chord"``, are compared
directly with the straight-line distance between unit vectors; ``metric="arc"`` compares them with
the angle between the vectors instead.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import ARCMIN, arc_from_chord


@dataclass(frozen=True)
class Binning:
    kind: str
    lo: float
    hi: float
    n: int
    imin: int
    imax: int
    metric: str = "chord"

    @staticmethod
    def log(lo: float, hi: float, n: int, metric: str = "chord") -> "Binning":
        if lo <= 0:
            raise ValueError("logarithmic bins need a positive lower edge")
        return Binning._checked("log", lo, hi, n, metric)

    @staticmethod
    def linear(lo: float, hi: float, n: int, metric: str = "chord") -> "Binning":
        if lo < 0:
            raise ValueError("separations are not negative")
        return Binning._checked("linear", lo, hi, n, metric)

    @staticmethod
    def of_type(kind: str, lo: float, hi: float, n: int, metric: str = "chord") -> "Binning":
        if kind == "log":
            return Binning.log(lo, hi, n, metric)
        if kind == "linear":
            return Binning.linear(lo, hi, n, metric)
        raise ValueError(f"unknown bin type {kind!r}: use 'log' or 'linear'")

    @staticmethod
    def _checked(kind, lo, hi, n, metric):
        if n < 1 or hi <= lo:
            raise ValueError("bins need hi > lo and at least one bin")
        if metric not in ("chord", "arc"):
            raise ValueError(f"unknown metric {metric!r}: use 'chord' or 'arc'")
        return Binning(kind, float(lo), float(hi), int(n), 0, int(n) - 1, metric)

    def slice(self, imin: int, imax: int) -> "Binning":
        """Keep bins imin..imax, both included; the numbers stay those of the full binning."""
        if not 0 <= imin <= imax < self.n:
            raise ValueError(f"bin range {imin}..{imax} is outside 0..{self.n - 1}")
        return replace(self, imin=imin, imax=imax)

    def edge(self, i: int) -> float:
        """Edge i of the full binning, in arcmin."""
        if self.kind == "log":
            return math.exp(math.log(self.lo) + i * (math.log(self.hi) - math.log(self.lo)) / self.n)
        return self.lo + i * ((self.hi - self.lo) / self.n)

    @property
    def first_width(self) -> float:
        return self.edge(self.imin + 1) - self.edge(self.imin)

    @property
    def upper(self) -> float:
        return self.edge(self.imax + 1)

    @property
    def rmin(self) -> float:
        return math.radians(self.edge(self.imin) / 60.0)

    @property
    def rmax(self) -> float:
        return math.radians(self.upper / 60.0)

    @property
    def max_chord(self) -> float:
        """Longest chord a counted pair can have: what a spatial cover must reach."""
        return self.rmax if self.metric == "chord" else 2.0 * math.sin(min(self.rmax, math.pi) / 2.0)

    @property
    def min_chord(self) -> float:
        return self.rmin if self.metric == "chord" else 2.0 * math.sin(min(self.rmin, math.pi) / 2.0)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row (ibin, lo, hi, width) per kept bin; the edges are computed by Spark."""
        if self.kind == "log":
            step = (math.log(self.hi) - math.log(self.lo)) / self.n
            edge = lambda i: F.exp(F.lit(math.log(self.lo)) + i * step)
        else:
            edge = lambda i: F.lit(self.lo) + i * ((self.hi - self.lo) / self.n)
        ibin = F.col("id").cast("int")
        return (spark.range(self.imin, self.imax + 1, 1, 1)
                .select(ibin.alias("ibin"), edge(ibin).alias("lo"), edge(ibin + 1).alias("hi"))
                .withColumn("width", F.col("hi") - F.col("lo")))

    def _separation2(self, r2: Column) -> Column:
        if self.metric == "chord":
            return r2
        arc = arc_from_chord(F.sqrt(r2))
        return arc * arc

    def inside(self, r2: Column) -> Column:
        """True when a squared chord falls in [rmin, rmax) of the kept bins."""
        s2 = self._separation2(r2)
        return (s2 >= self.rmin * self.rmin) & (s2 < self.rmax * self.rmax)

    def index(self, r2: Column) -> Column:
        """Global bin number of a squared chord that is ``inside``. It never decreases with r2."""
        s2 = self._separation2(r2)
        if self.kind == "log":
            return self._number(F.log(s2) / 2.0 - math.log(self.rmin))
        return self._number(F.sqrt(s2) - self.rmin)

    def squared_edges(self) -> list[float]:
        """The least squared chord of each kept bin by ``inside`` and ``index``, and the least beyond the last: n + 1 numbers
        that part squared chords into the same bins. Found by halving, so only the last bit of an engine's logarithm is left."""
        def separation2(r2: float) -> float:
            if self.metric == "chord":
                return r2
            arc = 2.0 * math.asin(min(math.sqrt(r2) / 2.0, 1.0))
            return arc * arc

        span = math.log(self.hi) - math.log(self.lo) if self.kind == "log" else (self.hi - self.lo) * ARCMIN

        def number(r2: float) -> int:
            s2 = separation2(r2)
            if s2 < self.rmin * self.rmin:
                return -1
            if s2 >= self.rmax * self.rmax:
                return self.imax + 1
            offset = math.log(s2) / 2.0 - math.log(self.rmin) if self.kind == "log" else math.sqrt(s2) - self.rmin
            return min(int(offset / (span / self.n)) + self.imin, self.imax)

        def least(i: int) -> float:
            # doubles from 0 to 8 are ordered as their bits are; the longest squared chord is 4
            low, high = 0, struct.unpack("<q", struct.pack("<d", 8.0))[0]
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if number(struct.unpack("<d", struct.pack("<q", mid))[0]) >= i else (mid + 1, high)
            return struct.unpack("<d", struct.pack("<q", low))[0]

        return [least(i) for i in range(self.imin, self.imax + 2)]

    def chord_bin(self, chord: Column) -> Column:
        """As ``index``, of a plain chord. It may differ from it within rounding of a bin edge."""
        s = chord if self.metric == "chord" else arc_from_chord(chord)
        return self._number(F.log(s) - math.log(self.rmin) if self.kind == "log" else s - self.rmin)

    def _number(self, offset: Column) -> Column:
        span = math.log(self.hi) - math.log(self.lo) if self.kind == "log" else (self.hi - self.lo) * ARCMIN
        # rounding can put a separation just below the last edge one bin too far
        return F.least((offset / (span / self.n)).cast("int") + self.imin, F.lit(self.imax))


def log_bins(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    return Binning.log(lo, hi, n).table(spark)


def linear_bins(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    return Binning.linear(lo, hi, n).table(spark)


def intervals(edges: Column) -> Column:
    """Consecutive pairs of an edge array, as an array of structs (lo, hi)."""
    n = F.greatest(F.size(edges) - 1, F.lit(0))
    return F.arrays_zip(F.slice(edges, F.lit(1), n).alias("lo"), F.slice(edges, F.lit(2), n).alias("hi"))


def attach_bins(counts: DataFrame, binning: Binning) -> DataFrame:
    """Add the edges to a table of counts per ``ibin``. The bin table has one row per bin, so it is
    small by construction."""
    bins = binning.table(counts.sparkSession)
    return counts.join(F.broadcast(bins), "ibin").select("ibin", "lo", "hi", "width", "Nbin")
