"""Which resolution a job needs: pixels larger, or smaller, than a given radius."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cubed_sphere, healpix, similar_radius
from ..functions.binning import Binning

RADII = {t: (m.INNER_RADIUS, m.OUTER_RADIUS) for t, m in (
    ("cubedsphere", cubed_sphere), ("similar_radius", similar_radius), ("healpix", healpix))}

# The least distance between opposite sides of a pixel, over all pixels, is the reach of `join_base` over 1.003 on the
# cubed sphere and over 0.994 on the similar-radius tiling, whose pixels also don't meet corner to corner where
# quadrants touch. Joins that must be complete take pixels that are larger by these factors.
MARGIN = {"cubedsphere": 1.01, "similar_radius": 1.25}


def _side(tiling: str, sphere_share: float, radius: Column) -> Column:
    faces = 12.0 if tiling == "healpix" else 6.0
    return F.degrees(F.lit(math.sqrt(math.pi / faces * sphere_share)) / radius) * 60.0


def coarse_base(tiling: str, radius: Column) -> Column:
    """Finest resolution whose pixels all have an inner radius above ``radius`` (arcmin)."""
    side = _side(tiling, 1.0, radius) * RADII[tiling][0]
    if tiling == "healpix":
        return F.pow(F.lit(2.0), F.floor(F.log2(side))).cast("long")
    n = F.floor(side)
    return n - n % 2


def fine_base(tiling: str, radius: Column) -> Column:
    """Coarsest resolution whose pixels all have an outer radius below ``radius`` (arcmin)."""
    side = _side(tiling, 2.0, radius) * RADII[tiling][1]
    if tiling == "healpix":
        return F.pow(F.lit(2.0), F.ceil(F.log2(side))).cast("long")
    n = F.ceil(side)
    return n + n % 2


def pixel_count(tiling: str, base: Column) -> Column:
    return base * base * (12 if tiling == "healpix" else 6)


def bin_setup(spark: SparkSession, binning: Binning, join_tiling: str = "cubedsphere",
              reduce_tiling: str = "similar_radius") -> DataFrame:
    """Per bin: edges, width, and the resolutions and pixel counts for reducing and joining."""
    return with_resolutions(binning.table(spark), join_tiling, reduce_tiling)


def with_resolutions(bins: DataFrame, join_tiling: str = "cubedsphere",
                     reduce_tiling: str = "similar_radius") -> DataFrame:
    return (bins.withColumns({"nbaseD": fine_base(reduce_tiling, F.col("width") / 2.0),
                              "nbaseJ": coarse_base(join_tiling, F.col("hi") / 2.0)})
            .withColumns({"NpixD": pixel_count(reduce_tiling, F.col("nbaseD")),
                          "NpixJ": pixel_count(join_tiling, F.col("nbaseJ"))}))


def _even(n: int, up: bool) -> int:
    return n + n % 2 if up else n - n % 2


def join_base(tiling: str, binning: Binning, margin: float = 1.0) -> int:
    """Resolution of the join grid: from half the upper edge of the last bin. Zero, as from ``coarse_base``, if the
    coarsest pixels are too small for it. ``margin`` asks for pixels larger by that factor."""
    radius = binning.upper / 2.0 * margin
    faces = 12.0 if tiling == "healpix" else 6.0
    side = math.degrees(math.sqrt(math.pi / faces) / radius) * 60.0 * RADII[tiling][0]
    if tiling == "healpix":
        return 1 << math.floor(math.log2(side)) if side >= 1.0 else 0
    return _even(math.floor(side), False)


def reduce_base(tiling: str, binning: Binning) -> int:
    """Resolution of the reduction grid: from half the width of the first bin."""
    radius = binning.first_width / 2.0
    faces = 12.0 if tiling == "healpix" else 6.0
    side = math.degrees(math.sqrt(math.pi / faces * 2.0) / radius) * 60.0 * RADII[tiling][1]
    return 1 << max(0, math.ceil(math.log2(side))) if tiling == "healpix" else _even(math.ceil(side), True)


def radius_nside(upper_arcmin: float, coarser: int = 0) -> int:
    """The older rule: a power of two from the search radius alone. It under-covers near the radius
    (part of the widest pairs is missed), so nothing uses it by default."""
    return 1 << max(0, math.floor(-math.log2(math.radians(upper_arcmin / 60.0))) - coarser)


def radius_nside_of(upper_arcmin: Column, coarser: int = 0) -> Column:
    power = F.floor(-F.log2(F.radians(upper_arcmin / 60.0))) - coarser
    return F.pow(F.lit(2.0), F.greatest(power, F.lit(0).cast("long"))).cast("long")
