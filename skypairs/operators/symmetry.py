"""Shapes of all pixels of a tiling from one pixel of each symmetry orbit.

The faces of the cube tilings are congruent, and each looks the same mirrored at its middle lines and at its diagonal: an
eighth of one face tells all six. Of HEALPix, half of one polar face and a quarter of one face on the equator do. Area and
radii are the same all over an orbit; the ellipticity of the cube tilings changes its sign with each mirroring at a middle
line, because that swaps the diagonals of a pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cube_faces, healpix
from ..functions.steps import inline
from . import tiles
from .quality import tile_geometry


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _once_if(same: Column) -> Column:
    """The steps of a mirroring: only none (0) where it maps the pixel to itself, else none or one."""
    return F.when(same, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))


def representative(tiling: str, nbase: int, ipix: Column) -> tuple[Column, Column]:
    """The pixel that stands for a pixel's orbit, and whether an odd number of mirrorings at middle lines lies between."""
    last = nbase - 1
    if tiling == "healpix":
        face, x, y = healpix.decode(ipix, nbase, inline)
        belt = (face >= 4) & (face < 8)
        south = (face >= 8) | (belt & (x + y > last))
        u, v = F.when(south, last - y).otherwise(x), F.when(south, last - x).otherwise(y)
        return (healpix.encode(F.when(belt, 4).otherwise(0), F.greatest(u, v), F.least(u, v), nbase), F.lit(False))
    _, i, j = cube_faces.decode(ipix, nbase)
    a, b = F.least(i, last - i), F.least(j, last - j)
    return (cube_faces.encode(F.lit(0), F.greatest(a, b), F.least(a, b), nbase), (i * 2 > last) != (j * 2 > last))


def orbits(spark: SparkSession, tiling: str, nbase: int, partitions: int | None = None) -> DataFrame:
    """(ipix, size): the pixel that stands for each orbit, and how many pixels the orbit has."""
    last = nbase - 1
    twice_unless = lambda same: F.when(same, _long(1)).otherwise(_long(2))
    side = nbase if tiling == "healpix" else (nbase + 1) // 2
    kinds = 2 if tiling == "healpix" else 1
    at = spark.range(0, kinds * side * side, 1, partitions).select(
        F.expr(f"id div {side * side}").alias("belt"), F.expr(f"id div {side} % {side}").alias("a"), F.expr(f"id % {side}").alias("b"))
    at = at.where("b <= a")
    a, b, belt = F.col("a"), F.col("b"), F.col("belt") == 1
    if tiling == "healpix":
        at = at.where(~belt | (a + b <= last))
        size = twice_unless(a == b) * F.when(belt & (a + b == last), _long(4)).otherwise(_long(8))
        return at.select(healpix.encode(F.when(belt, 4).otherwise(0), a, b, nbase).alias("ipix"), size.alias("size"))
    size = twice_unless(a == b) * twice_unless(a * 2 == last) * twice_unless(b * 2 == last) * 6
    return at.select(cube_faces.encode(F.lit(0), a, b, nbase).alias("ipix"), size.alias("size"))


def images(df: DataFrame, tiling: str, nbase: int, ipix: str = "ipix", out: str = "image", odd: str = "mirrored") -> DataFrame:
    """One row for each pixel of the orbits whose representatives are in ``ipix``; ``odd`` as in ``representative``."""
    last = nbase - 1
    if tiling == "healpix":
        face, x, y = healpix.decode(F.col(ipix), nbase, inline)
        df = df.withColumns({"_f": face, "_x": x, "_y": y})
        x, y = F.col("_x"), F.col("_y")
        belt = F.col("_f") == 4
        df = (df.withColumn("_swap", F.explode(_once_if(x == y))).withColumn("_south", F.explode(_once_if(belt & (x + y == last))))
              .withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(3)))))
        swapped, south = F.col("_swap") == 1, F.col("_south") == 1
        u, v = F.when(swapped, y).otherwise(x), F.when(swapped, x).otherwise(y)
        to = F.when(belt, F.col("_turn") + 4).when(south, F.col("_turn") + 8).otherwise(F.col("_turn"))
        image = healpix.encode(to, F.when(south, last - v).otherwise(u), F.when(south, last - u).otherwise(v), nbase)
        return df.withColumns({out: image, odd: F.lit(False)}).drop("_f", "_x", "_y", "_swap", "_south", "_turn")
    _, a, b = cube_faces.decode(F.col(ipix), nbase)
    df = df.withColumns({"_a": a, "_b": b})
    a, b = F.col("_a"), F.col("_b")
    df = (df.withColumn("_swap", F.explode(_once_if(a == b))).withColumn("_right", F.explode(_once_if(a * 2 == last)))
          .withColumn("_up", F.explode(_once_if(b * 2 == last))).withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(5)))))
    # mirrored first, then swapped
    p = F.when(F.col("_right") == 1, last - a).otherwise(a)
    q = F.when(F.col("_up") == 1, last - b).otherwise(b)
    swapped = F.col("_swap") == 1
    image = cube_faces.encode(F.col("_f"), F.when(swapped, q).otherwise(p), F.when(swapped, p).otherwise(q), nbase)
    return df.withColumns({out: image, odd: F.col("_right") != F.col("_up")}).drop("_a", "_b", "_swap", "_right", "_up", "_f")


def whole_geometry(spark: SparkSession, tiling: str, nbase: int, partitions: int | None = None) -> DataFrame:
    """``tile_geometry`` of all pixels of a tiling, worked out for one pixel of each orbit; no join or shuffle."""
    one = tile_geometry(orbits(spark, tiling, nbase, partitions), tiling, nbase)
    return images(one, tiling, nbase).select(
        F.col("image").alias("ipix"), "area",
        F.when(F.col("mirrored"), -F.col("ellipticity")).otherwise(F.col("ellipticity")).alias("ellipticity"), "outer", "inner")


def points_by_orbit(pixels: DataFrame, tiling: str, nbase: int, ipix: str = "ipix") -> DataFrame:
    """Rows (one per point, with its pixel) counted by orbit, and the orbit's shape without the ellipticity: ipix (the
    representative), n, area, outer, inner. At most a 48th of the pixels of a cube tiling, and no join."""
    stands, _ = representative(tiling, nbase, F.col(ipix))
    counts = pixels.select(stands.alias("ipix")).groupBy("ipix").agg(F.count(F.lit(1)).alias("n"))
    return tile_geometry(counts, tiling, nbase).select("ipix", "n", "area", "outer", "inner")


def n_orbits(tiling: str, nbase: int) -> int:
    """Number of rows of ``orbits``."""
    if tiling == "healpix":
        # pairs with a >= b, and those of them with a + b <= N - 1
        return nbase * (nbase + 1) // 2 + ((nbase + 1) // 2) * (nbase // 2 + 1)
    tiles.n_pixels(tiling, nbase)
    half = (nbase + 1) // 2
    return half * (half + 1) // 2
