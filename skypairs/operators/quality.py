"""Quality of the tilings: sampled radii, exact tile shapes, and a speed job."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import TWO_PI, chord, tangent_residuals, unit_vector
from ..functions.steps import columns
from . import tiles
from .stats import histogram, histogram2d


def random_sky(spark: SparkSession, n: int, seed: int | None = None,
               partitions: int | None = None) -> DataFrame:
    """``n`` directions (theta, phi), uniform on the sphere; with a seed the same for any number of partitions."""
    seed = random.randrange(2**31) if seed is None else seed
    return sky_of_keys(spark.range(0, n, 1, partitions), "id", seed).select("theta", "phi")


def uniform(key: Column, seed: int, draw: int = 0) -> Column:
    """A number in [0, 1) for each key: the first 52 bits of a digest of seed, draw and key. It depends on nothing else, so any
    partitioning, engine or repeated task gives the same."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.lit(draw).cast("string"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def sky_of_keys(df: DataFrame, key: str, seed: int) -> DataFrame:
    """The rows with a direction (theta, phi) drawn for each key, uniform on the sphere."""
    return df.withColumns({"theta": F.acos(uniform(F.col(key), seed) * 2.0 - 1.0), "phi": uniform(F.col(key), seed, 1) * TWO_PI})


def sample_with_centres(sky: DataFrame, tiling: str, nbase: int) -> DataFrame:
    """Points (theta, phi) with their pixel and its centre."""
    return tiles.pixel_centres(tiles.assign_pixel(sky, tiling, nbase), tiling, nbase)


def with_residuals(sample: DataFrame, tiling: str, nbase: int) -> DataFrame:
    """Add dx, dy (tangent offsets from the centre, in ideal radii) and R (chord to the centre)."""
    dx, dy = tangent_residuals(*map(F.col, ("theta", "phi", "theta_c", "phi_c")),
                               tiles.ideal_radius(tiling, nbase))
    r = chord(unit_vector(F.col("theta"), F.col("phi")), unit_vector(F.col("theta_c"), F.col("phi_c")))
    return sample.withColumns({"dx": dx, "dy": dy, "R": r})


def residual_map(residuals: DataFrame, bins: int = 200, half_width: float = 1.5) -> DataFrame:
    """2-D histogram of the residuals with log10(1 + count)."""
    box = ((-half_width, half_width), (-half_width, half_width))
    return (histogram2d(residuals, "dx", "dy", bins, bins, box)
            .withColumn("log_count", F.log10(F.col("count") + 1.0)))


def sampled_radii(residuals: DataFrame, tiling: str, nbase: int) -> DataFrame:
    """Per pixel the outer radius (largest R seen), and the inner radius of the rectangle of the mean
    area with that outer radius; both also in ideal units."""
    area = 4.0 * math.pi / tiles.n_pixels(tiling, nbase)
    ideal = tiles.ideal_radius(tiling, nbase)
    rmax, rmin = F.col("Rmax"), F.col("Rmin")
    return (residuals.groupBy("ipix").agg(F.max("R").alias("Rmax"))
            .withColumn("Rmin", F.try_divide(F.lit(area / 2.0), rmax))
            .withColumn("Rin", rmin * rmax / F.sqrt(rmin * rmin + rmax * rmax))
            .withColumns({"Rin_rel": F.col("Rin") / (ideal / math.sqrt(2.0)), "Rout_rel": rmax / ideal}))


def _height(a: Column, b: Column, base: Column) -> Column:
    """Height of the triangle with sides a, b and base over its base."""
    p = (a + b + base) / 2.0
    return F.sqrt(F.greatest(p * (p - a) * (p - b) * (p - base), F.lit(0.0))) * 2.0 / base


def tile_geometry(pixels: DataFrame, tiling: str, nbase: int, ipix: str = "ipix") -> DataFrame:
    """Exact shape of each pixel from its corners A, B, C, D: area over the mean area, ellipticity
    (p-q)/(p+q) of the diagonals, outer radius (farthest corner) and inner radius (least height of
    the triangles around the centre), in ideal units. One definition for all tilings."""
    let = columns(pixels, "geo")
    corners = tiles._corner_vectors(tiling, nbase, F.col(ipix), let)
    if tiling == "healpix":
        centre = tuple(let(f"m{n}", c) for n, c in
                       zip("xyz", tiles._centre_vector(tiling, nbase, F.col(ipix), let)))
    else:
        centre = tuple(let(f"m{n}", c) for n, c in zip("xyz", tiles.mean_direction(corners, let)))

    def d2(name, p, q):
        return let(name, sum((u - v) * (u - v) for u, v in zip(p[1:], q[1:])) + (p[0] - q[0]) * (p[0] - q[0]))

    a, b, c, d = corners
    p2, q2 = d2("p2", a, c), d2("q2", b, d)
    sides = [d2(f"side{k}", corners[k], corners[(k + 1) % 4]) for k in range(4)]
    cross = let("cross", sides[1] + sides[3] - sides[0] - sides[2])
    area = F.sqrt(p2 * q2 * 4.0 - cross * cross) / 4.0
    p, q = let("p", F.sqrt(p2)), let("q", F.sqrt(q2))
    arms = [let(f"arm{k}", F.sqrt(d2(f"arm2{k}", centre, corners[k]))) for k in range(4)]
    heights = [let(f"h{k}", _height(arms[k], arms[(k + 1) % 4], F.sqrt(sides[k]))) for k in range(4)]
    ideal = tiles.ideal_radius(tiling, nbase)
    mean_area = 4.0 * math.pi / tiles.n_pixels(tiling, nbase)
    return let.finish(area=area / mean_area, ellipticity=(p - q) / (p + q),
                      outer=F.greatest(*arms) / ideal, inner=F.least(*heights) / (ideal / math.sqrt(2.0)))


def geometry_summary(geometry: DataFrame) -> DataFrame:
    return geometry.agg(F.min("inner").alias("min_inner"), F.max("outer").alias("max_outer"))


def radius_histogram(geometry: DataFrame, column: str, bins: int = 80,
                     bounds: tuple[float, float] = (0.6, 1.5), weight: str | None = None) -> DataFrame:
    return histogram(geometry, column, bins, bounds, weight)


def occupancy(pixels: DataFrame, ipix: str = "ipix") -> DataFrame:
    return pixels.groupBy(ipix).count()


def tiling_speed(sky: DataFrame, tiling: str, nbase: int) -> DataFrame:
    """Assign, centre and neighbour every point in one pass; the one-row result keeps all of it from
    being pruned away."""
    df = tiles.neighbours(sample_with_centres(sky, tiling, nbase), tiling, nbase)
    return df.agg(F.min("ipix").alias("min_ipix"), F.max("ipix").alias("max_ipix"),
                  F.min("theta_c").alias("min_theta_c"), F.min("phi_c").alias("min_phi_c"),
                  F.min(F.size("neighbours")).alias("min_neighbours"))
