"""Sphere tilings as table operators: pixel of a point, centre, corners and neighbours of a pixel.

``tiling`` is one of ``cubedsphere``, ``similar_radius``, ``healpix`` (nested) and, for tile shapes
only, ``quadcube``. ``nbase`` is the resolution: pixels per cube side, or nside. Pixel numbers are
longs. All of it is column expressions; no Python runs on the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cube_faces, cubed_sphere, healpix, quad_cube, similar_radius
from ..functions.geometry import unit_vector, unit_vector_angles, vector_azimuth
from ..functions.steps import columns, inline, together

CUBES = {"cubedsphere": cubed_sphere, "similar_radius": similar_radius, "quadcube": quad_cube}
TILINGS = ("cubedsphere", "similar_radius", "healpix")
CORNERS = "abcd"


def _cube(tiling: str):
    if tiling not in CUBES:
        raise ValueError(f"unknown tiling {tiling!r}: use one of {', '.join((*TILINGS, 'quadcube'))}")
    return CUBES[tiling]


def n_pixels(tiling: str, nbase: int) -> int:
    if tiling == "healpix":
        return 12 * nbase * nbase
    _cube(tiling)
    return 6 * nbase * nbase


def ideal_radius(tiling: str, nbase: int) -> float:
    """Outer radius of a square of the mean pixel area."""
    return math.sqrt(4.0 * math.pi / n_pixels(tiling, nbase) / 2.0)


def _check_assignable(tiling: str, nbase: int) -> None:
    if tiling not in TILINGS:
        raise ValueError(f"no pixel assignment for tiling {tiling!r}: use one of {', '.join(TILINGS)}")
    if nbase < 1 or (tiling == "similar_radius" and nbase % 2):
        raise ValueError("resolution must be positive, and even for the similar-radius tiling")


def _pixel(tiling, nbase, theta, phi, let):
    _check_assignable(tiling, nbase)
    if tiling == "healpix":
        return healpix.pixel(F.cos(theta), phi, nbase, let)
    x, y, z = together(let, "xyz", unit_vector(theta, phi))
    return CUBES[tiling].pixel(x, y, z, nbase, let)


def pixel_of(tiling: str, nbase: int, theta: Column, phi: Column) -> Column:
    """Pixel number as one Column, for use in select, where and groupBy."""
    return _pixel(tiling, nbase, theta, phi, inline)


def assign_pixel(df: DataFrame, tiling: str, nbase: int, theta: str = "theta", phi: str = "phi",
                 out: str = "ipix") -> DataFrame:
    """Add the pixel number of every row; intermediate results are worked out once per row."""
    let = columns(df, "pix")
    ipix = _pixel(tiling, nbase, F.col(theta), F.col(phi), let)
    return let.finish(**{out: ipix})


def assign_pixels(df: DataFrame, tiling: str, resolutions: list[int], theta: str = "theta",
                  phi: str = "phi") -> DataFrame:
    """One pixel column id<nbase> per resolution. HEALPix pixels are nested: only those of the finest resolution are worked
    out from the angles, and the others are the upper bits of their numbers."""
    if tiling == "healpix" and resolutions and all(n > 0 and n & (n - 1) == 0 for n in resolutions):
        finest = max(resolutions)
        df = assign_pixel(df, tiling, finest, theta, phi, "_finest")
        return df.withColumns({f"id{n}": coarser_pixel(F.col("_finest"), finest, n) for n in resolutions}).drop("_finest")
    for nbase in resolutions:
        df = assign_pixel(df, tiling, nbase, theta, phi, f"id{nbase}")
    return df


def coarser_pixel(ipix: Column, finest: int, nbase: int) -> Column:
    """The HEALPix pixel (nested) that holds a pixel of a finer resolution; both are powers of two."""
    return F.shiftright(ipix, 2 * (finest.bit_length() - nbase.bit_length()))


def local_index(df: DataFrame, nbase: int, theta: str = "theta", phi: str = "phi") -> DataFrame:
    """Similar-radius (face, quadrant, i, j) of every row."""
    let = columns(df, "loc")
    xyz = together(let, "xyz", unit_vector(F.col(theta), F.col(phi)))
    face, q, i, j = similar_radius.local_index(*xyz, nbase, let)
    return let.finish(face=face, quadrant=q, i=i, j=j)


def with_face(df: DataFrame, theta: str = "theta", phi: str = "phi", out: str = "face") -> DataFrame:
    let = columns(df, "face")
    x, y, z = together(let, "xyz", unit_vector(F.col(theta), F.col(phi)))
    return let.finish(**{out: cube_faces.face_of(x, y, z)})


def with_decoded(df: DataFrame, nbase: int, ipix: str = "ipix", tiling: str = "cubedsphere") -> DataFrame:
    """Add face, i and j of a pixel number; all cube tilings share theirs, HEALPix has its own."""
    if tiling == "healpix":
        face, i, j = (c.cast("int") for c in healpix.decode(F.col(ipix), nbase, inline))
    else:
        face, i, j = cube_faces.decode(F.col(ipix), nbase)
    return df.withColumns({"face": face, "i": i, "j": j})


def _corner_vectors(tiling, nbase, ipix, let):
    if tiling == "healpix":
        face, ix, iy = healpix.decode(ipix, nbase, let)
        out = []
        # north, west, south and east corners, in this order
        for k, (dx, dy) in zip(CORNERS, ((1, 1), (0, 1), (0, 0), (1, 0))):
            z, phi = healpix.place(face, (ix + dx) / nbase, (iy + dy) / nbase, let, k)
            out.append(healpix.vector(z, phi))
    else:
        module = _cube(tiling)
        face, i, j = together(let, ("face", "ci", "cj"), cube_faces.decode(ipix, nbase))
        out = [module.node(face, i + di, j + dj, nbase, let, k)
               for k, (di, dj) in zip(CORNERS, ((0, 0), (1, 0), (1, 1), (0, 1)))]
    flat = together(let, (f"{k}_{n}" for k in CORNERS for n in "xyz"), [c for p in out for c in p])
    return [tuple(flat[at:at + 3]) for at in range(0, 12, 3)]


def _centre_vector(tiling, nbase, ipix, let):
    if tiling == "healpix":
        face, ix, iy = healpix.decode(ipix, nbase, let)
        z, phi = healpix.place(face, (ix + 0.5) / nbase, (iy + 0.5) / nbase, let, "cen")
        return healpix.vector(z, phi)
    corners = _corner_vectors(tiling, nbase, ipix, let)
    return mean_direction(corners, let)


def mean_direction(corners, let):
    s = together(let, ("sx", "sy", "sz"), [(c[0] + c[1] + c[2] + c[3]) / 4.0 for c in zip(*corners)])
    r = let("sr", F.sqrt(s[0] * s[0] + s[1] * s[1] + s[2] * s[2]))
    return tuple(c / r for c in s)


def pixel_corners(df: DataFrame, tiling: str, nbase: int, ipix: str = "ipix") -> DataFrame:
    """Add ``corners``: four structs (x, y, z), in order around the pixel."""
    let = columns(df, "cor")
    corners = _corner_vectors(tiling, nbase, F.col(ipix), let)
    return let.finish(corners=F.array(*(F.struct(*(c.alias(n) for n, c in zip("xyz", p)))
                                        for p in corners)))


def pixel_centre_vectors(df: DataFrame, tiling: str, nbase: int, ipix: str = "ipix",
                         names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    let = columns(df, "cen")
    return let.finish(**dict(zip(names, _centre_vector(tiling, nbase, F.col(ipix), let))))


def pixel_centres(df: DataFrame, tiling: str, nbase: int, ipix: str = "ipix", theta: str = "theta_c",
                  phi: str = "phi_c") -> DataFrame:
    """Add the angles of the pixel centre."""
    let = columns(df, "cen")
    if tiling == "healpix":
        face, ix, iy = healpix.decode(F.col(ipix), nbase, let)
        z, azimuth = healpix.place(face, (ix + 0.5) / nbase, (iy + 0.5) / nbase, let, "cen")
        return let.finish(**{theta: F.acos(z), phi: azimuth})
    x, y, z = _centre_vector(tiling, nbase, F.col(ipix), let)
    t, _ = unit_vector_angles(x, y, z)
    return let.finish(**{theta: t, phi: vector_azimuth(x, y)})


def pixel_centre_of(tiling: str, nbase: int, ipix: Column) -> Column:
    """Struct (x, y, z) of the pixel centre as one Column."""
    xyz = _centre_vector(tiling, nbase, ipix, inline)
    return F.struct(*(c.alias(n) for n, c in zip("xyz", xyz)))


def _neighbours(tiling, nbase, ipix, let):
    if tiling == "healpix":
        return healpix.neighbours(ipix, nbase, let)
    if tiling == "quadcube":
        raise ValueError("no neighbours for the quadcube")
    _cube(tiling)
    return cube_faces.neighbours(ipix, nbase, let)


def neighbours_of(tiling: str, nbase: int, ipix: Column) -> Column:
    return _neighbours(tiling, nbase, ipix, inline)


def neighbours(df: DataFrame, tiling: str, nbase: int, ipix: str = "ipix", out: str = "neighbours",
               pad: bool = False) -> DataFrame:
    """Add the array of neighbouring pixels; ``pad`` fills it up to eight entries with -1."""
    let = columns(df, "nb")
    around = let("all", _neighbours(tiling, nbase, F.col(ipix), let))
    if pad:
        around = F.concat(around, F.array_repeat(F.lit(-1).cast("long"), F.lit(8) - F.size(around)))
    return let.finish(**{out: around})


def explode_neighbours(df: DataFrame, tiling: str, nbase: int, ipix: str = "ipix",
                       out: str = "neighbour", with_self: bool = False) -> DataFrame:
    """One row per neighbouring pixel (and per pixel itself), other columns repeated."""
    df = neighbours(df, tiling, nbase, ipix, "_around")
    around = F.concat(F.array(F.col(ipix)), F.col("_around")) if with_self else F.col("_around")
    return df.withColumn(out, F.explode(around)).drop("_around")


def ring_table(pixels: DataFrame, tiling: str, nbase: int, rings: int, reach: float | None = None) -> DataFrame:
    """(ipix, at): each of the given pixels with itself and all pixels up to the ``rings``-th ring around it, by expanding
    rings one after another. With ``reach`` (a chord) those are left out that lie farther away from the pixel as a whole."""
    around = pixels.select("ipix").distinct().withColumn("at", F.col("ipix"))
    for _ in range(rings):
        around = explode_neighbours(around, tiling, nbase, "at", "next", with_self=True).select("ipix", F.col("next").alias("at")).distinct()
    if reach is None:
        return around
    both = pixel_centre_vectors(pixel_centre_vectors(around, tiling, nbase, "ipix", ("_x", "_y", "_z")), tiling, nbase, "at", ("_u", "_v", "_w"))
    far = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(("_x", "_y", "_z"), ("_u", "_v", "_w"))), F.lit(0.0))
    # no point of a pixel is farther from its centre than twice the ideal radius
    most = reach + 4.0 * ideal_radius(tiling, nbase)
    return both.where(far <= most * most).select("ipix", "at")


def pixel_table(spark: SparkSession, tiling: str, nbase: int, partitions: int | None = None) -> DataFrame:
    """All valid pixel numbers of a tiling (those of the cube tilings are not contiguous)."""
    rows = spark.range(0, n_pixels(tiling, nbase), 1, partitions)
    return rows.select((F.col("id") if tiling == "healpix"
                        else cube_faces.pixel_number(F.col("id"), nbase)).alias("ipix"))
