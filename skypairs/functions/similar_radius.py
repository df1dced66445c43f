"""Similar-radius cube tiling: each face is cut into four quadrants whose cells have nearly equal
inner and outer radii.

In the frame of a face a quadrant holds the directions with fixed signs of (u, v); folded to
positive signs, the lines i = const are great circles u/n = const spaced so that the spherical
triangle below the diagonal grows as i^2, and j divides the arc up to the diagonal evenly. Above
the diagonal u and v swap. Quadrants are numbered with bit 0 for v < 0 and bit 1 for u < 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cube_faces as cube
from .geometry import clamp
from .steps import Let, together

# Least inner and greatest outer pixel radius, in units of the ideal square pixel.
INNER_RADIUS, OUTER_RADIUS = 0.82, 1.1

SQRT2 = math.sqrt(2.0)


def _acos(c: Column) -> Column:
    return F.acos(clamp(c, -1.0, 1.0))


def _diagonal(g: Column) -> Column:
    """Latitude at which the line of angle g meets the diagonal."""
    return _acos(F.try_divide(F.lit(1.0), F.sin(g) * SQRT2))


def _below_diagonal(n: Column, u: Column, v: Column, half: int, let: Let, tag: str):
    """(i, j) of a folded direction, taking it to be below the diagonal."""
    g = let(f"g{tag}", _acos(F.try_divide(n, F.sqrt(n * n + u * u)) / SQRT2))
    row = let(f"row{tag}", F.sqrt(F.greatest(g - math.pi / 4, F.lit(0.0)) * (12.0 / math.pi)) * half)
    top = let(f"top{tag}", _diagonal(g))
    ratio = F.when(top > 0, F.try_divide(row * F.asin(clamp(v, -1.0, 1.0)), top)).otherwise(0.0)
    return F.floor(row), F.floor(F.least(ratio, F.lit(4.0 * half)))


def local_index(x: Column, y: Column, z: Column, nbase: int, let: Let):
    """(face, quadrant, i, j) with i and j in 0 .. N/2 - 1."""
    if nbase % 2:
        raise ValueError("the similar-radius tiling needs an even resolution")
    half = nbase // 2
    face = let("face", cube.face_of(x, y, z))
    n, u, v = together(let, "nuv", cube.face_coordinates(face, x, y, z))
    quadrant = F.when(v < 0, 1).otherwise(0) + F.when(u < 0, 2).otherwise(0)
    au, av = let("au", F.abs(u)), let("av", F.abs(v))
    i, j = (let(k, c) for k, c in zip(("i", "j"), _below_diagonal(n, au, av, half, let, "")))
    above = let("above", j > i)
    j2, i2 = (let(k, c) for k, c in zip(("j2", "i2"), _below_diagonal(n, av, au, half, let, "2")))

    def bound(c: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit(half - 1).cast("long"), c))

    return (face, quadrant, bound(F.when(above, i2).otherwise(i)), bound(F.when(above, j2).otherwise(j)))


def quadrant_to_face_bins(q: Column, i: Column, j: Column, nbase: int) -> tuple[Column, Column]:
    half = nbase // 2
    left, down = q.bitwiseAND(F.lit(2)) > 0, q.bitwiseAND(F.lit(1)) > 0
    return (F.when(left, half - 1 - i).otherwise(half + i), F.when(down, half - 1 - j).otherwise(half + j))


def face_to_quadrant_bins(i: Column, j: Column, nbase: int) -> tuple[Column, Column, Column]:
    half = nbase // 2
    left, down = i < half, j < half
    q = F.when(left, 2).otherwise(0) + F.when(down, 1).otherwise(0)
    return q, F.when(left, half - 1 - i).otherwise(i - half), F.when(down, half - 1 - j).otherwise(j - half)


def quadrant_to_face_nodes(q: Column, i: Column, j: Column, nbase: int) -> tuple[Column, Column]:
    half = nbase // 2
    left, down = q.bitwiseAND(F.lit(2)) > 0, q.bitwiseAND(F.lit(1)) > 0
    return F.when(left, half - i).otherwise(half + i), F.when(down, half - j).otherwise(half + j)


def face_to_quadrant_nodes(i: Column, j: Column, nbase: int) -> tuple[Column, Column, Column]:
    """Nodes on the middle lines belong to the left and to the lower quadrants."""
    half = nbase // 2
    left, down = i <= half, j <= half
    return (F.when(left, 2).otherwise(0) + F.when(down, 1).otherwise(0), F.abs(i - half), F.abs(j - half))


def pixel(x: Column, y: Column, z: Column, nbase: int, let: Let) -> Column:
    face, q, i, j = local_index(x, y, z, nbase, let)
    fi, fj = quadrant_to_face_bins(q, i, j, nbase)
    return cube.encode(face, fi, fj, nbase)


def node(face: Column, i: Column, j: Column, nbase: int, let: Let, tag: str = ""):
    """Grid node (i, j), both in 0 .. N, as a unit vector. The sides of the quadrants touch, so the
    signs are free where i or j is N/2."""
    half = nbase // 2
    p, q = F.abs(i - half), F.abs(j - half)
    big, small = let(f"big{tag}", F.greatest(p, q)), let(f"small{tag}", F.least(p, q))
    g = let(f"g{tag}", math.pi / 12 * (big / half) * (big / half) + math.pi / 4)
    a = let(f"a{tag}", _acos(F.cos(g) * SQRT2))
    b = let(f"b{tag}", F.when(big > 0, _diagonal(g) * small / big).otherwise(0.0))
    far, near = F.cos(b) * F.sin(a), F.sin(b)
    u, v = (let(f"u{tag}", F.when(p >= q, far).otherwise(near)),
            let(f"v{tag}", F.when(p >= q, near).otherwise(far)))
    return cube.from_face(face, F.cos(b) * F.cos(a), F.when(i < half, -u).otherwise(u),
                          F.when(j < half, -v).otherwise(v))
