"""Equal-angle cubed sphere: pixel sides are at equal angles seen from the centre of the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cube_faces as cube
from .steps import Let, together

# Least inner and greatest outer pixel radius, in units of the ideal square pixel.
INNER_RADIUS, OUTER_RADIUS = 0.77, 1.26


def pixel(x: Column, y: Column, z: Column, nbase: int, let: Let) -> Column:
    face = let("face", cube.face_of(x, y, z))
    n, u, v = together(let, "nuv", cube.face_coordinates(face, x, y, z))
    step = math.pi / 2 / nbase

    def index(c: Column) -> Column:
        i = F.floor((F.atan(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c / n))) + math.pi / 4) / step)
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit(nbase - 1).cast("long"), i))

    return cube.encode(face, index(u), index(v), nbase)


def node(face: Column, i: Column, j: Column, nbase: int, let: Let, tag: str = ""):
    """Grid node (i, j), both in 0 .. N, as a unit vector."""
    u, v = (F.tan(c * (math.pi / 2 / nbase) - math.pi / 4) for c in (i, j))
    u, v = let(f"u{tag}", u), let(f"v{tag}", v)
    r = let(f"r{tag}", F.sqrt(1.0 + u * u + v * v))
    return cube.from_face(face, 1.0 / r, u / r, v / r)
