"""Quadrilateralized sphere cube: a square grid on each face, bent by a polynomial so that pixels
have nearly equal areas. Only its grid nodes are needed, for comparing tile shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cube_faces as cube
from .steps import Let

# The published coefficients of the quadrilateralized cube, by growing degree in
# (x^2, y^2) and, within a degree, by growing power of the second variable.
COEFFICIENTS = (
    -0.27292696,
    -0.07629969, -0.02819452,
    -0.22797056, -0.01471565, 0.27058160,
    0.54852384, 0.48051509, -0.56800938, -0.60441560,
    -0.62930065, -1.74114454, 0.30803317, 1.50880086, 0.93412077,
    0.25795794, 1.71547508, 0.98938102, -0.93678576, -1.41601920, -0.63915306,
    0.02584375, -0.53022337, -0.83180469, 0.08693841, 0.33887446, 0.52032238, 0.14381585,
)


def _bend(s: Column, t: Column) -> Column:
    """The bent coordinate of s, given the square of itself and of the other one."""
    rows, at = [], 0
    for degree in range(7):
        rows.append(COEFFICIENTS[at:at + degree + 1])
        at += degree + 1
    # Horner in t, each coefficient being a Horner polynomial in s
    total = None
    for power in range(6, -1, -1):
        inner = None
        for degree in range(6, power - 1, -1):
            c = F.lit(rows[degree][power])
            inner = c if inner is None else c + s * inner
        total = inner if total is None else inner + t * total
    return 1.0 + (1.0 - s) * total


def node(face: Column, i: Column, j: Column, nbase: int, let: Let, tag: str = ""):
    """Grid node (i, j), both in 0 .. N, as a unit vector."""
    x, y = let(f"x{tag}", i * (2.0 / nbase) - 1.0), let(f"y{tag}", j * (2.0 / nbase) - 1.0)
    xx, yy = let(f"xx{tag}", x * x), let(f"yy{tag}", y * y)
    u, v = let(f"u{tag}", x * _bend(xx, yy)), let(f"v{tag}", y * _bend(yy, xx))
    r = let(f"r{tag}", F.sqrt(1.0 + u * u + v * v))
    return cube.from_face(face, 1.0 / r, u / r, v / r)
