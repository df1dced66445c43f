"""What the cube-based tilings share: faces, pixel numbers and neighbours.

Each face has a frame (normal, right, up). ``i`` counts along right, ``j`` along up, and a pixel is
numbered (i * N + j) * 10 + face, so numbers are not contiguous.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .steps import Let, together

# The frame (normal, right, up) of faces 0 to 5.
FACE_FRAMES = (
    ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
    ((0, 1, 0), (-1, 0, 0), (0, 0, 1)),
    ((-1, 0, 0), (0, -1, 0), (0, 0, 1)),
    ((0, -1, 0), (1, 0, 0), (0, 0, 1)),
    ((0, 0, 1), (0, 1, 0), (-1, 0, 0)),
    ((0, 0, -1), (0, 1, 0), (1, 0, 0)),
)
# The order in which neighbours are listed, as (di, dj).
NEIGHBOUR_OFFSETS = ((0, 1), (0, -1), (1, 0), (1, 1), (1, -1), (-1, 0), (-1, 1), (-1, -1))


def _dot(u, v) -> int:
    return sum(p * q for p, q in zip(u, v))


def _along(v, xyz) -> Column:
    axis = next(a for a in range(3) if v[a])
    return xyz[axis] if v[axis] > 0 else -xyz[axis]


def _by_face(face: Column, values: list) -> Column:
    out = F.when(face == 0, values[0])
    for f in range(1, 5):
        out = out.when(face == f, values[f])
    return out.otherwise(values[5])


def face_of(x: Column, y: Column, z: Column) -> Column:
    """Face whose normal is closest to the direction; ties go to the lower axis."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    return (F.when((ax >= ay) & (ax >= az), F.when(x > 0, 0).otherwise(2))
            .when(ay >= az, F.when(y > 0, 1).otherwise(3))
            .otherwise(F.when(z > 0, 4).otherwise(5)))


def face_coordinates(face: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(n, u, v): the vector seen in the frame of its face."""
    xyz = (x, y, z)
    return tuple(_by_face(face, [_along(frame[k], xyz) for frame in FACE_FRAMES]) for k in range(3))


def from_face(face: Column, n: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    nuv = (n, u, v)
    return tuple(_by_face(face, [next(w if e[a] > 0 else -w for e, w in zip(frame, nuv) if e[a])
                                 for frame in FACE_FRAMES]) for a in range(3))


def encode(face: Column, i: Column, j: Column, nbase: int) -> Column:
    return (i.cast("long") * nbase + j.cast("long")) * 10 + face.cast("long")


def decode(ipix: Column, nbase: int) -> tuple[Column, Column, Column]:
    # whole division of longs: as doubles, numbers above 2^53 would be rounded
    ipix = ipix.cast("long")
    ij = F.call_function("div", ipix, F.lit(10).cast("long"))
    i = F.call_function("div", ij, F.lit(nbase).cast("long"))
    return (ipix % 10).cast("int"), i.cast("int"), (ij % nbase).cast("int")


def is_valid(ipix: Column, nbase: int) -> Column:
    face, i, j = decode(ipix, nbase)
    return (ipix >= 0) & (face < 6) & (i < nbase) & (j < nbase)


def _crossing(f: int, axis: int, sign: int, nbase: int) -> tuple[int, int]:
    """Stepping off face f over its right (axis 1) or up (axis 2) side, or the opposite one: the new
    pixel number is c0 + c1 * t, where t is the index along the side."""
    frame = FACE_FRAMES[f]
    out = tuple(sign * c for c in frame[axis])
    g = next(k for k in range(6) if FACE_FRAMES[k][0] == out)
    index = []
    for e in FACE_FRAMES[g][1:]:
        back, side = _dot(e, frame[0]), _dot(e, frame[3 - axis])
        if back:
            index.append((nbase - 1, 0) if back > 0 else (0, 0))
        else:
            index.append((0, 1) if side > 0 else (nbase - 1, -1))
    (i0, i1), (j0, j1) = index
    return (i0 * nbase + j0) * 10 + g, (i1 * nbase + j1) * 10


def neighbours(ipix: Column, nbase: int, let: Let) -> Column:
    """Pixel numbers around a pixel: eight, or seven at a cube corner."""
    face, i, j = together(let, "fij", decode(ipix, nbase))
    sides = [(axis, sign) for axis in (1, 2) for sign in (1, -1)]
    tables = [c for axis, sign in sides
              for c in zip(*(_crossing(f, axis, sign, nbase) for f in range(6)))]
    found = together(let, (f"c{k}" for k in range(8)),
                     [F.get(F.array(*(F.lit(v).cast("long") for v in c)), face) for c in tables])
    over = dict(zip(sides, zip(found[::2], found[1::2])))
    out = []
    for di, dj in NEIGHBOUR_OFFSETS:
        plain = ipix + (di * nbase + dj) * 10
        leaves_i = (i == (nbase - 1 if di > 0 else 0)) if di else F.lit(False)
        leaves_j = (j == (nbase - 1 if dj > 0 else 0)) if dj else F.lit(False)
        choice = F.when(leaves_i & leaves_j, F.lit(None).cast("long"))
        if di:
            c0, c1 = over[1, di]
            choice = choice.when(leaves_i, c0 + c1 * (j + dj))
        if dj:
            c0, c1 = over[2, dj]
            choice = choice.when(leaves_j, c0 + c1 * (i + di))
        out.append(choice.otherwise(plain))
    return F.array_compact(F.array_distinct(F.array(*out)))


def pixel_number(row: Column, nbase: int) -> Column:
    """The valid pixel numbers, one for each row number 0 .. 6 N^2 - 1."""
    return F.floor(row / 6) * 10 + row % 6
