"""HEALPix pixels in the nested scheme, from the published definition of the projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import TWO_PI
from .steps import Let, together

# Least inner and greatest outer pixel radius, in units of the ideal square pixel.
INNER_RADIUS, OUTER_RADIUS = 0.65, 1.48
# Ring (in units of nside) and azimuth (in units of pi/4) of the southern corner of
# each base face.
FACE_RING = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
FACE_AZIMUTH = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)
# The order in which neighbours are listed, as steps in x and in y.
NEIGHBOUR_X = (-1, -1, 0, 1, 1, 1, 0, -1)
NEIGHBOUR_Y = (0, 1, 1, 1, 0, -1, -1, -1)
# Face reached from each base face, by direction (south to north, 4 = stay).
FACE_REACHED = (
    (8, 9, 10, 11, -1, -1, -1, -1, 10, 11, 8, 9),
    (5, 6, 7, 4, 8, 9, 10, 11, 9, 10, 11, 8),
    (-1, -1, -1, -1, 5, 6, 7, 4, -1, -1, -1, -1),
    (4, 5, 6, 7, 11, 8, 9, 10, 11, 8, 9, 10),
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11),
    (1, 2, 3, 0, 0, 1, 2, 3, 5, 6, 7, 4),
    (-1, -1, -1, -1, 7, 4, 5, 6, -1, -1, -1, -1),
    (3, 0, 1, 2, 3, 0, 1, 2, 4, 5, 6, 7),
    (2, 3, 0, 1, -1, -1, -1, -1, 0, 1, 2, 3),
)
# How the axes turn on the way, by direction and by row of base faces
# (1: flip x, 2: flip y, 4: swap x and y).
AXES_TURNED = ((0, 0, 3), (0, 0, 6), (0, 0, 0), (0, 0, 5), (0, 0, 0), (5, 0, 0), (0, 0, 0), (6, 0, 0),
               (3, 0, 0))


def order(nside: int) -> int:
    k = nside.bit_length() - 1
    if nside < 1 or 1 << k != nside:
        raise ValueError("nside must be a power of two")
    return k


def _lookup(values, index: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), index.cast("int"))


def _bits_apart(c: Column, bits: int) -> Column:
    """Bit b to bit 2 b: the binary digits, read to base four."""
    return F.conv(F.bin(c.cast("long")), 2 * 2, 10).cast("long") if bits else F.lit(0).cast("long")


def _bits_together(c: Column, bits: int) -> Column:
    """Bit 2 b to bit b: the even bits have base-four digits 0 and 1, which are read as binary."""
    even = c.cast("long").bitwiseAND(F.lit(sum(1 << 2 * b for b in range(bits))).cast("long"))
    return F.conv(F.conv(even.cast("string"), 10, 4), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def encode(face: Column, ix: Column, iy: Column, nside: int) -> Column:
    k = order(nside)
    ix, iy = ix.cast("long"), iy.cast("long")
    return (face.cast("long") * (nside * nside) + _bits_apart(ix, k)
            + F.shiftleft(_bits_apart(iy, k), 1))


def decode(ipix: Column, nside: int, let: Let) -> tuple[Column, Column, Column]:
    k = order(nside)
    face = let("face", F.shiftright(ipix.cast("long"), 2 * k))
    inner = let("inner", ipix.cast("long").bitwiseAND(F.lit(nside * nside - 1).cast("long")))
    return (face, let("ix", _bits_together(inner, k)),
            let("iy", _bits_together(F.shiftright(inner, 1), k)))


def pixel(z: Column, phi: Column, nside: int, let: Let) -> Column:
    """Pixel of the direction with cosine of colatitude z and azimuth phi."""
    za = let("za", F.abs(z))
    tt = let("tt", F.pmod(phi, F.lit(TWO_PI)) / (math.pi / 2))
    # around the equator: two families of lines
    t1, t2 = (tt + 0.5) * nside, z * (0.75 * nside)
    jp, jm = let("jp", F.floor(t1 - t2)), let("jm", F.floor(t1 + t2))
    fp, fm = let("fp", F.floor(jp / nside)), let("fm", F.floor(jm / nside))
    belt_face = (F.when(fp == fm, fp.bitwiseOR(F.lit(4).cast("long")))
                 .when(fp < fm, fp).otherwise(fm + 8))
    # around the poles: distances from both sides of the quarter
    quarter = let("quarter", F.least(F.lit(3).cast("long"), F.floor(tt)))
    tp = let("tp", tt - quarter)
    tm = let("tm", F.sqrt(F.greatest(F.lit(0.0), (1.0 - za) * 3.0)) * nside)
    cp = let("cp", F.least(F.floor(tp * tm), F.lit(nside - 1).cast("long")))
    cm = let("cm", F.least(F.floor((1.0 - tp) * tm), F.lit(nside - 1).cast("long")))
    belt, north = za <= 2.0 / 3.0, z >= 0
    face = let("face", F.when(belt, belt_face).when(north, quarter).otherwise(quarter + 8))
    ix = let("ix", F.when(belt, F.pmod(jm, F.lit(nside))).when(north, nside - 1 - cm).otherwise(cp))
    iy = let("iy", F.when(belt, nside - 1 - F.pmod(jp, F.lit(nside))).when(north, nside - 1 - cp)
             .otherwise(cm))
    return encode(face, ix, iy, nside)


def place(face: Column, x: Column, y: Column, let: Let, tag: str = "") -> tuple[Column, Column]:
    """(z, phi) of the place (x, y), both in 0 .. 1, on a base face."""
    j = let(f"j{tag}", _lookup(FACE_RING, face) - x - y)
    nr = let(f"nr{tag}", F.when(j < 1, j).when(j > 3, 4.0 - j).otherwise(1.0))
    z = let(f"z{tag}", F.when(j < 1, 1.0 - nr * nr / 3.0).when(j > 3, nr * nr / 3.0 - 1.0)
            .otherwise((2.0 - j) * 2.0 / 3.0))
    turn = F.pmod(_lookup(FACE_AZIMUTH, face) * nr + x - y, F.lit(8.0))
    return z, let(f"phi{tag}", F.when(nr > 0, turn / F.when(nr > 0, nr) * (math.pi / 4)).otherwise(0.0))


def vector(z: Column, phi: Column) -> tuple[Column, Column, Column]:
    s = F.sqrt(F.greatest(F.lit(0.0), (1.0 - z) * (1.0 + z)))
    return s * F.cos(phi), s * F.sin(phi), z


def neighbours(ipix: Column, nside: int, let: Let) -> Column:
    """Eight entries around a pixel; null where a base face has no face in that direction."""
    face, ix, iy = decode(ipix, nside, let)
    k8 = range(8)
    xs, ys = [ix + d for d in NEIGHBOUR_X], [iy + d for d in NEIGHBOUR_Y]

    def side(c: Column) -> Column:
        return F.when(c < 0, -1).when(c >= nside, 1).otherwise(0)

    ways = together(let, (f"way{k}" for k in k8), [side(x) + side(y) * 3 + 4 for x, y in zip(xs, ys)])
    reached = [f for row in FACE_REACHED for f in row]
    turned = [t for row in AXES_TURNED for t in row]
    to = together(let, (f"to{k}" for k in k8), [_lookup(reached, w * 12 + face) for w in ways])
    turns = together(let, (f"turn{k}" for k in k8),
                     [_lookup(turned, w * 3 + F.shiftright(face, 2)) for w in ways])

    def flip(c: Column, turn: Column, bit: int) -> Column:
        c = F.pmod(c, F.lit(nside))
        return F.when(turn.bitwiseAND(F.lit(bit)) > 0, nside - 1 - c).otherwise(c)

    xs = together(let, (f"x{k}" for k in k8), [flip(x, t, 1) for x, t in zip(xs, turns)])
    ys = together(let, (f"y{k}" for k in k8), [flip(y, t, 2) for y, t in zip(ys, turns)])
    swaps = [t.bitwiseAND(F.lit(4)) > 0 for t in turns]
    sx = together(let, (f"sx{k}" for k in k8), [F.when(s, y).otherwise(x) for s, x, y in zip(swaps, xs, ys)])
    sy = together(let, (f"sy{k}" for k in k8), [F.when(s, x).otherwise(y) for s, x, y in zip(swaps, xs, ys)])
    out = together(let, (f"n{k}" for k in k8),
                   [F.when(t >= 0, encode(t, x, y, nside)) for t, x, y in zip(to, sx, sy)])
    return F.array_compact(F.array(*out))
