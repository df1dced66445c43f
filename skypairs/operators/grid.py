"""Cube grid over the unit sphere: the default join key of every distance search.

Space is cut into cubes whose edge is at least the search radius, so two points within the radius
lie in the same cube or in touching cubes: the cover is complete by construction. A cube is one
long, 21 bits per axis, and halving the edge ``k`` times gives a nested grid whose parent keys are
bit shifts of the child keys.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXIS_BITS = 21
# room for rounding: the cube edge exceeds the radius by this relative amount
SLACK = 1e-9
# half of the 26 touching cubes, so that each pair of cubes is visited from one side only
HALF_OFFSETS = tuple(d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0))


def top_edge(reach: float) -> float:
    """Edge of the cubes for a reach. Below a reach of 2**-19 it stays there: an axis has no room for more cubes, and
    larger ones still cover."""
    return max(reach * (1.0 + SLACK), 2.0 / 2 ** (AXIS_BITS - 1))


def finest_bits(edge: float) -> int:
    """How often ``edge`` can be halved before an axis index needs more than its 21 bits."""
    bits = 0
    while 2.0 / (edge / 2 ** (bits + 1)) < 2 ** (AXIS_BITS - 1):
        bits += 1
    return bits


def axis_index(c: Column, edge: float) -> Column:
    # coalesce: coordinates are not null, and a key that may be null gets a null test in every join
    return F.coalesce(F.floor((c + 1.0) / edge), F.lit(0).cast("long"))


def pack(ix: Column, iy: Column, iz: Column) -> Column:
    return F.shiftleft(ix, 2 * AXIS_BITS).bitwiseOR(F.shiftleft(iy, AXIS_BITS)).bitwiseOR(iz)


def key_step(offset: tuple[int, int, int]) -> int:
    dx, dy, dz = offset
    return (dx << 2 * AXIS_BITS) + (dy << AXIS_BITS) + dz


def cell_key(x: Column, y: Column, z: Column, edge: float) -> Column:
    return pack(axis_index(x, edge), axis_index(y, edge), axis_index(z, edge))


def parent_key(key: Column, bits: int) -> Column:
    """Key of the cube with an edge 2**bits times longer."""
    if bits == 0:
        return key
    field = (1 << (AXIS_BITS - bits)) - 1
    mask = (field << 2 * AXIS_BITS) | (field << AXIS_BITS) | field
    return F.shiftright(key, bits).bitwiseAND(F.lit(mask).cast("long"))


def spread_to_touching(df: DataFrame, edge: float, reach: float) -> DataFrame:
    """Repeat each point (x, y, z) for its own cube and for the half neighbourhood that may hold a
    partner. Adds ``own``, the cube of the point, and ``cell``, the cube it is sent to.

    A touching cube is left out when the point is farther than ``reach`` from it, or when no part of
    it meets the unit sphere. The test runs before the shuffle.
    """
    low = {f"_low_{c}": axis_index(F.col(c), edge) * edge - 1.0 for c in "xyz"}
    steps = F.array(*(F.struct(*(F.lit(v).alias(f"d{c}") for v, c in zip(d, "xyz")),
                               F.lit(key_step(d)).cast("long").alias("step"))
                      for d in ((0, 0, 0), *HALF_OFFSETS)))
    gap2 = near2 = far2 = F.lit(0.0)
    for c in "xyz":
        d, lo = F.col(f"_to.d{c}"), F.col(f"_low_{c}")
        gap = F.when(d > 0, lo + edge - F.col(c)).when(d < 0, F.col(c) - lo).otherwise(0.0)
        side = lo + d * edge
        near = F.greatest(side, -(side + edge), F.lit(0.0))
        far = F.greatest(F.abs(side), F.abs(side + edge))
        gap2, near2, far2 = gap2 + gap * gap, near2 + near * near, far2 + far * far
    keep = (gap2 <= reach * reach * (1.0 + 1e-6)) & (near2 <= 1.0 + 1e-6) & (far2 >= 1.0 - 1e-6)
    return (df.withColumns({"own": cell_key(F.col("x"), F.col("y"), F.col("z"), edge), **low})
            .withColumn("_to", F.explode(steps)).where(keep)
            .withColumn("cell", F.col("own") + F.col("_to.step")).drop("_to", *low))


def with_cell(df: DataFrame, edge: float, name: str = "cell") -> DataFrame:
    return df.withColumn(name, cell_key(F.col("x"), F.col("y"), F.col("z"), edge))
