"""Degrees of the proximity graph, without listing its edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.binning import Binning
from .blocks import degrees_in_blocks
from .pairs import catalogue_vectors
from .pyramid import choose_halvings, descend, distinct_positions, join_partitions

# rows in a cube from which points meet in blocks: pairs of points would be rows
DEGREE_CROWD = 64

# ids are ordered in ranges of 2**RANGE_BITS
RANGE_BITS = 16


def degrees(catalogue: DataFrame, reach_arcmin: float, ra: str = "ra", dec: str = "dec",
            id_col: str = "id", directed: bool = False, halvings: int | str = "auto",
            num_partitions: int | None = None, crowd: int = DEGREE_CROWD) -> DataFrame:
    """(id, degree) of every point with a neighbour closer than ``reach_arcmin`` (chord). Ids are unique.

    If a cube holds more than ``crowd`` rows and ids are whole numbers, points meet in blocks, and a pair of points is no row.
    Otherwise:

    Pairs of cubes that lie wholly within reach add the weight of one to all points of the other, and
    only the rest is joined point by point. Sums are kept per cube and per position until the end.

    ``directed`` counts each edge at its smaller id only. A pair of cubes within reach then adds, to each id of one, the number
    of larger ids in the other, which is read from their common order; the edges are not listed. Ids must be unique.
    """
    within = Binning.linear(0.0, reach_arcmin, 1)
    points = catalogue_vectors(catalogue.withColumnRenamed(id_col, "id"), ra, dec, keep=("id",))
    if halvings == "auto":
        halvings = choose_halvings(points, within, crowd)
    if halvings and isinstance(points.schema["id"].dataType, IntegralType):
        kind = points.schema["id"].dataType
        n = num_partitions or join_partitions(points)
        return (degrees_in_blocks(points.withColumn("id", F.col("id").cast("long")), within, directed, n)
                .withColumn("id", F.col("id").cast(kind)))
    positions = distinct_positions(points.withColumn("w", F.lit(1).cast("long")))
    tree, found, pairs = descend(positions, within, halvings, num_partitions, crowd)

    if directed:
        return _directed(points, positions, tree, found, pairs)

    near = pairs.select(F.explode(F.array(
        F.struct(*(F.col(f"{c}_a").alias(c) for c in "xyz"), F.col("w_b").alias("add")),
        F.struct(*(F.col(f"{c}_b").alias(c) for c in "xyz"), F.col("w_a").alias("add")))).alias("p"))
    sums = (near.select("p.*").groupBy("x", "y", "z").agg(F.sum("add").alias("add")))
    placed = positions
    zero = F.lit(0).cast("long")
    # copies of a position are neighbours of each other
    total = F.col("w") - 1 + F.coalesce("add", zero)
    if found is not None:
        # what the cubes gain goes down to the leaves, of which there are fewer than positions
        placed = tree.leaves()
        above = F.array(*(F.struct(F.lit(size).alias("at"), tree.key(size).alias("in")) for size in tree.sizes))
        gains = (placed.groupBy("size", "cell").agg(F.min("fine").alias("fine")).select("size", "cell", F.inline(above))
                 .where("at <= size").join(_gains(found), ["at", "in"])
                 .groupBy("size", "cell").agg(F.sum("gain").alias("gain"), F.sum("own").alias("own")))
        placed = placed.join(gains, ["size", "cell"], "left")
        total = total + F.coalesce("gain", zero) - F.coalesce("own", zero) * F.col("w")
    placed = placed.join(sums, ["x", "y", "z"], "left")
    placed = placed.withColumn("degree", total).where("degree > 0").select("x", "y", "z", "degree")
    return points.join(placed, ["x", "y", "z"]).select("id", "degree")


def _directed(points: DataFrame, positions: DataFrame, tree, found: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """(id, degree): neighbours with a larger id, from decided pairs of cubes, pairs of positions and copies of a position."""
    # two positions of one id each: the smaller id gains one
    place = ["x", "y", "z"]
    single = (F.col("w_a") == 1) & (F.col("w_b") == 1)
    at = {s: points.select(F.col("id").alias(f"id_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in place)) for s in "ab"}
    parts = [pairs.where(single).join(at["a"], [f"{c}_a" for c in place]).join(at["b"], [f"{c}_b" for c in place])
             .select(F.least("id_a", "id_b").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("add"))]

    # other pairs of positions, and the copies of one: for each position the ids of its partners
    def toward(s: str, t: str) -> Column:
        return F.struct(*(F.col(f"{c}_{s}").alias(c) for c in place), *(F.col(f"{c}_{t}").alias(f"of_{c}") for c in place))

    several = pairs.where(~single).select(F.inline(F.array(toward("a", "b"), toward("b", "a"))))
    copies = positions.where("w > 1")
    if found is not None:
        alone = (F.col("cell_a") == F.col("cell_b")) & (F.col("size_a") == F.col("size_b"))
        above = F.array(*(F.struct(F.lit(size).alias("size"), tree.key(size).alias("cell")) for size in tree.sizes))
        leaves = tree.leaves().withColumnRenamed("size", "leaf").drop("cell")
        # a cube decided with itself counts the copies in it
        whole = found.where(alone).select(F.col("size_a").alias("size"), F.col("cell_a").alias("cell"))
        counted = (leaves.where("w > 1").select(*place, "leaf", F.inline(above)).where("size <= leaf")
                   .join(whole, ["size", "cell"], "left_semi").select(*place).distinct())
        copies = copies.join(counted, place, "left_anti")
    copies = copies.select(*place, *(F.col(c).alias(f"of_{c}") for c in place))
    partners = several.unionByName(copies)
    sources = partners.join(points.select("id", *(F.col(c).alias(f"of_{c}") for c in place)), [f"of_{c}" for c in place])
    own = points.join(partners.select(*place).distinct(), place)
    parts.append(_larger(own, sources, place))

    if found is not None:
        # pairs of cubes within reach: for each cube the ids of its partners
        def beside(s: str, t: str) -> Column:
            return F.struct(*(F.col(f"{c}_{u}").alias(f"{name}{c}") for name, u in (("", s), ("of_", t)) for c in ("size", "cell")))

        partners = found.select(F.inline(F.array_compact(F.array(beside("a", "b"), F.when(~alone, beside("b", "a"))))))
        cubes = partners.select("size", "cell").union(partners.select("of_size", "of_cell")).distinct()
        members = (points.join(leaves.drop("w"), place).select("id", "leaf", F.inline(above)).where("size <= leaf").drop("leaf")
                   .join(cubes, ["size", "cell"], "left_semi"))
        sources = partners.join(members.withColumnsRenamed({"size": "of_size", "cell": "of_cell"}), ["of_size", "of_cell"])
        own = members.join(partners.select("size", "cell").distinct(), ["size", "cell"], "left_semi")
        parts.append(_larger(own, sources, ["size", "cell"]))

    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("id").agg(F.sum("add").alias("degree")).where("degree > 0")


def _larger(own: DataFrame, sources: DataFrame, target: list[str]) -> DataFrame:
    """(id, add): for each id of a target the number of its sources with a larger id.

    Ids are dealt to ranges: whole ranges above are counted, and only ids of one range are put in order, so no task
    orders all sources of a crowded target.
    """
    rows = (own.select(*target, "id", F.lit(0).cast("long").alias("source"))
            .unionByName(sources.select(*target, "id", F.lit(1).cast("long").alias("source"))))
    rows = rows.withColumn("range", F.shiftright("id", RANGE_BITS))
    higher = Window.partitionBy(*target).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    above = rows.groupBy(*target, "range").agg(F.sum("source").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(higher), F.lit(0))).drop("n")
    larger = Window.partitionBy(*target, "range").orderBy(F.desc("id")).rangeBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("inside", F.coalesce(F.sum("source").over(larger), F.lit(0))).where("source = 0").drop("source")
    return (inside.join(above, [*target, "range"]).groupBy("id").agg(F.sum(F.col("inside") + F.col("above")).alias("add")))


def _gains(found: DataFrame) -> DataFrame:
    """(at, in, gain, own): the weight each cube (size, cell) gains from the decided pairs. A pair of two cubes adds to
    both; a cube paired with itself adds its own weight, and each of its positions is taken off again (own)."""
    alone = (F.col("cell_a") == F.col("cell_b")) & (F.col("size_a") == F.col("size_b"))

    def side(s: str, n: str, own):
        return F.struct(F.col(f"size_{s}").alias("at"), F.col(f"cell_{s}").alias("in"), F.col(n).alias("gain"), own.cast("long").alias("own"))

    both = F.array(side("a", "n_b", F.when(alone, 1).otherwise(0)),
                   F.when(~alone, side("b", "n_a", F.lit(0))))
    return (found.select(F.inline(F.array_compact(both))).groupBy("at", "in")
            .agg(F.sum("gain").alias("gain"), F.max("own").alias("own")))


def degree_summary(degree: DataFrame, column: str = "degree") -> DataFrame:
    """Count, mean, sample stddev, min, max and sum of the degrees."""
    c = F.col(column)
    return degree.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("stddev"),
                      F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("total"))
