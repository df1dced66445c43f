"""Counting pairs without listing them: bulk counts over a pyramid of cubes.

The points of crowded regions are summarised by an irregular tree of cubes (weight and bounding
ball): a cube is split only while it holds more than a few positions, so the sizes built follow the
density of each region, and thin regions have the largest cubes only. Starting from pairs of large
touching cubes, the least and the greatest distance between two balls decide:

* every pair of points falls into the same separation bin -> add the product of the weights;
* no pair is in range                                     -> drop the pair of cubes;
* neither cube is split                                   -> leave the pair to its points;
* otherwise                                               -> replace each split cube by its children.

Only what is left to the points is joined point by point, with the same formula a brute-force count
uses. A dense region thus costs bulk counts, not the square of its points. The
balls are padded by far more than rounding can amount to, so a pair next to a bin edge is never
decided in bulk and the counts are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import Binning
from .blocks import count_in_blocks
from .grid import (HALF_OFFSETS, cell_key, finest_bits, key_step, parent_key,
                   spread_to_touching, top_edge, with_cell)
from .lineage import cut

# join the points of touching cubes directly while no cube holds more distinct positions than this
CROWD = 512
# otherwise halve the cubes until none holds more than this
LEAF_CROWD = 32
# parts of the points of one cube where cubes and points are joined
SALTS = 16
POINT_PAIR = [f"{c}_{s}" for s in "ab" for c in "xyzw"] + ["r2"]
# radius added to every ball, on the unit sphere; rounding errors are below 1e-14
BALL_PAD = 1e-12


def distinct_positions(points: DataFrame) -> DataFrame:
    """Merge copies at the same position into one row; partial sums run before the shuffle, so any
    number of copies of one position costs one row per input partition.

    ``points`` hold no nulls (``catalogue_vectors`` sees to that); coalesce tells Spark. Otherwise
    each join on them would push a null test of its own below this aggregation, and the shuffle
    could not be shared by its readers.
    """
    sure = points.select(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in "xyz"), "w")
    return sure.groupBy("x", "y", "z").agg(F.sum("w").alias("w"))


def useful_halvings(binning: Binning) -> int:
    """Halving the cubes pays until one fits below the smallest counted distance (its own pairs are
    then dropped in bulk); the key has room for no more than the grid's finest."""
    edge = top_edge(binning.max_chord)
    most = finest_bits(edge)
    if binning.min_chord > 0:
        most = min(most, max(0, math.ceil(math.log2(edge * math.sqrt(3.0) / binning.min_chord))))
    return most


def choose_halvings(points: DataFrame, binning: Binning, crowd: int = CROWD) -> int:
    """How often cubes may be halved: not at all if no cube of the largest size is crowded, which one counting job over the
    rows, copies included, tells; it is combined before its shuffle and brings one number to the driver."""
    key = cell_key(F.col("x"), F.col("y"), F.col("z"), top_edge(binning.max_chord))
    fullest = points.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    return useful_halvings(binning) if fullest > crowd else 0


_SIDES = [(f"{n}_{c}", c, f) for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]


def _marked(points: DataFrame, cubes: DataFrame, key: Column) -> DataFrame:
    """The points with the columns of the table of cubes (cell and flags) that hold ``key``; false where none does. The points
    are salted, so those of one crowded cube are dealt to many tasks, and the cubes are repeated for each salt."""
    flags = [c for c in cubes.columns if c != "cell"]
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    cubes = cubes.select(F.col("cell").alias("_in"), *flags, salt.alias("_to"))
    salted = points.withColumns({"_key": key, "_salt": F.pmod(F.xxhash64("x", "y", "z"), F.lit(SALTS)).cast("int")})
    found = salted.join(cubes, (F.col("_key") == F.col("_in")) & (F.col("_salt") == F.col("_to")), "left")
    return found.select(*points.columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in flags))


def _summaries(points: DataFrame, key: Column) -> DataFrame:
    """Weight and bounding box per cube, from points."""
    return points.groupBy(key.alias("cell")).agg(
        F.count(F.lit(1)).alias("m"), F.sum("w").alias("n"), F.sum(F.col("w") * F.col("w")).alias("n2"),
        *(f(c).alias(name) for name, c, f in _SIDES))


class Tree:
    """An irregular tree of cubes over ``points`` (distinct positions x, y, z with weight w), built from the largest cubes down.

    The largest cubes are split if they hold more than LEAF_CROWD positions and touch a crowded one or are it; smaller ones if
    they hold more than LEAF_CROWD. Only the children of split cubes are built at the next size, from their points, so every
    step handles the points of the regions that are still dense and no others. A step ends with tables in the shared folder.

    ``sizes`` are the halvings of the cubes built, ``levels`` their summaries with the flag ``split``, and ``placed`` the
    points of each step with the flag: they are in a leaf where it is false.
    """

    def __init__(self, points: DataFrame, edge: float, halvings: int, crowd: int):
        self.halvings, self.crowd, self.sizes = halvings, crowd, []
        self.levels: list[DataFrame] = []
        self.placed: list[DataFrame] = []
        self._add(with_cell(points, edge / 2 ** halvings, "fine"), 0)

    def _add(self, points: DataFrame, size: int) -> None:
        cells = cut(_summaries(points, self.key(size)))
        dense, flags = F.col("m") > LEAF_CROWD, ["split"]
        if size == 0:
            around = F.array(F.lit(0).cast("long"), *(F.lit(sign * key_step(d)).cast("long") for d in HALF_OFFSETS for sign in (1, -1)))
            near = (cells.where(F.col("m") > self.crowd).withColumn("step", F.explode(around))
                    .select((F.col("cell") + F.col("step")).alias("cell"), F.lit(True).alias("near")).distinct())
            cells = (cells.join(near, "cell", "left").withColumns({"split": F.coalesce("near", F.lit(False)) & dense, "crowded": F.col("m") > self.crowd})
                     .drop("near"))
            flags = ["split", "crowded"]
        else:
            cells = cells.withColumn("split", dense if size < self.halvings else F.lit(False))
        marks = cells.where("split OR crowded" if size == 0 else "split").select("cell", *flags)
        self.sizes.append(size)
        self.levels.append(cells)
        self.placed.append(cut(_marked(points, marks, self.key(size))))

    def grow(self) -> bool:
        """Build the next size; false if no cube is split. One size is skipped after the largest cubes, which are never
        decided as a whole."""
        if not self.levels[-1].where("split").limit(1).count():
            return False
        self._add(self.placed[-1].where("split").select("x", "y", "z", "w", "fine"), min(self.halvings, max(2, self.sizes[-1] + 1)))
        return True

    def key(self, size: int) -> Column:
        return parent_key(F.col("fine"), self.halvings - size)

    def leaves(self) -> DataFrame:
        """The points with the leaf that holds them: (size, cell, fine, x, y, z, w)."""
        out = None
        for size, points in zip(self.sizes, self.placed):
            part = points.where(~F.col("split")).select(F.lit(size).alias("size"), self.key(size).alias("cell"), "fine", "x", "y", "z", "w")
            out = part if out is None else out.unionByName(part)
        return out


def _side(df: DataFrame, s: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns))


def _r2() -> Column:
    dx, dy, dz = (F.col(f"{c}_a") - F.col(f"{c}_b") for c in "xyz")
    return dx * dx + dy * dy + dz * dz


def _whole(cells: DataFrame) -> DataFrame:
    """The cubes unchanged. The tests are always true and read every column: otherwise a reader that
    needs only some of them would get an aggregation of its own, down to the scan."""
    box = [F.col(f"lo_{c}") <= F.col(f"hi_{c}") for c in "xyz"]
    return cells.where((F.col("m") > 0) & (F.col("n") > 0) & (F.col("n2") > 0) & box[0] & box[1] & box[2])


def _balls(cells: DataFrame, s: str) -> DataFrame:
    """Cubes as balls around the centre of their bounding box. Every cube has points, so nothing is
    null here; saying so (coalesce) spares the joins below the null checks."""
    wide = [F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"]
    half = F.sqrt(wide[0] * wide[0] + wide[1] * wide[1] + wide[2] * wide[2]) / 2.0
    sure = {c: (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2.0 for c in "xyz"}
    sure["ball"] = half + BALL_PAD
    longs = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("cell", "m", "n", "n2")]
    return _side(_whole(cells).select(*longs, "split", *(F.coalesce(v, F.lit(0.0)).alias(k) for k, v in sure.items())), s)


def _judge(cell_pairs: DataFrame, binning: Binning) -> DataFrame:
    """Drop the pairs of cubes that are out of range and add ``ibin``, null where still open."""
    d, s = F.sqrt(_r2()), F.col("ball_a") + F.col("ball_b")
    near, far = d - s, d + s
    lo, hi = binning.chord_bin(F.greatest(near, F.lit(0.0))), binning.chord_bin(far)
    floor = binning.min_chord if binning.min_chord > 0 else -4.0
    return (cell_pairs.where((near < binning.max_chord) & (far >= binning.min_chord))
            .withColumn("ibin", F.when((near >= floor) & (far < binning.max_chord) & (lo == hi), hi)))


_BALL = ("cell", "m", "n", "n2", "x", "y", "z", "ball")


def _open(judged: DataFrame) -> DataFrame:
    """The pairs left for the next size: of a cube that is split its number, of another one all that it is."""
    def side(s: str) -> list[Column]:
        split = F.col(f"split_{s}")
        stay = F.struct(*(F.col(f"{c}_{s}").alias(c) for c in _BALL), F.col(f"size_{s}").alias("size"))
        return [F.when(split, F.col(f"cell_{s}")).alias(f"p{s}"), F.when(~split, stay).alias(f"stay_{s}")]

    return judged.where(F.col("ibin").isNull() & (F.col("split_a") | F.col("split_b"))).select(*side("a"), *side("b"))


def _children(opened: DataFrame, cells: DataFrame, s: str, size: int, bits: int) -> DataFrame:
    """The pairs with side ``s`` replaced by its children, or as it is if it is not split."""
    child = _balls(cells, s).withColumn(f"up_{s}", parent_key(F.col(f"cell_{s}"), bits))
    joined = opened.join(child, F.col(f"p{s}") == F.col(f"up_{s}"), "left").drop(f"up_{s}")
    kept = F.col(f"stay_{s}")
    values = {f"{c}_{s}": F.coalesce(f"{c}_{s}", kept[c]) for c in _BALL}
    return joined.withColumns(values | {f"split_{s}": F.coalesce(f"split_{s}", F.lit(False)),
                                        f"size_{s}": F.coalesce(kept["size"], F.lit(size))}).drop(f"stay_{s}")


def ordered(a: str, b: str) -> Column:
    """Strict order of two positions: visits each unordered pair once, without a row id."""
    x, y, z = ((F.col(f"{c}_{a}"), F.col(f"{c}_{b}")) for c in "xyz")
    return (x[0] < x[1]) | ((x[0] == x[1]) & ((y[0] < y[1]) | ((y[0] == y[1]) & (z[0] < z[1]))))


def join_partitions(df: DataFrame) -> int:
    """Partitions of a pair join: the session's shuffle setting, and at least three per core. The
    join makes far more work than its input bytes suggest, so it is not left to be coalesced."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               3 * spark.sparkContext.defaultParallelism)


def direct_pairs(points: DataFrame, binning: Binning, num_partitions: int | None = None) -> DataFrame:
    """Point pairs in range by one equi-join on the cube key; ``points`` hold distinct positions.

    The right side is sent to the touching cubes that can hold a partner.
    """
    reach = binning.max_chord
    edge = top_edge(reach)
    left = _side(with_cell(points, edge), "a")
    right = _side(spread_to_touching(points, edge, reach), "b")
    n = num_partitions or join_partitions(points)
    # sort-merge: both sides may spill, whatever the size of a partition
    left, right = left.repartition(n, "cell_a").hint("merge"), right.repartition(n, "cell_b")
    once = (F.col("own_b") != F.col("cell_b")) | ordered("a", "b")
    return (left.join(right, (F.col("cell_a") == F.col("cell_b")) & once & binning.inside(_r2()))
            .withColumn("r2", _r2()))


def descend(points: DataFrame, binning: Binning, halvings: int, num_partitions: int | None = None,
            crowd: int = CROWD) -> tuple[Tree | None, DataFrame | None, DataFrame]:
    """Walk down the tree of ``points`` (distinct positions x, y, z with weight w).

    Returns the tree, the decided pairs (size, cell, n and n2 with suffixes _a, _b, and ibin), and the point
    pairs (suffixes _a, _b and ``r2``) that no cube could decide. A size is in halvings.

    Only pairs with a crowded cube (more than ``crowd`` positions) go through the tree; points of all other cubes are joined
    directly. Each step's pairs are judged once and written, the decided and the open ones; it ends where no cube is split.
    """
    if halvings == 0:
        return None, None, direct_pairs(points, binning, num_partitions)
    edge = top_edge(binning.max_chord)
    if halvings > finest_bits(edge):
        raise ValueError(f"cubes of radius {binning.max_chord} cannot be halved {halvings} times")
    tree = Tree(points, edge, halvings, crowd)

    n = num_partitions or join_partitions(points)
    steps = F.array(F.lit(0).cast("long"), *(F.lit(key_step(d)).cast("long") for d in HALF_OFFSETS))
    right = (_balls(tree.levels[0], "b").withColumn("step", F.explode(steps))
             .withColumn("at", F.col("cell_b") + F.col("step")).drop("step"))
    left = _balls(tree.levels[0], "a").hint("merge")
    some = (F.col("m_a") > crowd) | (F.col("m_b") > crowd)
    pairs = left.join(right, (F.col("cell_a") == F.col("at")) & some).withColumns({"size_a": F.lit(0), "size_b": F.lit(0)})
    columns = [f"{c}_{s}" for s in "ab" for c in ("size", "cell", "n", "n2")]
    settled = []
    while True:
        judged = cut(_judge(pairs, binning))
        settled.append(judged.where(F.col("ibin").isNotNull() | ~(F.col("split_a") | F.col("split_b"))).select(*columns, "ibin"))
        if not tree.grow():
            break
        size, bits = tree.sizes[-1], tree.sizes[-1] - tree.sizes[-2]
        pairs = _children(_children(_open(judged), tree.levels[-1], "a", size, bits), tree.levels[-1], "b", size, bits)
        once = ~F.coalesce(F.col("pa") == F.col("pb"), F.lit(False)) | (F.col("cell_a") <= F.col("cell_b"))
        pairs = pairs.where(once).drop("pa", "pb")
    found = settled[0]
    for part in settled[1:]:
        found = found.unionByName(part)
    leaf_pairs = found.where(F.col("ibin").isNull()).select("size_a", "cell_a", "size_b", "cell_b")

    # the points of the leaves that are met
    met = leaf_pairs.select(F.inline(F.array(*(F.struct(F.col(f"size_{s}").alias("size"), F.col(f"cell_{s}").alias("cell")) for s in "ab")))).distinct()
    held = tree.leaves().join(met, ["size", "cell"], "left_semi")
    same = (F.col("size_a") == F.col("size_b")) & (F.col("cell_a") == F.col("cell_b"))
    a, b = (held.select(F.col("size").alias(f"of_{s}"), F.col("cell").alias(f"in_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in "xyzw")) for s in "ab")
    pairs = (leaf_pairs.repartition(n, "cell_a", "cell_b")
             .join(a, (F.col("cell_a") == F.col("in_a")) & (F.col("size_a") == F.col("of_a")))
             .join(b, (F.col("cell_b") == F.col("in_b")) & (F.col("size_b") == F.col("of_b"))
                   & (~same | ordered("a", "b")) & binning.inside(_r2()))
             .withColumn("r2", _r2()))
    # cubes without a crowd, among themselves
    thin = tree.placed[0].where(~F.col("crowded")).select(*points.columns)
    sparse = direct_pairs(thin, binning, num_partitions)
    return tree, found.where(F.col("ibin").isNotNull()), pairs.select(*POINT_PAIR).unionByName(sparse.select(*POINT_PAIR))


def count_by_bin(points: DataFrame, binning: Binning, halvings: int,
                 num_partitions: int | None = None) -> DataFrame:
    """(ibin, Nbin): sum of w_a * w_b over the unordered pairs of distinct positions, per bin; in blocks if ``halvings`` says
    that some region is crowded."""
    n = num_partitions or join_partitions(points)
    if halvings:
        return count_in_blocks(points, binning, n)
    return direct_pairs(points, binning, n).groupBy(binning.index(F.col("r2")).alias("ibin")).agg(
        F.sum(F.col("w_a") * F.col("w_b")).alias("Nbin"))
