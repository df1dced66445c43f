"""Pair counts by separation bin, pair lists, and the neighbour-expanded join on a tiling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binning import Binning, attach_bins
from ..functions.geometry import chord2, has_position, unit_vector_angles, with_angles, with_unit_vector
from .blocks import count_blocks, packed_by_pixel, pixel_block_pairs, pixel_blocks
from .grid import spread_to_touching, top_edge, with_cell
from .lineage import cut
from .pyramid import (CROWD, choose_halvings, count_by_bin, distinct_positions, join_partitions,
                      ordered)
from .resolution import MARGIN, join_base
from .tiles import assign_pixel, neighbours, ring_table


#: Parts that the rows of one key are dealt to where they look up its number of chunks.
SALTS = 64
# positions in a pixel from which they are packed to blocks
PIXEL_CROWD = 64


def catalogue_vectors(catalogue: DataFrame, ra: str = "ra", dec: str = "dec",
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """Unit vectors (x, y, z) of a catalogue in degrees; rows without a position are left out."""
    placed = catalogue.where(has_position(ra, dec))
    return (with_unit_vector(with_angles(placed.select(ra, dec, *keep), ra, dec))
            .select(*keep, "x", "y", "z"))


def _coincident(positions: DataFrame, binning: Binning) -> DataFrame:
    """Pairs at distance zero: they exist only where copies were merged into one position."""
    return positions.agg(F.sum(F.expr("w * (w - 1) div 2")).alias("Nbin")).select(
        F.lit(binning.imin).alias("ibin"), "Nbin").where("Nbin > 0")


def count_pairs(vectors: DataFrame, binning: Binning, halvings: int | str = "auto",
                num_partitions: int | None = None, crowd: int = CROWD) -> DataFrame:
    """(ibin, Nbin) of all unordered pairs of rows of ``vectors`` (x, y, z, without nulls).

    ``halvings="auto"`` looks for crowded cubes first, to size the pyramid; a number skips that job.
    A cube is crowded with more than ``crowd`` positions.
    """
    positions = distinct_positions(vectors.withColumn("w", F.lit(1).cast("long")))
    if halvings == "auto":
        halvings = choose_halvings(vectors, binning, crowd)
    counts = count_by_bin(positions, binning, halvings, num_partitions)
    if binning.rmin == 0.0:
        counts = (counts.unionByName(_coincident(positions, binning))
                  .groupBy("ibin").agg(F.sum("Nbin").alias("Nbin")))
    return counts


def pair_counts(catalogue: DataFrame, binning: Binning, ra: str = "ra", dec: str = "dec",
                halvings: int | str = "auto", num_partitions: int | None = None,
                crowd: int = CROWD) -> DataFrame:
    """Exact pair count per bin: (ibin, lo, hi, width, Nbin), ordered by bin."""
    counts = count_pairs(catalogue_vectors(catalogue, ra, dec), binning, halvings, num_partitions, crowd)
    return attach_bins(counts, binning).orderBy("ibin")


def weighted_pair_counts(cells: DataFrame, binning: Binning, halvings: int | str = "auto",
                         num_partitions: int | None = None) -> DataFrame:
    """Sum of w * w2 per bin over pairs of weighted cells (x, y, z, w). Pairs inside one cell have
    no known separation and are not counted."""
    cells = cells.select("x", "y", "z", "w")
    if halvings == "auto":
        halvings = choose_halvings(cells, binning)
    counts = count_by_bin(cells, binning, halvings, num_partitions)
    return attach_bins(counts, binning).orderBy("ibin")


def total_pairs(counts: DataFrame, column: str = "Nbin") -> DataFrame:
    return counts.agg(F.sum(column).alias("n_pairs"))


def _meet(left: DataFrame, right: DataFrame, spread_by: list[str], chunk_rows: int,
          num_partitions: int | None) -> DataFrame:
    """Equi-join of ``left`` (key cell_a) and ``right`` (key cell_b) that no crowded key can clog.

    The left rows of a key with more than ``chunk_rows`` rows are spread over chunks by a hash of
    ``spread_by``, and the right rows of that key are repeated for each chunk, so the work on one key
    is shared by many tasks and each task buffers one chunk.
    """
    first = F.lit(0).cast("long")
    crowded = (left.groupBy("cell_a").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("long").alias("chunks"))
               .where(F.col("chunks") > 1)
               .withColumn("salt", F.explode(F.sequence(first, F.lit(SALTS - 1).cast("long")))))
    # the rows of a key meet its number of chunks in many tasks as well
    left = (left.withColumn("salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("long")).join(crowded, ["cell_a", "salt"], "left")
            .withColumn("chunk", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("chunks")), first))
            .drop("chunks", "salt"))
    right = (right.withColumn("salt", F.pmod(F.xxhash64(*right.columns), F.lit(SALTS)).cast("long"))
             .join(crowded.withColumnRenamed("cell_a", "cell_b"), ["cell_b", "salt"], "left")
             .withColumn("to", F.explode(F.sequence(first, F.coalesce("chunks", F.lit(1).cast("long")) - 1)))
             .drop("chunks", "salt"))
    n = num_partitions or join_partitions(left)
    left = left.repartition(n, "cell_a", "chunk").hint("merge")
    return left.join(right.repartition(n, "cell_b", "to"),
                     (F.col("cell_a") == F.col("cell_b")) & (F.col("chunk") == F.col("to")))


def _observed(around: DataFrame, watch: Observation) -> DataFrame:
    """Rows with a weight and the neighbours of their pixel (around), their weight and that of their copies observed."""
    return around.observe(watch, F.sum("w").alias("Ndata"), F.sum(F.col("w") * (F.size("around") + 1)).alias("Ndup"))


def tiling_candidates(vectors: DataFrame, tiling: str, nbase: int, chunk_rows: int = 100_000,
                      num_partitions: int | None = None, watch: Observation | None = None, rings: int = 1,
                      reach: float | None = None) -> DataFrame:
    """Candidate pairs from a pixel join: each row with the rows of its own and of the neighbouring
    pixels, columns suffixed _a and _b. ``vectors`` carry ipix, x, y, z and a unique ``id``; without
    an id their positions must be distinct.

    A row is sent to the neighbours with a lower pixel number only, and to its own pixel, so each
    pair of pixels meets once (five rows per input row instead of nine). Neighbouring pixels reach
    all partners only as far as the tiling's shape allows; see the README. ``watch`` observes the weight of the rows (Ndata)
    and that of their copies for their own and all neighbouring pixels (Ndup) as they pass by.

    With ``rings`` over one, rows are sent as far as that ring of pixels, so that finer pixels cover as well; the rings are worked out
    once for each pixel that has rows, and pixels beyond ``reach`` (a chord) left out.
    """
    left = vectors.select(F.col("ipix").alias("cell_a"), *(F.col(c).alias(f"{c}_a") for c in vectors.columns))
    if rings > 1:
        lower = ring_table(vectors, tiling, nbase, rings, reach).where("at <= ipix").groupBy("ipix").agg(F.collect_list("at").alias("to"))
        around = vectors.join(lower, "ipix").withColumn("at", F.explode("to")).drop("to")
    else:
        around = neighbours(vectors, tiling, nbase, out="around")
        if watch is not None:
            around = _observed(around, watch)
        around = around.withColumn("at", F.explode(F.concat(F.array("ipix"), "around")))
    right = (around.where(F.col("at") <= F.col("ipix"))
             .select(F.col("at").alias("cell_b"), *(F.col(c).alias(f"{c}_b") for c in vectors.columns)))
    by_id = "id" in vectors.columns
    order = F.col("id_a") < F.col("id_b") if by_id else ordered("a", "b")
    spread_by = ["id_a"] if by_id else ["x_a", "y_a", "z_a"]
    return (_meet(left, right, spread_by, chunk_rows, num_partitions)
            .where((F.col("ipix_b") != F.col("cell_b")) | order))


def pair_counts_on_tiling(catalogue: DataFrame, binning: Binning, tiling: str = "cubedsphere",
                          ra: str = "ra", dec: str = "dec", nbase: int | None = None,
                          num_partitions: int | None = None) -> DataFrame:
    """Exact pair count joined on the pixels of a tiling, for those who want that join key. Copies
    of a position are merged first; a crowded sky is better served by ``pair_counts``, which also
    takes over where no pixel of the tiling is large enough for the last bin. A finer ``nbase`` than the bins ask for is covered by as many
    rings of pixels as it is finer: k rings reach k times as far as one."""
    one_ring = join_base(tiling, binning, MARGIN.get(tiling, 1.0))
    if not one_ring:
        return pair_counts(catalogue, binning, ra, dec, num_partitions=num_partitions)
    nbase = nbase or one_ring
    rings = -(-nbase // one_ring)
    return _counted_on_tiling(catalogue, binning, tiling, ra, dec, nbase, num_partitions, rings=rings)


def _counted_on_tiling(catalogue: DataFrame, binning: Binning, tiling: str, ra: str, dec: str, nbase: int,
                       num_partitions: int | None, sent: Observation | None = None, met: Observation | None = None,
                       rings: int = 1) -> DataFrame:
    """Rows meet in the join while pixels hold few positions; points of fuller pixels are packed to blocks, and pairs of neighbouring
    pixels' blocks counted."""
    vectors = catalogue_vectors(catalogue, ra, dec).withColumn("w", F.lit(1).cast("long"))
    positions = distinct_positions(vectors)
    theta, phi = unit_vector_angles(*map(F.col, "xyz"))
    placed = cut(assign_pixel(positions.withColumns({"theta": theta, "phi": phi}), tiling, nbase).drop("theta", "phi"))
    fullest = placed.groupBy("ipix").count().agg(F.max("count")).first()[0] or 0
    if fullest > PIXEL_CROWD:
        n = num_partitions or join_partitions(placed)
        packed = pixel_blocks(placed, n)
        pixels = packed.groupBy(F.col("key").alias("ipix")).agg(F.sum("w").alias("w"))
        if rings > 1:
            around = ring_table(pixels, tiling, nbase, rings, binning.max_chord)
        else:
            around = neighbours(pixels, tiling, nbase, out="around")
            if sent is not None:
                around = _observed(around, sent)
            around = around.select("ipix", F.explode(F.concat(F.array("ipix"), "around")).alias("at"))
        judged = cut(pixel_block_pairs(packed, around.where("at <= ipix"), binning.squared_edges()))
        counts = count_blocks(packed, judged, binning, n, met)
    else:
        pairs = (tiling_candidates(placed, tiling, nbase, num_partitions=num_partitions, watch=sent, rings=rings, reach=binning.max_chord)
                 .where(binning.inside(pair_r2())))
        if met is not None:
            pairs = pairs.observe(met, F.coalesce(F.sum(F.col("w_a") * F.col("w_b")), F.lit(0).cast("long")).alias("nedges"))
        counts = pairs.groupBy(binning.index(pair_r2()).alias("ibin")).agg(
            F.sum(F.col("w_a") * F.col("w_b")).alias("Nbin"))
    if binning.rmin == 0.0:
        counts = (counts.unionByName(_coincident(placed, binning))
                  .groupBy("ibin").agg(F.sum("Nbin").alias("Nbin")))
    return attach_bins(counts, binning).orderBy("ibin")


def pair_r2() -> Column:
    return chord2(tuple(F.col(f"{c}_a") for c in "xyz"), tuple(F.col(f"{c}_b") for c in "xyz"))


def numbered(df: DataFrame, by: list[str], name: str = "id") -> DataFrame:
    """The rows with a number from 0 in the order of ``by``, nulls first; the same however the input is partitioned.

    A range sort, numbers within the partitions, and the prefix sum of the partitions' row counts, which is the only
    table that one task holds. Rows that agree in ``by`` are ordered by all other columns, so those that can't be told apart
    are equal.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*by, *(c for c in df.columns if c not in by)]]
    # the number of the partition in the upper bits, that of the row in the lower ones
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (placed.join(F.broadcast(before), "_part")  # one row for each partition
            .select(*df.columns, (F.col("_before") + F.col("_row")).alias(name)))


def with_row_id(df: DataFrame, key: str | None = None, name: str = "id") -> DataFrame:
    """A unique long per row: the key column when the table has one, else the row's number in the order of all columns, which
    doesn't depend on how the input is split."""
    return df.withColumn(name, F.col(key).cast("long")) if key else numbered(df, df.columns, name)


def pair_list(catalogue: DataFrame, reach_arcmin: float, ra: str = "ra", dec: str = "dec",
              id_col: str = "id", chunk_rows: int = 100_000,
              num_partitions: int | None = None) -> DataFrame:
    """(id, id2), id < id2, of all pairs closer than ``reach_arcmin`` (chord): the edges of the
    proximity graph.

    The output grows with the pairs, so this is for short reaches; counts and degrees do not need
    it. A cube with more than ``chunk_rows`` rows is cut into chunks joined in separate tasks: its
    rows get a chunk number from their id, and the rows sent to it are repeated for every chunk.
    """
    rmax = math.radians(reach_arcmin / 60.0)
    edge = top_edge(rmax)
    rows = catalogue_vectors(catalogue.withColumnRenamed(id_col, "id"), ra, dec, keep=("id",))
    left = with_cell(rows, edge).select(F.col("cell").alias("cell_a"),
                                        *(F.col(c).alias(f"{c}_a") for c in ("id", "x", "y", "z")))
    right = spread_to_touching(rows, edge, rmax).select(
        F.col("cell").alias("cell_b"), *(F.col(c).alias(f"{c}_b") for c in ("own", "id", "x", "y", "z")))
    once = (F.col("own_b") != F.col("cell_b")) | (F.col("id_a") < F.col("id_b"))
    return (_meet(left, right, ["id_a"], chunk_rows, num_partitions).where(once & (pair_r2() < rmax * rmax))
            .select(F.least("id_a", "id_b").alias("id"), F.greatest("id_a", "id_b").alias("id2")))


def counts_with_stages(catalogue: DataFrame, binning: Binning, tiling: str = "cubedsphere", ra: str = "ra", dec: str = "dec",
                       nbase: int | None = None, num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The pair counts on a tiling, and one row with what the stages of that same run handled: Ndata, Ndup and nedges.

    The count runs here, as one action; its result (a row a bin) and what was observed on the way come back as tables. A
    task that is run again is observed again, so the row is exact for runs without failures.
    """
    nbase = nbase or join_base(tiling, binning, MARGIN.get(tiling, 1.0))
    if not nbase:
        raise ValueError(f"{tiling} has no pixels that reach {binning.upper} arcmin")
    sent, met = Observation(), Observation()
    counts = _counted_on_tiling(catalogue, binning, tiling, ra, dec, nbase, num_partitions, sent, met)
    spark, schema = catalogue.sparkSession, counts.schema
    rows = counts.collect()
    stages = [(sent.get["Ndata"] or 0, sent.get["Ndup"] or 0, met.get["nedges"] or 0)]
    return spark.createDataFrame(rows, schema), spark.createDataFrame(stages, "Ndata long, Ndup long, nedges long")


def pair_counts_kept(catalogue: DataFrame, binning: Binning, ra: str = "ra", dec: str = "dec",
                     level: StorageLevel = StorageLevel.MEMORY_AND_DISK, num_partitions: int | None = None) -> DataFrame:
    """``pair_counts`` for a catalogue that is dear to read: its positions are stored while the jobs that size the count and the
    count itself run, and released afterwards. The result, a row a bin, is computed here."""
    with stored(catalogue_vectors(catalogue, ra, dec), level) as vectors:
        counts = attach_bins(count_pairs(vectors, binning, num_partitions=num_partitions), binning).orderBy("ibin")
        return catalogue.sparkSession.createDataFrame(counts.collect(), counts.schema)


def store_for_pairs(catalogue: DataFrame, name: str, binning: Binning, tiling: str = "healpix", ra: str = "ra", dec: str = "dec",
                    buckets: int = 64, nbase: int | None = None) -> int:
    """Write a catalogue for many pair counts up to the last bin's reach; returns the resolution of its pixels.

    Two tables, ``<name>_own`` (ipix, x, y, z, w) and ``<name>_around`` (at, ipix, x, y, z, w: every position once for its own and
    each neighbouring pixel with a lower number), each bucketed and sorted by its pixel: counts join them without an exchange,
    and a range of pixels reads only the row groups that hold it.
    """
    nbase = nbase or join_base(tiling, binning, MARGIN.get(tiling, 1.0))
    if not nbase:
        raise ValueError(f"{tiling} has no pixels that reach {binning.upper} arcmin")
    positions = distinct_positions(catalogue_vectors(catalogue, ra, dec).withColumn("w", F.lit(1).cast("long")))
    theta, phi = unit_vector_angles(*map(F.col, "xyz"))
    placed = assign_pixel(positions.withColumns({"theta": theta, "phi": phi}), tiling, nbase).select("ipix", "x", "y", "z", "w")
    around = neighbours(placed, tiling, nbase, out="near").withColumn("at", F.explode(F.concat(F.array("ipix"), "near"))).drop("near")
    for rows, key, table in ((placed, "ipix", "own"), (around.where("at <= ipix"), "at", "around")):
        # one file a bucket, sorted by pixel
        rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{name}_{table}")
    return nbase


def stored_pairs(spark: SparkSession, name: str, binning: Binning, pixels: tuple[int, int] | None = None) -> DataFrame:
    """Pairs in range (suffixes _a, _b) of a catalogue that ``store_for_pairs`` has written for at least that reach; with
    ``pixels`` those that meet in the pixels from the first to the last number given."""
    own, around = spark.table(f"{name}_own"), spark.table(f"{name}_around")
    if pixels is not None:
        own, around = own.where(F.col("ipix").between(*pixels)), around.where(F.col("at").between(*pixels))
    a = own.select(*(F.col(c).alias(f"{c}_a") for c in own.columns)).hint("merge")
    b = around.select("at", *(F.col(c).alias(f"{c}_b") for c in own.columns))
    return a.join(b, (F.col("ipix_a") == F.col("at")) & ((F.col("ipix_b") != F.col("at")) | ordered("a", "b")) & binning.inside(pair_r2()))


def stored_pair_counts(spark: SparkSession, name: str, binning: Binning) -> DataFrame:
    """Exact pair count per bin of a stored catalogue: (ibin, lo, hi, width, Nbin), ordered by bin.

    Rows meet in the join of the two tables while pixels hold few positions. Otherwise the positions of a pixel, which the first
    table has one after the other, are packed to blocks where they are read, and the second one names the pixels that meet."""
    own, around = spark.table(f"{name}_own"), spark.table(f"{name}_around")
    fullest = own.groupBy("ipix").count().agg(F.max("count")).first()[0] or 0
    if fullest > PIXEL_CROWD:
        packed = packed_by_pixel(own)
        judged = cut(pixel_block_pairs(packed, around.select("ipix", "at").distinct(), binning.squared_edges()))
        counts = count_blocks(packed, judged, binning, join_partitions(own))
    else:
        counts = stored_pairs(spark, name, binning).groupBy(binning.index(pair_r2()).alias("ibin")).agg(
            F.sum(F.col("w_a") * F.col("w_b")).alias("Nbin"))
    if binning.rmin == 0.0:
        counts = (counts.unionByName(_coincident(own, binning))
                  .groupBy("ibin").agg(F.sum("Nbin").alias("Nbin")))
    return attach_bins(counts, binning).orderBy("ibin")


@contextmanager
def stored(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """The frame, kept at a storage level inside the block. Blocks of a lost executor are computed again."""
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist(blocking=True)


def stage_counts(catalogue: DataFrame, binning: Binning, tiling: str = "cubedsphere", ra: str = "ra",
                 dec: str = "dec") -> DataFrame:
    """One row with what each stage handles: Ndata, Ndup (rows after neighbour expansion, own pixel
    included) and nedges (counted pairs)."""
    nbase = join_base(tiling, binning)
    if not nbase:
        raise ValueError(f"{tiling} has no pixels that reach {binning.upper} arcmin")
    placed = catalogue.where(has_position(ra, dec))
    pixels = assign_pixel(with_angles(placed.select(ra, dec), ra, dec), tiling, nbase).groupBy("ipix").count()
    sizes = neighbours(pixels, tiling, nbase).agg(
        F.sum("count").alias("Ndata"),
        F.sum(F.col("count") * (F.size("neighbours") + 1)).alias("Ndup"))
    edges = pair_counts(catalogue, binning, ra, dec).agg(F.sum("Nbin").alias("nedges"))
    return sizes.select("Ndata", "Ndup", edges.scalar().alias("nedges"))
