"""What must hold for any partitioning and density: ids, random directions, the tree of cubes, observed and stored runs."""

import math

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from skypairs.functions.binning import Binning
from skypairs.operators import graph, pairs, pyramid, quality, reduce, tiles
from skypairs.operators.grid import top_edge
from tests.test_pairs import as_dict, brute_counts, brute_r2, frame


@pytest.mark.parametrize("partitions", [1, 7, 211])
def test_row_numbers_for_any_partitioning(spark, partitions):
    rows = [(k * 7919 % 101, None if k % 5 == 0 else f"n{k % 3}", k % 2) for k in range(300)] + [(None, None, None)] * 4
    df = spark.createDataFrame(rows, "a int, b string, id2 int")
    got = pairs.numbered(df.repartition(partitions), ["b", "a"], "n").orderBy("n").collect()
    order = sorted(rows, key=lambda r: [(v is not None, v if v is not None else 0) for v in (r[1], r[0], r[2])])
    assert [r["n"] for r in got] == list(range(len(rows)))
    assert [(r["a"], r["b"], r["id2"]) for r in got] == order
    assert pairs.numbered(df.limit(0), ["a"]).count() == 0


def test_random_directions_for_any_partitioning(spark):
    one, many = (quality.random_sky(spark, 2000, 5, p).orderBy("theta", "phi").collect() for p in (1, 16))
    assert one == many
    z = np.cos([r["theta"] for r in one])
    assert abs(z.mean()) < 0.05 and abs((z ** 2).mean() - 1 / 3) < 0.03
    assert one != quality.random_sky(spark, 2000, 6, 4).orderBy("theta", "phi").collect()


@pytest.fixture(scope="module")
def uneven():
    """400 points within 0.02 degrees, 400 within one, 200 within thirty, and 100 copies of a position."""
    g = np.random.default_rng(11)
    rows = [(float(a), float(d)) for wide, n in ((0.02, 400), (1.0, 400), (30.0, 200)) for a, d in zip(g.uniform(0, wide, n), g.uniform(0, wide, n))]
    return [(k, a, d) for k, (a, d) in enumerate(rows + [(0.01, 0.01)] * 100)]


def test_depth_follows_density(spark, uneven):
    bins = Binning.linear(0.0, 40.0, 5)
    positions = pyramid.distinct_positions(pairs.catalogue_vectors(frame(spark, uneven)).withColumn("w", F.lit(1).cast("long")))
    tree = pyramid.Tree(positions, top_edge(bins.max_chord), pyramid.useful_halvings(bins), 100)
    while tree.grow():
        pass
    assert len(tree.sizes) > 4
    handled = [points.count() for points in tree.placed]
    assert handled[0] == positions.count() and handled == sorted(handled, reverse=True) and handled[-1] < handled[0] / 2
    # each point is in one leaf, and leaves hold few points
    leaves = tree.leaves()
    assert leaves.select("x", "y", "z").distinct().count() == leaves.count() == handled[0]
    dense = leaves.where("size > 0").groupBy("size", "cell").count()
    assert dense.agg(F.max("count")).first()[0] <= pyramid.LEAF_CROWD
    assert as_dict(pairs.pair_counts(frame(spark, uneven), bins, crowd=100)) == brute_counts(uneven, bins)


@pytest.mark.parametrize("directed", [False, True])
def test_degrees_of_uneven_points(spark, uneven, directed):
    i, j, r2 = brute_r2(uneven)
    near = r2 < math.radians(10 / 60) ** 2
    want = np.bincount(i[near] if directed else np.concatenate([i[near], j[near]]), minlength=len(uneven))
    got = {r["id"]: r["degree"] for r in graph.degrees(frame(spark, uneven), 10.0, directed=directed, crowd=60).collect()}
    assert got == {k: int(n) for k, n in enumerate(want) if n}


def test_stages_are_observed_in_the_counting_run(spark, uneven):
    bins = Binning.linear(2.0, 100.0, 4)
    counts, stages = pairs.counts_with_stages(frame(spark, uneven), bins)
    assert as_dict(counts) == brute_counts(uneven, bins)
    row = stages.first()
    assert (row["Ndata"], row["nedges"]) == (len(uneven), sum(brute_counts(uneven, bins).values()))
    assert 8 * len(uneven) <= row["Ndup"] <= 9 * len(uneven)


def test_stored_positions_are_read_once_and_released(spark, uneven):
    scans = Observation()
    sky = frame(spark, uneven).observe(scans, F.count(F.lit(1)).alias("rows"))
    bins = Binning.linear(0.0, 40.0, 5)
    assert as_dict(pairs.pair_counts_kept(sky, bins)) == brute_counts(uneven, bins)
    assert scans.get["rows"] == len(uneven)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_rolled_cells_equal_those_of_each_resolution(spark, uneven):
    sky = frame(spark, uneven)
    rolled = reduce.rolled_cells(sky, [8, 64, 16])
    for nside in (8, 16, 64):
        one = reduce.weighted_cells(sky, "healpix", nside)
        keys = ["ipix", "w"] if "ipix" in one.columns else ["w"]
        assert sorted(map(tuple, rolled.where(F.col("nside") == nside).select(*keys).collect())) == sorted(map(tuple, one.select(*keys).collect()))
    both = tiles.assign_pixels(sky.select(F.radians(90 - F.col("dec")).alias("theta"), F.radians("ra").alias("phi")), "healpix", [4, 32])
    one = tiles.assign_pixel(both, "healpix", 4)
    assert one.where("ipix <> id4").count() == 0
