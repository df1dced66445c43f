"""Pair counts and degrees against brute force, on skies with crowds and copies."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skypairs.functions.binning import Binning
from skypairs.operators import graph, pairs, pyramid, reduce

BINS = Binning.log(2.5, 250.0, 20)


def vectors_of(rows):
    ra, dec = np.radians([r[1] for r in rows]), np.radians([r[2] for r in rows])
    return np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], axis=1)


def brute_r2(rows):
    v = vectors_of(rows)
    i, j = np.triu_indices(len(v), 1)
    d = v[i] - v[j]
    return i, j, (d * d).sum(axis=1)


def brute_counts(rows, bins):
    r2 = brute_r2(rows)[2]
    r2 = r2[(r2 >= bins.rmin ** 2) & (r2 < bins.rmax ** 2)]
    if bins.kind == "log":
        step = (math.log(bins.hi) - math.log(bins.lo)) / bins.n
        k = ((np.log(r2) / 2 - math.log(bins.rmin)) / step).astype(int)
    else:
        k = ((np.sqrt(r2) - bins.rmin) / math.radians((bins.hi - bins.lo) / bins.n / 60)).astype(int)
    got = np.bincount(k, minlength=bins.n)
    return {int(n): int(c) for n, c in enumerate(got) if c}


@pytest.fixture(scope="module")
def crowded():
    """300 points over a patch, 600 within one degree, and 200 copies of one position."""
    g = np.random.default_rng(7)
    rows = [(k, float(a), float(d)) for k, (a, d) in enumerate(zip(g.uniform(0, 20, 300), g.uniform(-10, 10, 300)))]
    rows += [(300 + k, float(a), float(d)) for k, (a, d) in
             enumerate(zip(g.uniform(5, 6, 600), g.uniform(2, 3, 600)))]
    return rows + [(900 + k, 7.0, 1.0) for k in range(200)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, ra double, dec double").repartition(4, "id")


def as_dict(df):
    return {r["ibin"]: r["Nbin"] for r in df.collect()}


@pytest.mark.parametrize("halvings", [0, 1, 4, "auto"])
def test_counts_match_brute_force(spark, crowded, halvings, monkeypatch):
    monkeypatch.setattr(pyramid, "LEAF_CROWD", 8)
    got = as_dict(pairs.pair_counts(frame(spark, crowded), BINS, halvings=halvings, crowd=40))
    assert got == brute_counts(crowded, BINS)


@pytest.mark.parametrize("halvings", [0, 3])
def test_linear_bins_from_zero_count_copies(spark, crowded, halvings):
    bins = Binning.linear(0.0, 200.0, 8)
    got = as_dict(pairs.pair_counts(frame(spark, crowded), bins, halvings=halvings, crowd=40))
    assert got == brute_counts(crowded, bins)


@pytest.mark.parametrize("halvings", [0, 2])
def test_degrees_match_brute_force(spark, crowded, halvings):
    i, j, r2 = brute_r2(crowded)
    near = r2 < math.radians(30 / 60) ** 2
    want = np.bincount(np.concatenate([i[near], j[near]]), minlength=len(crowded))
    got = {r["id"]: r["degree"] for r in
           graph.degrees(frame(spark, crowded), 30.0, halvings=halvings, crowd=40).collect()}
    assert got == {k: int(n) for k, n in enumerate(want) if n}


def test_pair_list_with_chunked_cubes(spark, crowded):
    i, j, r2 = brute_r2(crowded)
    near = r2 < math.radians(20 / 60) ** 2
    got = {(r["id"], r["id2"]) for r in pairs.pair_list(frame(spark, crowded), 20.0, chunk_rows=50).collect()}
    assert got == set(zip(i[near].tolist(), j[near].tolist()))


def test_all_covers_agree(spark, crowded):
    sky = frame(spark, crowded)
    want = brute_counts(crowded, BINS)
    assert as_dict(pairs.pair_counts_on_tiling(sky, BINS, "cubedsphere")) == want
    assert as_dict(pairs.pair_counts_on_tiling(sky, BINS, "healpix")) == want
    assert as_dict(pairs.pair_counts_on_tiling(sky, BINS, "similar_radius")) == want


def test_parts_of_the_bin_range_add_up(spark, crowded):
    sky = frame(spark, crowded)
    whole = as_dict(pairs.pair_counts(sky, BINS))
    parts = as_dict(pairs.pair_counts(sky, BINS.slice(0, 9))) | as_dict(pairs.pair_counts(sky, BINS.slice(10, 19)))
    assert parts == whole


def test_turning_the_sky_keeps_the_counts(spark, crowded):
    turned = [(k, (a + 123.0) % 360.0, d) for k, a, d in crowded]
    a, b = (as_dict(pairs.pair_counts(frame(spark, r), BINS)) for r in (crowded, turned))
    assert a == b


def test_arc_metric_at_wide_angles(spark):
    g = np.random.default_rng(3)
    rows = [(k, float(a), float(d)) for k, (a, d) in enumerate(zip(g.uniform(0, 360, 150), g.uniform(-80, 80, 150)))]
    bins = Binning.linear(600.0, 9600.0, 9, metric="arc")
    r2 = brute_r2(rows)[2]
    arc = np.degrees(2 * np.arcsin(np.minimum(np.sqrt(r2) / 2, 1))) * 60
    want = np.histogram(arc, bins=np.linspace(600, 9600, 10))[0]
    for halvings in (0, 2):
        got = as_dict(pairs.pair_counts(frame(spark, rows), bins, halvings=halvings, crowd=10))
        assert got == {k: int(n) for k, n in enumerate(want) if n}


def test_reduction_keeps_the_weight_and_is_close(spark, crowded):
    sky = frame(spark, crowded)
    cells = reduce.weighted_cells(sky, "similar_radius", 64)
    assert cells.agg(F.sum("w")).first()[0] == len(crowded)
    bins = BINS.slice(14, 19)
    both = reduce.compare_counts(pairs.pair_counts(sky, bins), reduce.reduced_pair_counts(sky, bins))
    total = both.agg(F.sum("N").alias("n"), F.sum("N1").alias("n1")).first()
    assert abs(1 - total["n1"] / total["n"]) < 0.02


def test_rows_without_a_position_are_left_out(spark, crowded):
    sky = frame(spark, crowded).unionByName(spark.createDataFrame([(9999, None, 1.0)], "id long, ra double, dec double"))
    assert as_dict(pairs.pair_counts(sky, BINS.slice(10, 19))) == as_dict(
        pairs.pair_counts(frame(spark, crowded), BINS.slice(10, 19)))


def test_a_lone_tight_crowd_is_dropped_in_bulk(spark):
    g = np.random.default_rng(5)
    rows = [(k, float(a), float(d)) for k, (a, d) in enumerate(zip(g.uniform(0, 0.01, 800), g.uniform(0, 0.01, 800)))]
    vectors = pairs.catalogue_vectors(frame(spark, rows))
    positions = pyramid.distinct_positions(vectors.withColumn("w", F.lit(1).cast("long")))
    halvings = pyramid.choose_halvings(vectors, BINS)
    assert halvings > 0
    assert pairs.pair_counts(frame(spark, rows), BINS, halvings=halvings).count() == 0


def test_plan_has_no_cartesian_product(spark, crowded):
    plan = pairs.pair_counts(frame(spark, crowded), BINS, halvings=0)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
