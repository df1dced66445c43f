"""Counts in blocks: what is sent and written grows with the positions, not with their pairs, and counts equal brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skypairs.functions.binning import Binning
from skypairs.functions.boxes import Boxes, halved, pair_histogram
from skypairs.operators import blocks, graph, pairs, pyramid
from skypairs.operators.resolution import MARGIN, join_base
from tests.test_pairs import brute_counts, brute_r2, frame


def positions_of(spark, rows):
    return pyramid.distinct_positions(pairs.catalogue_vectors(frame(spark, rows)).withColumn("w", F.lit(1).cast("long")))


@pytest.fixture(scope="module")
def sky():
    """A whole sky, a dense patch, and copies in both."""
    g = np.random.default_rng(3)
    rows = [(float(a), math.degrees(math.asin(s))) for a, s in zip(g.uniform(0, 360, 900), g.uniform(-1, 1, 900))]
    rows += [(float(a), float(d)) for a, d in zip(g.uniform(40, 42, 1500), g.uniform(10, 11, 1500))]
    return [(k, a, d) for k, (a, d) in enumerate(rows + rows[880:920] * 2)]


@pytest.mark.parametrize("bins", [Binning.log(2.5, 250.0, 20), Binning.log(2.5, 250.0, 20, metric="arc"), Binning.linear(0.0, 6000.0, 6),
                                  Binning.linear(1.0, 61.0, 6), Binning.log(2.5, 250.0, 20).slice(10, 14)])
@pytest.mark.parametrize("size", [60])
def test_counts_in_blocks(spark, sky, bins, size):
    counts = blocks.count_in_blocks(positions_of(spark, sky), bins, 5, size)
    got = {r["ibin"]: r["Nbin"] for r in counts.collect()}
    if bins.rmin == 0.0:  # copies of a position are no pairs of positions
        got[0] = got.get(0, 0) + 80 // 2 * 3
    if bins.metric == "arc":
        want = {r["ibin"]: r["Nbin"] for r in pairs.pair_counts(frame(spark, sky), bins, halvings=0).collect()}
    else:
        want = {bins.imin + k: n for k, n in brute_counts(sky, bins).items()}
    assert got == want


def test_crowded_counts_send_blocks_not_points_of_each_pair(spark, sky):
    """The points of one cube were once repeated for every pair of small cubes: 20 rows and more for each of its points."""
    bins = Binning.log(2.5, 250.0, 20)
    table = blocks.blocks_of(positions_of(spark, sky), 5, 400)
    judged = blocks.block_pairs(table, bins.squared_edges(), bins.max_chord)
    sent = blocks.beside(table, judged.where("lo < hi").select("a", "b"), 5)
    points = sent.agg(F.sum(F.length("xyz") / 24)).first()[0]
    assert points <= 6 * 2 * 2400
    # a count of a crowded sky has no join of points with points
    plan = pairs.pair_counts(frame(spark, sky), bins, halvings=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "x_a" not in plan


@pytest.mark.parametrize("n", [1, 2, 13, 500])
def test_boxes_by_brute_force(n):
    g = np.random.default_rng(n)
    bins = Binning.log(2.5, 2500.0, 8)
    edges = np.array(bins.squared_edges())

    def block(n, weights):
        p = g.normal(size=(3, n))
        p /= np.sqrt((p * p).sum(axis=0))
        w = g.integers(1, 5, n) if weights else np.ones(n, np.int64)
        levels = max(0, (n // 4).bit_length() - 1)
        order = halved(p, levels)
        full, v = np.concatenate([p, np.full((3, 1), np.nan)], axis=1)[:, order], np.append(w, 0)[order]
        return p, w, Boxes(full, len(order) >> levels, v if weights else None)

    for weights in (False, True):
        p, w, a = block(n, weights)
        q, v, b = block(2 * n + 1, False)
        for x, y, one, two in ((p, q, a, b), (p, p, a, a)):
            d = x[:, :, None] - y[:, None, :]
            r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
            ww = w[:, None] * (w if one is two else v)[None, :]
            keep = np.triu(np.ones(r2.shape, bool), 1) if one is two else np.ones(r2.shape, bool)
            want = np.bincount(edges.searchsorted(r2[keep], "right"), weights=ww[keep], minlength=len(edges) + 1)
            assert pair_histogram(one, two, edges).tolist() == want.astype(int).tolist()


def test_edges_are_those_of_the_bin_formula(spark):
    for bins in (Binning.log(2.5, 250.0, 20), Binning.linear(0.0, 6000.0, 6), Binning.log(2.5, 250.0, 20, metric="arc").slice(3, 9)):
        edges = bins.squared_edges()
        near = [e * (1 - 1e-13) for e in edges if e > 0] + [e * (1 + 1e-13) for e in edges]  # the logarithms of engines differ in the last bit
        rows = spark.createDataFrame([(r,) for r in near], "r2 double").select(
            "r2", F.when(bins.inside(F.col("r2")), bins.index(F.col("r2"))).alias("i")).collect()
        for r in rows:
            k = int(np.searchsorted(edges, r["r2"], "right"))
            assert r["i"] == (bins.imin + k - 1 if 0 < k < len(edges) else None)


@pytest.mark.parametrize("directed", [False, True])
def test_degrees_in_blocks(spark, sky, directed):
    points = pairs.catalogue_vectors(frame(spark, sky), keep=("id",))
    i, j, r2 = brute_r2(sky)
    near = r2 < math.radians(0.5) ** 2
    want = np.bincount(i[near] if directed else np.concatenate([i[near], j[near]]), minlength=len(sky))
    got = blocks.degrees_in_blocks(points, Binning.linear(0.0, 30.0, 1), directed, 5, 70)
    assert {r["id"]: r["degree"] for r in got.collect()} == {k: int(n) for k, n in enumerate(want) if n}
    # pairs of points were rows of a join once: crowded skies take the blocks now
    plan = graph.degrees(frame(spark, sky), 30.0, directed=directed)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "x_a" not in plan


@pytest.mark.parametrize("tiling", ["cubedsphere", "similar_radius", "healpix"])
@pytest.mark.parametrize("finer", [1, 4])
def test_counts_on_crowded_pixels(spark, sky, tiling, finer, monkeypatch):
    """Positions were rows of a join, repeated for up to 40 pixels and compared as rows."""
    monkeypatch.setattr(pairs, "PIXEL_CROWD", 20)
    bins = Binning.log(2.5, 250.0, 20)
    nbase = join_base(tiling, bins, MARGIN.get(tiling, 1.0)) * finer
    counts = pairs.pair_counts_on_tiling(frame(spark, sky), bins, tiling, nbase=nbase)
    assert {r["ibin"]: r["Nbin"] for r in counts.collect()} == brute_counts(sky, bins)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "x_a" not in plan


def test_stages_of_crowded_pixels(spark, sky):
    bins = Binning.linear(0.0, 100.0, 4)
    counts, stages = pairs.counts_with_stages(frame(spark, sky), bins)
    row, want = stages.first(), brute_counts(sky, bins)
    assert {r["ibin"]: r["Nbin"] for r in counts.collect()} == want
    assert (row["Ndata"], row["nedges"]) == (len(sky), sum(want.values()) - 120)
    assert 8 * len(sky) <= row["Ndup"] <= 9 * len(sky)
