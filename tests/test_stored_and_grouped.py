"""Stored catalogues, blocks that are sent to groups of blocks, and pair lists in order."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from skypairs.functions.binning import Binning
from skypairs.operators import blocks, pairs
from tests.test_blocks import positions_of, sky  # noqa: F401
from tests.test_pairs import brute_counts, brute_r2, frame


def test_stored_counts_on_crowded_pixels(spark, sky):  # noqa: F811
    """Positions of full pixels were compared as rows of a join."""
    name, bins = f"sky_{uuid.uuid4().hex}", Binning.linear(0.0, 100.0, 4)
    try:
        pairs.store_for_pairs(frame(spark, sky), name, bins, buckets=4)
        counts = pairs.stored_pair_counts(spark, name, bins)
        assert {r["ibin"]: r["Nbin"] for r in counts.collect()} == brute_counts(sky, bins)
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "x_a" not in plan
        # a narrower count of the same tables
        narrow = Binning.linear(0.0, 30.0, 3)
        assert {r["ibin"]: r["Nbin"] for r in pairs.stored_pair_counts(spark, name, narrow).collect()} == brute_counts(sky, narrow)
    finally:
        for part in ("own", "around"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")


@pytest.fixture(scope="module")
def patch():
    """2,000 points within a tenth of a degree, a sixth of them copies of five positions."""
    g = np.random.default_rng(5)
    rows = [(float(a), float(d)) for a, d in zip(g.uniform(40, 40.1, 1660), g.uniform(10, 10.1, 1660))]
    return [(k * 7 % 2000, a, d) for k, (a, d) in enumerate(rows + rows[:5] * 68)]


def test_blocks_are_sent_once_to_a_group(spark, patch):
    """Each block of a crowded patch once got the points of every block that it meets."""
    vectors = pairs.catalogue_vectors(frame(spark, patch), keep=("id",)).withColumn("w", F.lit(1).cast("long"))
    table = blocks.blocks_of(vectors, 2, 32)
    met = blocks.block_pairs(table, [-1.0, 1.0], 1.0).select("a", "b")
    alone, grouped = (blocks.beside(table, met, 5, group).where("xyz IS NOT NULL") for group in (1, 8))
    points = F.sum(F.length("xyz") / 24)
    assert grouped.agg(points).first()[0] < alone.agg(points).first()[0] / 3
    # where ids are all that is asked for, no positions are sent
    ids = blocks.beside(table, met.withColumn("whole", F.col("a") != F.col("b")), 5, 8, True).where("NOT lead")
    assert ids.where("xyz IS NOT NULL").count() == 0 < ids.where("ids IS NOT NULL").count()


@pytest.mark.parametrize("directed", [False, True])
def test_degrees_of_grouped_blocks(spark, patch, directed, monkeypatch):
    monkeypatch.setattr(blocks, "group_size", lambda table: 4)
    i, j, r2 = brute_r2(patch)
    near = r2 < math.radians(4 / 60) ** 2
    ids = np.array([r[0] for r in patch])
    low, high = np.minimum(ids[i[near]], ids[j[near]]), np.maximum(ids[i[near]], ids[j[near]])
    want = np.bincount(low if directed else np.concatenate([low, high]), minlength=len(patch))
    points = pairs.catalogue_vectors(frame(spark, patch), keep=("id",))
    got = blocks.degrees_in_blocks(points, Binning.linear(0.0, 4.0, 1), directed, 3, 40)
    assert {r["id"]: r["degree"] for r in got.collect()} == {k: int(n) for k, n in enumerate(want) if n}


def test_counts_of_grouped_blocks(spark, patch, monkeypatch):
    monkeypatch.setattr(blocks, "group_size", lambda table: 4)
    bins = Binning.linear(0.5, 6.5, 6)
    counts = blocks.count_in_blocks(positions_of(spark, patch), bins, 3, 40)
    assert {r["ibin"]: r["Nbin"] for r in counts.collect()} == brute_counts(patch, bins)
