"""Very small and very wide reaches, positions that are no numbers, and odd files."""

import math

import pytest
from pyspark.sql import functions as F

from skypairs.functions.binning import Binning
from skypairs.operators import graph, pairs, reduce, tiles
from skypairs.operators.resolution import coarse_base, join_base
from skypairs.sources import catalogue
from tests.test_pairs import as_dict, brute_counts, frame

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("reach", [0.002, 0.01])
def test_reaches_below_the_finest_cube(spark, reach):
    step = reach / 60.0 / 2
    sky = frame(spark, [(2 * k + m, k * 1.1 % 360, 20 + m * step) for k in range(300) for m in (0, 1)])
    assert pairs.pair_list(sky, reach).count() == 300
    assert as_dict(pairs.pair_counts(sky, Binning.linear(0, reach, 1))) == {0: 300}
    assert graph.degrees(sky, reach).agg(F.sum("degree")).first()[0] == 600


@pytest.fixture(scope="module")
def wide():
    return [(k, (k * 137.508) % 360, math.degrees(math.asin(1 - (2 * k + 1) / 150))) for k in range(150)]


@pytest.mark.parametrize("tiling", ["cubedsphere", "similar_radius", "healpix"])
@pytest.mark.parametrize("upper", [2000.0, 6000.0])
def test_wide_bins_on_every_tiling(spark, wide, tiling, upper):
    bins = Binning.linear(0, upper, 4)
    assert as_dict(pairs.pair_counts_on_tiling(frame(spark, wide), bins, tiling)) == brute_counts(wide, bins)


def test_no_resolution_for_very_wide_bins(spark):
    wide = Binning.linear(0, 10_000, 1)
    for tiling in ("cubedsphere", "similar_radius", "healpix"):
        assert join_base(tiling, wide) == spark.range(1).select(coarse_base(tiling, F.lit(5000.0))).first()[0] == 0


def test_positions_that_are_no_numbers(spark):
    good = [(k, 10.0 + k, 5.0) for k in range(10)]
    odd = [(10, NAN, 1.0), (11, 1.0, NAN), (12, NAN, NAN), (13, NAN, NAN), (14, INF, 1.0), (15, None, 1.0)]
    sky, bins = frame(spark, good + odd), Binning.linear(0, 900, 1)
    assert as_dict(pairs.pair_counts(sky, bins)) == {0: 45}
    assert graph.degrees(sky, 900).count() == 10
    assert pairs.pair_list(sky, 900).count() == 45
    for tiling in ("cubedsphere", "similar_radius", "healpix"):
        assert reduce.weighted_cells(sky, tiling, 8).agg(F.sum("w")).first()[0] == 10
        assert pairs.stage_counts(sky, Binning.linear(0, 100, 1), tiling).first()["Ndata"] == 10
        angle = F.lit(NAN)
        assert spark.range(2).withColumns({"theta": angle, "phi": angle}).transform(
            lambda d, t=tiling: tiles.assign_pixel(d, t, 8)).count() == 2


@pytest.mark.parametrize("imin, imax", [(0, 19), (3, 7), (12, 19)])
def test_separations_just_below_the_last_edge(spark, imin, imax):
    bins = Binning.log(2.5, 250.0, 20).slice(imin, imax)
    r2 = bins.rmax * bins.rmax
    below = [r2]
    for _ in range(6):
        below.append(math.nextafter(below[-1], 0.0))
    rows = spark.createDataFrame([(v,) for v in below], "r2 double").where(bins.inside(F.col("r2")))
    assert rows.count() >= 5 and {r[0] for r in rows.select(bins.index(F.col("r2"))).collect()} == {imax}


def test_columns_parted_by_runs_of_blanks(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a  b c\n1   5 x\n 2 6    y  \n\n3 7 z\n")
    rows = catalogue.read_columns(spark, str(tmp_path / "t.txt"), "a int, b double, c string").collect()
    assert sorted(map(tuple, rows)) == [(1, 5.0, "x"), (2, 6.0, "y"), (3, 7.0, "z")]


def test_healpix_tables_have_twelve_faces(spark):
    rows = catalogue.centre_table(spark, "healpix", 4).groupBy("face").count().collect()
    assert sorted(map(tuple, rows)) == [(f, 16) for f in range(12)]
    around = catalogue.neighbour_table(spark.createDataFrame([(3,)], "ipix long"), "healpix", 4)
    assert around.where("face between 0 and 11 and i between 0 and 3 and j between 0 and 3").count() == 9


def test_large_pixel_numbers(spark):
    n = 1 << 28
    pixel = 11 * n * n + (n * n - 2)
    row = tiles.with_decoded(spark.createDataFrame([(pixel,)], "ipix long"), n, tiling="healpix").first()
    assert (row["face"], row["i"], row["j"]) == (11, n - 2, n - 1)
    cube = ((n - 1) * n + n - 2) * 10 + 3
    row = tiles.with_decoded(spark.createDataFrame([(cube,)], "ipix long"), n).first()
    assert (row["face"], row["i"], row["j"]) == (3, n - 1, n - 2)


def test_the_crowded_query_takes_the_pyramid(spark):
    from skypairs.operators.pyramid import choose_halvings, distinct_positions
    from suite.inputs import crowded_sky
    from suite.queries import CROWD_BINS

    points = pairs.catalogue_vectors(crowded_sky(spark, "/root/testdata/sf0.01"))
    positions = distinct_positions(points.withColumn("w", F.lit(1).cast("long")))
    assert choose_halvings(points, CROWD_BINS) > 0
