"""Bins, resolutions, statistics, run logs and file formats."""

import math

import pytest
from pyspark.sql import functions as F

from skypairs.functions.binning import Binning
from skypairs.operators import quality, resolution, stats, tiles
from skypairs.plans.jobs import PairCountJob, write_pixel_sample
from skypairs.sources import catalogue, run_log

BINS = Binning.log(2.5, 250.0, 20)
# Resolutions for reducing and for joining, for each of the 20 bins.
SETUP = {
    "similar_radius": ([11958, 9498, 7544, 5994, 4760, 3782, 3004, 2386, 1896, 1506, 1196, 950, 756, 600,
                        476, 380, 302, 240, 190, 152],
                       [1296, 1028, 816, 648, 516, 408, 324, 258, 204, 162, 128, 102, 80, 64, 50, 40, 32, 24,
                        20, 16]),
    "cubedsphere": ([13696, 10880, 8642, 6864], [1216, 966, 766, 610]),
    "healpix": ([16384, 16384, 8192, 8192], [512, 512, 256, 256]),
}


@pytest.mark.parametrize("tiling", SETUP)
def test_published_resolutions(spark, tiling):
    rows = resolution.bin_setup(spark, BINS, tiling, tiling).orderBy("ibin").collect()
    fine, coarse = SETUP[tiling]
    assert [r["nbaseD"] for r in rows][:len(fine)] == fine
    assert [r["nbaseJ"] for r in rows][:len(coarse)] == coarse
    for k, r in enumerate(rows):
        one = BINS.slice(k, k)
        assert resolution.join_base(tiling, one) == r["nbaseJ"]
        assert resolution.reduce_base(tiling, one) == r["nbaseD"]


def test_bin_edges(spark):
    rows = BINS.slice(3, 5).table(spark).orderBy("ibin").collect()
    assert [r["ibin"] for r in rows] == [3, 4, 5]
    for r in rows:
        assert math.isclose(r["lo"], BINS.edge(r["ibin"])) and math.isclose(r["hi"], BINS.edge(r["ibin"] + 1))
    with pytest.raises(ValueError):
        Binning.of_type("other", 1, 2, 3)
    with pytest.raises(ValueError):
        BINS.slice(5, 20)


def test_older_resolution_rule():
    assert resolution.radius_nside(20.0) == 128
    assert resolution.radius_nside(2.5, coarser=1) == 512


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,), (None,), (float("nan"),)], "v double")
    rows = stats.histogram(df, "v", 10).collect()
    assert {(round(r["loc"], 6), r["count"]) for r in rows} == {(0.5, 1), (1.5, 1), (9.5, 1)}
    two = df.select("v", F.col("v").alias("w"))
    assert stats.histogram2d(two, "v", "w", 10, 10).agg(F.sum("count")).first()[0] == 4
    assert stats.histogram2d(two, "v", "w", 10, 10, ((0, 10), (0, 10))).agg(F.sum("count")).first()[0] == 3
    assert stats.histogram2d(two, "v", "w", 4, 5, dense=True).count() == 20
    assert stats.missing_count(df).first()[0] == 2
    assert stats.missing_fraction(df, "v").first()[0] == pytest.approx(1 / 3)


def test_width_at_half_height(spark):
    h = spark.createDataFrame([(float(k), 100 - 10 * abs(k)) for k in range(-9, 10)], "loc double, count long")
    assert stats.histogram_fwhm(h).first()[0] == pytest.approx(10.0)
    m = stats.histogram_moments(h).first()
    assert m["mode"] == 0.0 and m["mean"] == pytest.approx(0.0) and m["skew"] == pytest.approx(0.0)


def test_run_log_summary(spark, tmp_path):
    lines = ["m imin imax Ndata", "x@@ 0 10 100 900 1.5e+03 128 98304 16 4 4 4 10 20 0 70 1.5",
             "x@@ 0 10 100 900 1.5e+03 128 98304 16 4 4 4 20 20 0 60 2.5",
             "x@@ 0 10 100 900 1.5e+03 128 98304 8 4 4 4 10 10 10 10 4"]
    (tmp_path / "run.db").write_text("\n".join(lines))
    log = run_log.read_run_log(spark, str(tmp_path / "run.db"), "x@@")
    rows = {r["nodes"]: r for r in run_log.time_by_nodes(log).collect()}
    assert rows[16]["t"] == 2.0 and rows[16]["sig"] == 0.5 and rows[16]["ts"] == 15.0 and rows[16]["runs"] == 2
    shares = {r["nodes"]: r for r in run_log.phase_shares(run_log.time_by_nodes(log)).collect()}
    assert shares[16]["source"] == 15.0 and shares[8]["join"] == 50.0


def test_files(spark, tmp_path):
    write_pixel_sample(spark, str(tmp_path / "s"), "cubedsphere", 10, 500, seed=1)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.columns == ["theta", "phi", "ipix", "theta_c", "phi_c"] and back.count() == 500
    catalogue.write_table(catalogue.centre_table(spark, "cubedsphere", 4), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 96
    one = tiles.pixel_table(spark, "cubedsphere", 4).where("ipix = 50")
    catalogue.write_table(catalogue.neighbour_table(one, "cubedsphere", 4), str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 9
    (tmp_path / "t.csv").write_text("id N\n1 5\n2 6\n")
    assert catalogue.read_columns(spark, str(tmp_path / "t.csv"), "id int, N long").count() == 2


def test_random_sky_is_seeded(spark):
    a, b = (quality.random_sky(spark, 300, seed=4, partitions=2) for _ in range(2))
    assert a.exceptAll(b).count() == 0
    assert a.where(~F.col("theta").between(0, math.pi) | ~F.col("phi").between(0, 2 * math.pi)).count() == 0


def test_job(spark, tmp_path):
    sky = quality.random_sky(spark, 3000, seed=2).select(
        F.monotonically_increasing_id().alias("key"), F.degrees("phi").alias("RA"),
        (90 - F.degrees("theta")).alias("DEC"))
    catalogue.write_table(sky, str(tmp_path / "sky"))
    settings = dict(data=str(tmp_path / "sky"), n_bins=20, bin_min=2.5, bin_max=250.0, imin=10, imax=19,
                    ra_name="RA", dec_name="DEC")
    cells = PairCountJob(**settings).exact(spark).collect()
    assert cells == PairCountJob(cover="cubedsphere", **settings).exact(spark).collect()
    assert [r["ibin"] for r in PairCountJob(**settings | {"imin": 15}).reduced(spark).collect()] == [15, 16, 17, 18, 19]


def test_queries_over_whole_tilings_and_all_bins(spark):
    from suite.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    for name, n in (("til9_cubed_sphere_centre", 86_400), ("til11_healpix_centre", 49_152), ("agg19_geometry_cubed_sphere", 9_600)):
        assert QUERIES[f"{name}_all_pixels"](spark, folder).select("ipix").distinct().count() == n
    counts = {k: sorted(map(tuple, QUERIES[k](spark, folder).select("ibin", "Nbin").collect()))
              for k in ("set1_union_of_counts_all_bins", "agg1_pair_counts_log")}
    assert counts["set1_union_of_counts_all_bins"] == counts["agg1_pair_counts_log"]
