"""One query per operator, each over whole tables. Doubles are rounded to 8 digits, because sine and
arc cosine differ in the last bit between engines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skypairs.functions import binning as B
from skypairs.functions import cube_faces, geometry, similar_radius
from skypairs.functions.binning import Binning
from skypairs.operators import graph, pairs, quality, reduce, resolution, stats, symmetry, tiles
from skypairs.sources import catalogue, run_log

from .inputs import (BINS, LINEAR, angles, crowded_sky, customer_sky, embedding_points, log_lines, next_pairs, sky,
                     sky_with_gaps, table, twin_sky, uneven_sky, vectors)

CROWD_BINS = Binning.linear(0.0, 30.0, 6)
UNEVEN_BINS = Binning.linear(1.0, 61.0, 6)
TWIN_BINS = Binning.linear(0.0, 0.002, 1)
WIDE_BINS = Binning.linear(0.0, 6000.0, 6)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) for c in columns})


def xyz(suffix: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{c}_{suffix}") for c in "xyz")


# ---- scans ----

@query
def src1_catalogue_scan(spark, d):
    return catalogue.read_catalogue(spark, f"{d}/orders.parquet", "o_orderkey", "o_totalprice")


@query
def src2_scan_without_columns(spark, d):
    return catalogue.read_without(spark, f"{d}/orders.parquet", "o_orderdate", "o_orderpriority", "none")


@query
def src4_run_log_exact(spark, d):
    return run_log.parse_run_log(log_lines(spark, d, False), "x@@")


@query
def src4_run_log_reduced(spark, d):
    return run_log.parse_run_log(log_lines(spark, d, True), "r@@")


# ---- projections ----

@query
def prj1_angles(spark, d):
    return rounded(angles(spark, d), "theta", "phi")


@query
def prj2_unit_vector(spark, d):
    return rounded(vectors(spark, d).select("id", "x", "y", "z"), "x", "y", "z")


@query
def prj3_vector_to_angles(spark, d):
    t, p = geometry.unit_vector_angles(*map(F.col, "xyz"))
    return rounded(vectors(spark, d).select("id", t.alias("theta"), p.alias("phi")), "theta", "phi")


@query
def prj4_vector_spherical(spark, d):
    r, t, p = geometry.vector_spherical(*map(F.col, "xyz"))
    return rounded(embedding_points(spark, d).select("vec_id", r.alias("r"), t.alias("theta"),
                                                     p.alias("phi")), "r", "theta", "phi")


@query
def prj5_row_id(spark, d):
    return pairs.with_row_id(table(spark, d, "orders"), "o_orderkey").select("id")


@query
def prj5_row_numbers(spark, d):
    """Ids for a table whose key is not unique, in the order of its columns."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return pairs.with_row_id(lines)


@query
def src3_random_directions(spark, d):
    """A direction drawn for every order."""
    return rounded(quality.sky_of_keys(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 42), "theta", "phi")


@query
def prj6_7_8_distances(spark, d):
    r = geometry.chord(xyz("s"), xyz("t"))
    return rounded(next_pairs(spark, d).select(
        "id_s", geometry.chord2(xyz("s"), xyz("t")).alias("r2"), r.alias("r"),
        F.round(geometry.arc_arcmin(r), 5).alias("arcmin")), "r2", "r")


@query
def prj9_tangent_residuals(spark, d):
    dx, dy = geometry.tangent_residuals(*map(F.col, ("theta_s", "phi_s", "theta_t", "phi_t")), 0.1)
    return rounded(next_pairs(spark, d).select("id_s", dx.alias("dx"), dy.alias("dy")), "dx", "dy")


def _binned(spark, d, bins: Binning):
    df = next_pairs(spark, d).withColumn("r2", geometry.chord2(xyz("s"), xyz("t")))
    return df.where(bins.inside(F.col("r2"))).select("id_s", bins.index(F.col("r2")).alias("ibin"))


@query
def prj10_13_log_bin(spark, d):
    return _binned(spark, d, Binning.log(60.0, 6000.0, 20).slice(3, 18))


@query
def prj11_linear_bin(spark, d):
    return _binned(spark, d, Binning.linear(60.0, 6060.0, 12))


@query
def prj12_14_pair_columns(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("w"))
    s, t = (o.select(*(F.col(c).alias(f"{c}_{x}") for c in o.columns)) for x in "st")
    return s.join(t, F.col("id_s") + 1 == F.col("id_t")).select(
        "id_s", "id_t", (F.col("w_s") * F.col("w_t")).alias("prod"))


# ---- filters ----

@query
def flt5_redshift_slice(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000.0).alias("z"),
                                         (F.col("o_custkey") / 1000000.0).alias("rsd"))
    return geometry.redshift_slice(o, 1.0, 2.0, "z", "rsd").select("o_orderkey")


@query
def flt6_in_bounds(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return stats.in_bounds(e, "value", 10.0, 90.0)


@query
def flt7_valid_pixel(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ipix"))
    return o.where(cube_faces.is_valid(F.col("ipix"), 20))


# ---- tilings ----

def _pixels(spark, d, tiling, nbase):
    return tiles.assign_pixel(angles(spark, d), tiling, nbase).select("id", "ipix")


def _occupied(spark, d, tiling, nbase):
    return _pixels(spark, d, tiling, nbase).select("ipix").distinct()


@query
def til1_cubed_sphere_pixel(spark, d):
    return _pixels(spark, d, "cubedsphere", 120)


@query
def til2_similar_radius_pixel(spark, d):
    return _pixels(spark, d, "similar_radius", 128)


@query
def til3_healpix_pixel(spark, d):
    return _pixels(spark, d, "healpix", 64)


@query
def til4_face(spark, d):
    return tiles.with_face(angles(spark, d)).select("id", "face")


@query
def til5_decode_encode(spark, d):
    df = tiles.with_decoded(_pixels(spark, d, "cubedsphere", 120), 120)
    return df.withColumn("again", cube_faces.encode(F.col("face"), F.col("i"), F.col("j"), 120))


@query
def til6_local_index(spark, d):
    return tiles.local_index(angles(spark, d), 40).select("id", "face", "quadrant", "i", "j")


@query
def til7_quadrant_bins(spark, d):
    df = tiles.with_decoded(_pixels(spark, d, "cubedsphere", 40), 40)
    q, a, b = similar_radius.face_to_quadrant_bins(F.col("i"), F.col("j"), 40)
    df = df.select("id", "i", "j", q.alias("q"), a.alias("a"), b.alias("b"))
    i2, j2 = similar_radius.quadrant_to_face_bins(F.col("q"), F.col("a"), F.col("b"), 40)
    return df.withColumns({"i2": i2, "j2": j2})


@query
def til8_quadrant_nodes(spark, d):
    df = tiles.with_decoded(_pixels(spark, d, "cubedsphere", 40), 40)
    q, a, b = similar_radius.face_to_quadrant_nodes(F.col("i"), F.col("j"), 40)
    df = df.select("id", "i", "j", q.alias("q"), a.alias("a"), b.alias("b"))
    i2, j2 = similar_radius.quadrant_to_face_nodes(F.col("q"), F.col("a"), F.col("b"), 40)
    return df.withColumns({"i2": i2, "j2": j2})


def _centres(spark, d, tiling, nbase):
    df = tiles.pixel_centres(_occupied(spark, d, tiling, nbase), tiling, nbase)
    return rounded(df, "theta_c", "phi_c")


@query
def til9_cubed_sphere_centre(spark, d):
    return _centres(spark, d, "cubedsphere", 120)


@query
def til10_similar_radius_centre(spark, d):
    return _centres(spark, d, "similar_radius", 128)


@query
def til11_healpix_centre(spark, d):
    return _centres(spark, d, "healpix", 64)


def _corners(spark, d, tiling, nbase, like=None):
    df = tiles.pixel_corners(_occupied(spark, d, like or tiling, nbase), tiling, nbase)
    return rounded(df.select("ipix", F.posexplode("corners").alias("corner", "p"))
                   .select("ipix", "corner", "p.x", "p.y", "p.z"), "x", "y", "z")


@query
def til12_cubed_sphere_corners(spark, d):
    return _corners(spark, d, "cubedsphere", 40)


@query
def til12_similar_radius_corners(spark, d):
    return _corners(spark, d, "similar_radius", 40)


@query
def til12_quad_cube_corners(spark, d):
    return _corners(spark, d, "quadcube", 40, "cubedsphere")


@query
def til12_healpix_corners(spark, d):
    return _corners(spark, d, "healpix", 32)


@query
def til13_cube_neighbours(spark, d):
    return tiles.explode_neighbours(_occupied(spark, d, "cubedsphere", 40), "cubedsphere", 40)


@query
def til14_healpix_neighbours(spark, d):
    return tiles.explode_neighbours(_occupied(spark, d, "healpix", 16), "healpix", 16)


@query
def til15_flt4_padded_neighbours(spark, d):
    df = tiles.neighbours(_occupied(spark, d, "cubedsphere", 10), "cubedsphere", 10, pad=True)
    df = df.select("ipix", F.size("neighbours").alias("n_padded"), F.explode("neighbours").alias("at"))
    return df.where("at <> -1").groupBy("ipix", "n_padded").agg(F.count("*").alias("n"))


@query
def til16_pixel_table_occupancy(spark, d):
    """All pixels with the number of points in each, empty ones included."""
    count = quality.occupancy(_pixels(spark, d, "cubedsphere", 40))
    return (tiles.pixel_table(spark, "cubedsphere", 40).join(count, "ipix", "left")
            .select("ipix", F.coalesce("count", F.lit(0).cast("long")).alias("n")))


@query
def til18_multi_resolution(spark, d):
    return tiles.assign_pixels(angles(spark, d), "healpix", [32, 64, 128]).drop("theta", "phi")


@query
def til19_make_cells(spark, d):
    df = tiles.assign_pixels(angles(spark, d), "healpix", [32])
    return rounded(reduce.make_cells(df, "healpix", 32), "x32", "y32", "z32")


@query
def til18_til19_rolled_cells(spark, d):
    """Cells of four resolutions from one count."""
    return rounded(reduce.rolled_cells(sky(spark, d), [16, 32, 64, 128]), "x", "y", "z")


def _speed(spark, d, tiling, nbase):
    return rounded(quality.tiling_speed(angles(spark, d), tiling, nbase), "min_theta_c", "min_phi_c")


@query
def til20_speed_cubed_sphere(spark, d):
    return _speed(spark, d, "cubedsphere", 40)


@query
def til20_speed_similar_radius(spark, d):
    return _speed(spark, d, "similar_radius", 40)


@query
def til20_speed_healpix(spark, d):
    return _speed(spark, d, "healpix", 32)


# ---- joins ----

def _candidates(spark, d, tiling, reach):
    bins = Binning.linear(0.0, reach, 1)
    nbase = resolution.join_base(tiling, bins)
    v = geometry.with_unit_vector(tiles.assign_pixel(angles(spark, d), tiling, nbase))
    v = v.select("id", "ipix", "x", "y", "z")
    df = pairs.tiling_candidates(v, tiling, nbase).where(bins.inside(pairs.pair_r2()))
    return df.select(F.least("id_a", "id_b").alias("id"), F.greatest("id_a", "id_b").alias("id2"))


@query
def jon1_neighbour_join_cubed_sphere(spark, d):
    return _candidates(spark, d, "cubedsphere", 100.0)


@query
def jon2_neighbour_join_healpix(spark, d):
    return _candidates(spark, d, "healpix", 100.0)


@query
def jon3_flt2_flt3_pair_list(spark, d):
    return pairs.pair_list(sky(spark, d), 100.0)


@query
def jon4_attach_bins(spark, d):
    """Order prices in logarithmic bins, with the edges of each bin."""
    bins = Binning.log(1000.0, 1000000.0, 30)
    p = F.col("o_totalprice")
    t = bins.table(spark)
    i = F.floor((F.log(p) - F.log(F.lit(1000.0))) / ((F.log(F.lit(1e6)) - F.log(F.lit(1000.0))) / 30))
    counts = (table(spark, d, "orders").where((p >= 1000.0) & (p < 1e6))
              .groupBy(i.cast("int").alias("ibin")).agg(F.count("*").alias("Nbin")))
    return rounded(B.attach_bins(counts, bins), "lo", "hi", "width")


@query
def jon5_agg23_exact_vs_reduced(spark, d):
    s = sky(spark, d)
    bins = BINS
    df = reduce.compare_counts(pairs.pair_counts(s, bins), reduce.reduced_pair_counts(s, bins, "cubedsphere", 400))
    return rounded(df, "rel")


def _bins_of_prices(spark, d):
    """Bins made from the data: one per customer, from its least and greatest order price."""
    c = table(spark, d, "orders").groupBy("o_custkey").agg(
        (F.min("o_totalprice") / 1000.0).alias("lo"), (F.max("o_totalprice") / 1000.0 + 1.0).alias("hi"))
    return c.select("o_custkey", "lo", "hi", (F.col("hi") - F.col("lo")).alias("width"))


@query
def jon6_two_bin_setups(spark, d):
    a = resolution.with_resolutions(_bins_of_prices(spark, d), "cubedsphere", "cubedsphere")
    b = resolution.with_resolutions(_bins_of_prices(spark, d), "similar_radius", "similar_radius")
    return a.select("o_custkey", F.col("nbaseD").alias("d_cs"), F.col("nbaseJ").alias("j_cs")).join(
        b.select("o_custkey", F.col("nbaseD").alias("d_sr"), F.col("nbaseJ").alias("j_sr")), "o_custkey")


# ---- aggregations ----

def _counts(df):
    return rounded(df, "lo", "hi", "width")


@query
def agg1_pair_counts_log(spark, d):
    return _counts(pairs.pair_counts(sky(spark, d), BINS))


@query
def agg1_pair_counts_log_arc(spark, d):
    return _counts(pairs.pair_counts(sky(spark, d), Binning.log(2.5, 250.0, 20, metric="arc")))


@query
def agg1_pair_counts_bulk(spark, d):
    """The same counts with bulk counting at work: cubes of more than four points are halved."""
    return _counts(pairs.pair_counts(sky(spark, d), BINS, halvings=3, crowd=4))


@query
def agg1_pair_counts_crowded(spark, d):
    """Patches crowded enough that the operator takes the pyramid by itself."""
    return _counts(pairs.pair_counts(crowded_sky(spark, d), CROWD_BINS))


@query
def agg1_pair_counts_uneven(spark, d):
    """Densities that differ more than 10,000-fold: cubes are split as deep as each region needs."""
    return _counts(pairs.pair_counts(uneven_sky(spark, d), UNEVEN_BINS))


@query
def agg7_degrees_uneven(spark, d):
    return graph.degrees(uneven_sky(spark, d), 5.0)


@query
def agg7_degrees_directed_uneven(spark, d):
    """Each edge counted at its smaller id, on a sky crowded enough for pairs of cubes."""
    return graph.degrees(uneven_sky(spark, d), 5.0, directed=True)


@query
def agg7_degrees_directed_crowded(spark, d):
    """The same on patches where positions have copies."""
    return graph.degrees(crowded_sky(spark, d), 10.0, directed=True)


@query
def agg1_pair_counts_twins(spark, d):
    """A reach below the finest cubes."""
    return _counts(pairs.pair_counts(twin_sky(spark, d), TWIN_BINS))


@query
def jon3_pair_list_twins(spark, d):
    return pairs.pair_list(twin_sky(spark, d), 0.002)


@query
def agg1_pair_counts_with_gaps(spark, d):
    return _counts(pairs.pair_counts(sky_with_gaps(spark, d), LINEAR))


@query
def agg5_weighted_cells_with_gaps(spark, d):
    return rounded(reduce.weighted_cells(sky_with_gaps(spark, d), "similar_radius", 40), "x", "y", "z")


@query
def agg7_degrees_with_gaps(spark, d):
    return graph.degrees(sky_with_gaps(spark, d), 100.0)


@query
def agg7_degrees_crowded(spark, d):
    return graph.degrees(crowded_sky(spark, d), 10.0)


@query
def jon3_pair_list_crowded(spark, d):
    return pairs.pair_list(crowded_sky(spark, d), 0.5)


def _wide(tiling):
    def run(spark, d):
        return _counts(pairs.pair_counts_on_tiling(customer_sky(spark, d), WIDE_BINS, tiling))
    run.__name__ = f"agg1_wide_counts_{tiling}"
    return query(run)


for _tiling in tiles.TILINGS:
    _wide(_tiling)


@query
def agg1_pair_counts_on_similar_radius(spark, d):
    return _counts(pairs.pair_counts_on_tiling(sky(spark, d), BINS, "similar_radius"))


@query
def agg1_pair_counts_on_cubed_sphere(spark, d):
    return _counts(pairs.pair_counts_on_tiling(sky(spark, d), BINS, "cubedsphere"))


@query
def agg2_pair_counts_linear(spark, d):
    return _counts(pairs.pair_counts(sky(spark, d), LINEAR))


@query
def agg3_reduced_counts_log(spark, d):
    return _counts(reduce.reduced_pair_counts(sky(spark, d), BINS, "cubedsphere", 400))


@query
def agg3_reduced_counts_default_cells(spark, d):
    """Tiling and resolution of the cells are those that the operator derives from the bins."""
    return _counts(reduce.reduced_pair_counts(sky(spark, d), BINS.slice(15, 19)))


@query
def agg4_reduced_counts_linear(spark, d):
    return _counts(reduce.reduced_pair_counts(sky(spark, d), Binning.linear(2.5, 252.5, 5), "healpix", 256))


@query
def agg5_weighted_cells(spark, d):
    return rounded(reduce.weighted_cells(sky(spark, d), "similar_radius", 40), "x", "y", "z")


@query
def agg6_total_pairs(spark, d):
    return pairs.total_pairs(pairs.pair_counts(sky(spark, d), BINS))


@query
def agg7_degrees(spark, d):
    return graph.degrees(sky(spark, d), 100.0)


@query
def agg7_degrees_bulk(spark, d):
    return graph.degrees(sky(spark, d), 100.0, halvings=2, crowd=1)


@query
def agg7_degrees_directed(spark, d):
    return graph.degrees(sky(spark, d), 100.0, directed=True)


@query
def agg8_degree_summary(spark, d):
    return rounded(graph.degree_summary(graph.degrees(sky(spark, d), 100.0)), "mean", "stddev")


@query
def agg9_min_max(spark, d):
    return stats.min_max(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")


@query
def agg10_missing_count(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("value") > 10, F.col("value")))
    return stats.missing_count(e.select("event_id", "v"))


@query
def agg11_missing_fraction(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("value") > 10, F.col("value")))
    return rounded(stats.missing_fraction(e, "v"), "missing_fraction")


@query
def agg12_histogram(spark, d):
    return rounded(stats.histogram(table(spark, d, "lineitem"), "l_extendedprice"), "loc")


@query
def agg12_histogram_bounded(spark, d):
    return rounded(stats.histogram(table(spark, d, "customer"), "c_acctbal", 40, (0.0, 8000.0)), "loc")


@query
def agg13_histogram_2d(spark, d):
    df = stats.histogram2d(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", 20, 10)
    return df.select("bin1", "bin2", "count")


@query
def agg13_histogram_2d_dense(spark, d):
    df = stats.histogram2d(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", 12, 8,
                           ((0.0, 60000.0), (1.0, 51.0)), dense=True)
    return rounded(df, "loc1", "loc2")


@query
def agg14_column_statistics(spark, d):
    df = stats.column_statistics(table(spark, d, "customer"), "c_acctbal")
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query
def agg15_histogram_moments(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("loc")).agg(F.count("*").alias("count"))
    return stats.histogram_moments(h).withColumns(
        {c: F.round(c, 6) for c in ("mean", "stdev", "skew", "kurtosis")})


@query
def agg15_histogram_fwhm(spark, d):
    price = F.floor(F.col("l_extendedprice") / 5000.0).cast("double")
    h = table(spark, d, "lineitem").groupBy(price.alias("loc")).agg(F.count("*").alias("count"))
    return rounded(stats.histogram_fwhm(h), "fwhm")


def _residuals(spark, d, nbase=20):
    return quality.with_residuals(quality.sample_with_centres(angles(spark, d), "cubedsphere", nbase),
                                  "cubedsphere", nbase)


@query
def agg16_sampled_radii(spark, d):
    df = quality.sampled_radii(_residuals(spark, d), "cubedsphere", 20)
    return rounded(df, "Rmax", "Rmin", "Rin", "Rin_rel", "Rout_rel")


@query
def agg17_residual_map(spark, d):
    return rounded(quality.residual_map(_residuals(spark, d)).select("bin1", "bin2", "count", "log_count"),
                   "log_count")


@query
def agg18_occupancy(spark, d):
    occ = quality.occupancy(_pixels(spark, d, "cubedsphere", 20))
    return rounded(stats.histogram(occ, "count", 10, (0.0, occ.agg(F.max("count")).first()[0] + 1.0)), "loc")


def _geometry(spark, d, tiling, nbase, like=None):
    df = quality.tile_geometry(_occupied(spark, d, like or tiling, nbase), tiling, nbase)
    return df.withColumns({c: F.round(c, 6) for c in ("area", "ellipticity", "outer", "inner")})


@query
def agg19_geometry_cubed_sphere(spark, d):
    return _geometry(spark, d, "cubedsphere", 40)


@query
def agg19_geometry_similar_radius(spark, d):
    return _geometry(spark, d, "similar_radius", 40)


@query
def agg19_geometry_quad_cube(spark, d):
    return _geometry(spark, d, "quadcube", 40, "cubedsphere")


@query
def agg19_geometry_healpix(spark, d):
    return _geometry(spark, d, "healpix", 32)


@query
def agg20_geometry_summary(spark, d):
    df = quality.tile_geometry(_occupied(spark, d, "similar_radius", 40), "similar_radius", 40)
    return quality.geometry_summary(df).select(F.round("min_inner", 6).alias("min_inner"),
                                               F.round("max_outer", 6).alias("max_outer"))


@query
def agg20_radius_histogram(spark, d):
    df = quality.tile_geometry(_occupied(spark, d, "cubedsphere", 40), "cubedsphere", 40)
    return rounded(quality.radius_histogram(df.withColumn("outer", F.round("outer", 6)), "outer"), "loc")


@query
def agg21_time_by_nodes(spark, d):
    log = run_log.parse_run_log(log_lines(spark, d, True), "r@@")
    df = run_log.time_by_nodes(log)
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c not in ("nodes", "runs", *run_log.SETTINGS)})


@query
def agg22_phase_shares(spark, d):
    log = run_log.parse_run_log(log_lines(spark, d, False), "x@@")
    df = run_log.phase_shares(run_log.time_by_nodes(log))
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c != "nodes"})


@query
def agg24_stage_counts(spark, d):
    return pairs.stage_counts(sky(spark, d), BINS)


@query
def agg24_observed_stages(spark, d):
    """Row counts of the stages, observed while the pairs are counted."""
    return pairs.counts_with_stages(sky(spark, d), BINS, nbase=14)[1]


# ---- bins ----

@query
def bin1_log_bins_of_data(spark, d):
    """Twenty logarithmic bins per customer, from its price range."""
    b = _bins_of_prices(spark, d)
    step = (F.log("hi") - F.log("lo")) / 20
    edges = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.exp(F.log("lo") + i * step))
    df = b.select("o_custkey", F.posexplode(B.intervals(edges)).alias("ibin", "e"))
    return rounded(df.select("o_custkey", "ibin", "e.lo", "e.hi"), "lo", "hi")


@query
def bin2_ary4_linear_bins_of_data(spark, d):
    b = _bins_of_prices(spark, d)
    edges = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("lo") + i * F.col("width") / 5)
    df = b.select("o_custkey", F.posexplode(B.intervals(edges)).alias("ibin", "e"))
    return rounded(df.select("o_custkey", "ibin", "e.lo", "e.hi"), "lo", "hi")


@query
def bin3_bin_range(spark, d):
    return _counts(pairs.pair_counts(sky(spark, d), BINS.slice(5, 12)))


@query
def bin4_5_resolutions_cube(spark, d):
    return resolution.with_resolutions(_bins_of_prices(spark, d)).select(
        "o_custkey", "nbaseD", "NpixD", "nbaseJ", "NpixJ")


@query
def bin4_bin_setup(spark, d):
    """Bins over the range of the data's prices, as a job sets them up."""
    top = table(spark, d, "orders").agg(F.max("o_totalprice")).first()[0]
    df = resolution.bin_setup(spark, Binning.log(2.5, float(top) / 1000.0, 20))
    return rounded(df, "lo", "hi", "width")


@query
def udf1_column_forms(spark, d):
    """Pixel, its centre and its neighbours as columns of one select."""
    ipix = tiles.pixel_of("cubedsphere", 40, F.col("theta"), F.col("phi"))
    df = angles(spark, d).select("id", ipix.alias("ipix")).select(
        "id", "ipix", tiles.pixel_centre_of("cubedsphere", 40, F.col("ipix")).alias("c"),
        tiles.neighbours_of("cubedsphere", 40, F.col("ipix")).alias("around"))
    return rounded(df.select("id", "ipix", F.col("c.x").alias("x"), F.col("c.y").alias("y"), F.col("c.z").alias("z"),
                             F.size("around").alias("n"), F.array_min("around").alias("least")), "x", "y", "z")


@query
def bin6_resolutions_healpix(spark, d):
    return resolution.with_resolutions(_bins_of_prices(spark, d), "healpix", "healpix").select(
        "o_custkey", "nbaseD", "NpixD", "nbaseJ", "NpixJ")


@query
def bin8_radius_nside(spark, d):
    b = _bins_of_prices(spark, d)
    return b.select("o_custkey", resolution.radius_nside_of(F.col("hi")).alias("nside"))


# ---- order, sets, arrays, placement ----

@query
def srt1_lim1_first_bins(spark, d):
    return _counts(pairs.pair_counts(sky(spark, d), BINS).orderBy("ibin").limit(5))


@query
def set1_union_of_counts(spark, d):
    s = sky(spark, d)
    a, b = (pairs.pair_counts(s, BINS.slice(*r)) for r in ((10, 14), (15, 19)))
    return _counts(a.unionByName(b))


@query
def ary1_2_3_set2_neighbour_arrays(spark, d):
    df = tiles.neighbours(_occupied(spark, d, "cubedsphere", 40), "cubedsphere", 40)
    return df.select("ipix", F.size("neighbours").alias("n"), F.get("neighbours", 8).alias("none"),
                     F.size(F.array_distinct("neighbours")).alias("n_distinct"))


@query
def plc1_partitioned_counts(spark, d):
    return _counts(pairs.pair_counts(sky(spark, d), BINS, num_partitions=16))


@query
def plc1_bucketed_counts(spark, d):
    """Counts over a catalogue stored in buckets by pixel."""
    name = f"sky_{uuid.uuid4().hex}"
    pairs.store_for_pairs(sky(spark, d), name, BINS, buckets=16)
    return _counts(pairs.stored_pair_counts(spark, name, BINS))


def _rings(tiling):
    def counts(spark, d):
        nbase = 4 * resolution.join_base(tiling, BINS)
        return _counts(pairs.pair_counts_on_tiling(sky(spark, d), BINS, tiling, nbase=nbase))
    counts.__name__ = f"jon1_jon2_rings_{tiling}"
    return query(counts)


for _tiling in tiles.TILINGS:
    _rings(_tiling)


@query
def plc2_stored_counts(spark, d):
    """The positions stored while the jobs of one count run."""
    return _counts(pairs.pair_counts_kept(uneven_sky(spark, d), UNEVEN_BINS))


# ---- whole tilings and whole bin ranges: the queries above of the same name count a part (occupied pixels, some bins) ----

def _all_pixels(spark, d, tiling, nbase):
    """Every pixel of a tiling, with its number of points."""
    count = quality.occupancy(_pixels(spark, d, tiling, nbase))
    return (tiles.pixel_table(spark, tiling, nbase).join(count, "ipix", "left")
            .select("ipix", F.coalesce("count", F.lit(0).cast("long")).alias("n")))


def _whole(name, run):
    def whole(spark, d):
        return run(lambda tiling, nbase: _all_pixels(spark, d, tiling, nbase))
    whole.__name__ = f"{name}_all_pixels"
    return query(whole)


def _whole_geometry(pixels, tiling, nbase, like=None):
    return quality.tile_geometry(pixels(like or tiling, nbase), tiling, nbase)


for _name, _tiling, _nbase in (("til9_cubed_sphere", "cubedsphere", 120), ("til10_similar_radius", "similar_radius", 128),
                               ("til11_healpix", "healpix", 64)):
    _whole(f"{_name}_centre", lambda pixels, t=_tiling, n=_nbase: rounded(
        tiles.pixel_centres(pixels(t, n), t, n), "theta_c", "phi_c"))

for _name, _tiling, _nbase, _like in (("cubed_sphere", "cubedsphere", 40, None), ("similar_radius", "similar_radius", 40, None),
                                      ("quad_cube", "quadcube", 40, "cubedsphere"), ("healpix", "healpix", 32, None)):
    _whole(f"til12_{_name}_corners", lambda pixels, t=_tiling, n=_nbase, k=_like: rounded(
        tiles.pixel_corners(pixels(k or t, n), t, n).select("ipix", "n", F.posexplode("corners").alias("corner", "p"))
        .select("ipix", "n", "corner", "p.x", "p.y", "p.z"), "x", "y", "z"))
    _whole(f"agg19_geometry_{_name}", lambda pixels, t=_tiling, n=_nbase, k=_like: _whole_geometry(pixels, t, n, k).withColumns(
        {c: F.round(c, 6) for c in ("area", "ellipticity", "outer", "inner")}))

for _name, _tiling, _nbase in (("til13_cube", "cubedsphere", 40), ("til14_healpix", "healpix", 16)):
    _whole(f"{_name}_neighbours", lambda pixels, t=_tiling, n=_nbase: tiles.explode_neighbours(pixels(t, n), t, n))

_whole("agg20_geometry_summary", lambda pixels: quality.geometry_summary(_whole_geometry(pixels, "similar_radius", 40)).select(
    F.round("min_inner", 6).alias("min_inner"), F.round("max_outer", 6).alias("max_outer")))
_whole("agg20_radius_histogram", lambda pixels: rounded(quality.radius_histogram(
    _whole_geometry(pixels, "cubedsphere", 40).withColumn("outer", F.round("outer", 6)), "outer"), "loc"))


@query
def set1_union_of_counts_all_bins(spark, d):
    s = sky(spark, d)
    a, b = (pairs.pair_counts(s, BINS.slice(*r)) for r in ((0, 9), (10, 19)))
    return _counts(a.unionByName(b))


@query
def agg3_reduced_counts_default_cells_all_bins(spark, d):
    return _counts(reduce.reduced_pair_counts(sky(spark, d), BINS))


# ---- shapes by symmetry: one pixel of each orbit stands for the others ----

def _by_symmetry(spark, d, tiling, nbase, like=None):
    """The shape of every pixel of a tiling with its number of points."""
    count = quality.occupancy(_pixels(spark, d, like or tiling, nbase)).withColumnRenamed("count", "n")
    shapes = symmetry.whole_geometry(spark, tiling, nbase).join(count, "ipix", "left")
    return shapes.withColumns({"n": F.coalesce("n", F.lit(0).cast("long")),
                               **{c: F.round(c, 6) for c in ("area", "ellipticity", "outer", "inner")}})


@query
def agg19_geometry_cubed_sphere_by_symmetry(spark, d):
    return _by_symmetry(spark, d, "cubedsphere", 40)


@query
def agg19_geometry_similar_radius_by_symmetry(spark, d):
    return _by_symmetry(spark, d, "similar_radius", 40)


@query
def agg19_geometry_quad_cube_by_symmetry(spark, d):
    return _by_symmetry(spark, d, "quadcube", 40, "cubedsphere")


@query
def agg19_geometry_healpix_by_symmetry(spark, d):
    return _by_symmetry(spark, d, "healpix", 32)


@query
def agg20_geometry_summary_by_symmetry(spark, d):
    df = symmetry.points_by_orbit(_pixels(spark, d, "similar_radius", 40), "similar_radius", 40)
    return quality.geometry_summary(df).select(F.round("min_inner", 6).alias("min_inner"),
                                               F.round("max_outer", 6).alias("max_outer"))


@query
def agg20_radius_of_points_by_symmetry(spark, d):
    """How many points lie in pixels of which outer radius."""
    df = symmetry.points_by_orbit(_pixels(spark, d, "cubedsphere", 40), "cubedsphere", 40)
    return rounded(quality.radius_histogram(df.withColumn("outer", F.round("outer", 6)), "outer", weight="n"), "loc")
