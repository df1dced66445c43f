"""Tiling invariants: numbering, round trips, known directions, shapes and neighbours."""

import math

import pytest
from pyspark.sql import functions as F

from skypairs.functions import cube_faces, similar_radius
from skypairs.functions.geometry import chord
from skypairs.operators import symmetry, tiles
from skypairs.operators.quality import random_sky, tile_geometry

RESOLUTION = {"cubedsphere": 10, "similar_radius": 10, "healpix": 8}


@pytest.mark.parametrize("tiling", tiles.TILINGS)
def test_pixel_table_is_complete_and_valid(spark, tiling):
    n = RESOLUTION[tiling]
    pix = tiles.pixel_table(spark, tiling, n)
    assert pix.distinct().count() == tiles.n_pixels(tiling, n)
    if tiling != "healpix":
        assert pix.where(~cube_faces.is_valid(F.col("ipix"), n)).count() == 0
        back = tiles.with_decoded(pix, n)
        assert back.where(cube_faces.encode(F.col("face"), F.col("i"), F.col("j"), n)
                          != F.col("ipix")).count() == 0


@pytest.mark.parametrize("tiling", tiles.TILINGS)
def test_centre_falls_into_its_pixel(spark, tiling):
    for n in (RESOLUTION[tiling], 2, 16):
        c = tiles.pixel_centres(tiles.pixel_table(spark, tiling, n), tiling, n)
        assert c.where(~F.col("theta_c").between(0, math.pi)
                       | ~F.col("phi_c").between(0, 2 * math.pi)).count() == 0
        back = tiles.assign_pixel(c, tiling, n, "theta_c", "phi_c", "again")
        assert back.where("again is null or again <> ipix").count() == 0


def test_axis_points_and_faces(spark):
    half = math.pi / 2
    rows = [(half, 0.0, 0), (half, half, 1), (half, math.pi, 2), (half, 3 * half, 3), (0.0, 0.0, 4),
            (math.pi, 0.0, 5)]
    df = tiles.with_face(spark.createDataFrame(rows, "theta double, phi double, expected int"))
    assert df.where("face <> expected").count() == 0


@pytest.mark.parametrize("tiling", ("cubedsphere", "similar_radius"))
def test_point_on_a_cube_edge(spark, tiling):
    df = spark.createDataFrame([(2.0260583888217623, 2.356194490192345)], "theta double, phi double")
    row = tiles.assign_pixel(df, tiling, 10)
    assert row.where(cube_faces.is_valid(F.col("ipix"), 10)).count() == 1


@pytest.mark.parametrize("tiling,limit", [("cubedsphere", 1.25), ("similar_radius", 1.1), ("healpix", 1.5)])
def test_points_are_near_their_centre(spark, tiling, limit):
    n = RESOLUTION[tiling]
    df = tiles.pixel_centres(tiles.assign_pixel(random_sky(spark, 200_000, seed=3), tiling, n), tiling, n)
    from skypairs.functions.geometry import unit_vector
    d = chord(unit_vector(F.col("theta"), F.col("phi")), unit_vector(F.col("theta_c"), F.col("phi_c")))
    far = df.agg(F.max(d)).first()[0]
    assert far < limit * tiles.ideal_radius(tiling, n)


@pytest.mark.parametrize("tiling", tiles.TILINGS)
def test_neighbours_are_symmetric_and_near(spark, tiling):
    for n in ((4, 10) if tiling != "healpix" else (2, 8)):
        pix = tiles.pixel_table(spark, tiling, n)
        pairs = tiles.explode_neighbours(pix, tiling, n).persist()
        assert pairs.where("ipix = neighbour").count() == 0
        swapped = pairs.select(F.col("neighbour").alias("ipix"), F.col("ipix").alias("neighbour"))
        assert pairs.exceptAll(swapped).count() == 0
        sizes = {r["count"]: r["n"] for r in pairs.groupBy("ipix").count().groupBy("count")
                 .agg(F.count("*").alias("n")).collect()}
        if tiling != "healpix":
            assert sizes == {7: 24, 8: 6 * n * n - 24}
        else:
            assert sizes[7] == 24 and set(sizes) <= {6, 7, 8}
        a = tiles.pixel_centre_vectors(pairs, tiling, n, "ipix", ("x", "y", "z"))
        b = tiles.pixel_centre_vectors(a, tiling, n, "neighbour", ("x2", "y2", "z2"))
        d = chord(tuple(map(F.col, ("x", "y", "z"))), tuple(map(F.col, ("x2", "y2", "z2"))))
        far = b.agg(F.max(d)).first()[0]
        assert far < 2 * 1.5 * tiles.ideal_radius(tiling, n)
        padded = tiles.neighbours(pix, tiling, n, pad=True)
        assert padded.where(F.size("neighbours") != 8).count() == 0
        pairs.unpersist()


def test_smallest_cube_has_only_corner_pixels(spark):
    around = tiles.neighbours(tiles.pixel_table(spark, "cubedsphere", 2), "cubedsphere", 2)
    assert around.where(F.size("neighbours") == 7).count() == 24


def test_quadrant_indices_round_trip(spark):
    n = 10
    bins = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))
    q, a, b = similar_radius.face_to_quadrant_bins(F.col("i"), F.col("j"), n)
    back = similar_radius.quadrant_to_face_bins(q, a, b, n)
    assert bins.where((back[0] != F.col("i")) | (back[1] != F.col("j"))).count() == 0
    m = n + 1
    nodes = spark.range(m * m).select(F.floor(F.col("id") / m).alias("i"), (F.col("id") % m).alias("j"))
    q, a, b = similar_radius.face_to_quadrant_nodes(F.col("i"), F.col("j"), n)
    back = similar_radius.quadrant_to_face_nodes(q, a, b, n)
    assert nodes.where((back[0] != F.col("i")) | (back[1] != F.col("j"))).count() == 0


@pytest.mark.parametrize("tiling", tiles.TILINGS)
def test_column_form_equals_table_form(spark, tiling):
    n = RESOLUTION[tiling]
    df = random_sky(spark, 2000, seed=5)
    both = tiles.assign_pixel(df, tiling, n).withColumn(
        "same", tiles.pixel_of(tiling, n, F.col("theta"), F.col("phi")))
    assert both.where("same <> ipix").count() == 0
    around = tiles.neighbours(both, tiling, n).where(
        F.col("neighbours") != tiles.neighbours_of(tiling, n, F.col("ipix")))
    assert around.count() == 0


@pytest.mark.parametrize(("tiling", "n"), [("cubedsphere", 1), ("cubedsphere", 6), ("cubedsphere", 7), ("similar_radius", 8),
                                           ("quadcube", 5), ("quadcube", 6), ("healpix", 1), ("healpix", 2), ("healpix", 8)])
def test_orbits_cover_each_pixel_once_with_its_own_shape(spark, tiling, n):
    orbits = symmetry.orbits(spark, tiling, n)
    size = orbits.agg(F.count("*").alias("n"), F.sum("size").alias("all")).first()
    assert (size["n"], size["all"]) == (symmetry.n_orbits(tiling, n), tiles.n_pixels(tiling, n))
    images = symmetry.images(orbits, tiling, n)
    assert images.select("image").distinct().count() == images.count() == tiles.n_pixels(tiling, n)
    stands, odd = symmetry.representative(tiling, n, F.col("image"))
    middle = tiles.with_decoded(images, n, "image", "healpix" if tiling == "healpix" else "cubedsphere")
    # in a middle line of a face a mirroring may or may not be counted
    plain = (F.col("i") * 2 != n - 1) & (F.col("j") * 2 != n - 1)
    assert middle.where((stands != F.col("ipix")) | (plain & (odd != F.col("mirrored")))).count() == 0
    one_by_one = tile_geometry(tiles.pixel_table(spark, tiling, n), tiling, n).toDF("ipix", "a", "e", "o", "i")
    both = symmetry.whole_geometry(spark, tiling, n).join(one_by_one, "ipix")
    off = sum((F.abs(F.col(p) - F.col(q)) for p, q in (("area", "a"), ("ellipticity", "e"), ("outer", "o"), ("inner", "i"))), F.lit(0.0))
    assert both.count() == tiles.n_pixels(tiling, n)
    assert both.where(~(off < 1e-6)).count() == 0


def test_whole_shapes_need_no_exchange(spark):
    plan = symmetry.whole_geometry(spark, "similar_radius", 64)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
