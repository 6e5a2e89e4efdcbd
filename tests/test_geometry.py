import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import POSITIONS
from placemap.functions.display import error_colour, error_label, palette
from placemap.functions.projection import CONE, lcc_lonlat, lcc_xy
from placemap.operators import geometry as geo


def test_cone_constants_and_check_points(spark):
    assert CONE.n == pytest.approx(0.6525767244663818, abs=1e-12)
    assert CONE.rho0 == pytest.approx(7802591.046333162, abs=1e-6)
    points = spark.createDataFrame([(89.840644, 40.527633), (75.0, 39.0)], "lon double, lat double")
    x, y = lcc_xy(F.col("lon"), F.col("lat"))
    got = points.select(x.alias("x"), y.alias("y")).collect()
    assert got[0].x == pytest.approx(578500.9293, abs=1e-3) and got[0].y == pytest.approx(400089.8127, abs=1e-3)
    assert got[1].x == pytest.approx(-690425.2653, abs=1e-3) and got[1].y == pytest.approx(239656.3935, abs=1e-3)


def test_projection_round_trip(spark):
    points = spark.range(2000).select((73 + F.col("id") / 100).alias("lon"), (37 + F.col("id") / 285).alias("lat"))
    x, y = lcc_xy(F.col("lon"), F.col("lat"))
    lon, lat = lcc_lonlat(F.col("x"), F.col("y"))
    back = points.select("*", x.alias("x"), y.alias("y")).select(
        F.max(F.abs(lon - F.col("lon"))).alias("dlon"), F.max(F.abs(lat - F.col("lat"))).alias("dlat")
    ).first()
    assert back.dlon < 1e-9 and back.dlat < 1e-9


def test_forward_puts_the_anchor_at_the_origin_and_keeps_nulls(table):
    points = table("run_id long, name string, lon double, lat double", [
        (0, "a", 89.84, 40.53), (0, "b", None, None), (0, "north", 89.84, 41.53),
    ])
    rows = {r.name: r for r in geo.lcc_forward(points, "a").collect()}
    assert (rows["a"].x_km, rows["a"].y_km) == (0.0, 0.0)
    assert rows["b"].x_km is None
    assert -112 < rows["north"].y_km < -109  # north is up, so y is negative


def test_shift_moves_the_mean(table):
    moved = geo.shift(table(POSITIONS, [(0, "a", 0.0, 0.0), (0, "b", 10.0, 4.0), (1, "c", 5.0, 5.0)]))
    at = {r.name: (r.x, r.y) for r in moved.collect()}
    assert at == {"a": (597.5, 374.0), "b": (602.5, 376.0), "c": (600.0, 375.0)}


def test_anchors_replace_and_refuse_nulls(table):
    positions = table(POSITIONS, [(0, "a", 1.0, 1.0), (0, "b", 2.0, 2.0), (1, "a", 3.0, 3.0)])
    fixed = geo.apply_anchors(positions, table("name string, x double, y double", [("a", 9.0, 8.0)])).collect()
    assert sorted((r.run_id, r.name, r.x) for r in fixed) == [(0, "a", 9.0), (0, "b", 2.0), (1, "a", 9.0)]
    with pytest.raises(PySparkException):
        geo.apply_anchors(positions, table("name string, x double, y double", [("a", None, None)])).collect()


def test_align_rotate_keeps_distances(table):
    positions = table(POSITIONS, [(0, "p", 10.0, 20.0), (0, "q", 13.0, 24.0), (0, "r", 0.0, 0.0)])
    at = {r.name: (r.x_km, r.y_km) for r in geo.align_rotate(positions, "p", "q", 0.0).collect()}
    assert at["p"] == pytest.approx((0, 0)) and at["q"] == pytest.approx((5 * 4.15, 0))
    assert math.dist(at["p"], at["r"]) == pytest.approx(math.dist((10, 20), (0, 0)) * 4.15)
    assert math.dist(at["q"], at["r"]) == pytest.approx(math.dist((13, 24), (0, 0)) * 4.15)


def test_geodesic_offset_directions(table):
    points = table("run_id long, name string, x_km double, y_km double", [
        (0, "stay", 0.0, 0.0), (0, "along", 100.0, 0.0), (0, "across", 0.0, 100.0),
    ])
    math_rows = {r.name: r for r in geo.geodesic_offset(points).collect()}
    assert (math_rows["stay"].lon, math_rows["stay"].lat) == pytest.approx((89.840644, 40.527633))
    # atan2(y, x) = 0 is an azimuth of 0: north
    assert math_rows["along"].lon == pytest.approx(89.840644) and math_rows["along"].lat > 41.4
    compass = {r.name: r for r in geo.geodesic_offset(points, bearing="azimuth").collect()}
    assert compass["along"].lon > 91 and compass["across"].lat < 39.7
    # one degree of meridian at this latitude is about 111.05 km
    assert (math_rows["along"].lat - 40.527633) * 111.05 == pytest.approx(100, abs=0.05)


def test_box_zoom_flip_and_canvas(table):
    positions = table(POSITIONS, [(0, "in", 500.0, 400.0), (0, "out", 499.9, 350.0)])
    inside = geo.in_box(positions, geo_box := (500, 325, 800, 400))
    assert [r.name for r in inside.collect()] == ["in"]
    at = geo.zoom(inside, geo_box).first()
    factor = math.sqrt(1200 * 750 / (300 * 75))
    assert (at.x, at.y) == pytest.approx((-150 * factor + 600, 37.5 * factor + 375))
    assert geo.in_box(positions, (0, 0, 1, 1)).count() == 0
    assert [r.y for r in geo.flip_y(inside).collect()] == [350.0]
    points = table("x_km double, y_km double", [(-2.0, 2.0)])
    drawn = geo.to_canvas(points, scale=0.7, offset=(0.0, 0.0)).first()
    assert (drawn.px, drawn.py) == (-1, 1)


def test_random_positions_ignore_partitioning(spark):
    places = spark.range(500).select(F.lit(0).cast("long").alias("run_id"), F.col("id").cast("string").alias("name"))
    one = {r.name: (r.x, r.y) for r in geo.random_positions(places.coalesce(1), 5).collect()}
    many = {r.name: (r.x, r.y) for r in geo.random_positions(places.repartition(7), 5).collect()}
    assert one == many
    assert all(120 <= x < 1080 and 75 <= y < 675 for x, y in one.values())
    assert 560 < sum(x for x, _ in one.values()) / 500 < 640
    other = {r.name: (r.x, r.y) for r in geo.random_positions(places, 6).collect()}
    assert other != one


def test_display_texts(spark):
    rows = spark.createDataFrame([(0.0,), (0.015,), (0.03,), (1.0,), (None,)], "e double").select(
        error_colour(F.col("e")).alias("c"), error_label(F.col("e"), F.lit(200.0)).alias("l"),
        error_label(F.col("e"), digits=1).alias("s"),
    ).collect()
    assert [r.c for r in rows] == ["#ffffff", "#ff7f7f", "#ff0000", "#ff0000", None]
    assert rows[1].l == "1.50% (+3.00km)" and rows[1].s == "1.5%" and rows[4].l is None
    # exact ties follow the binary value
    tie = spark.createDataFrame([(0.00125,), (0.01625,)], "e double").select(error_label(F.col("e")).alias("l"))
    assert [r.l for r in tie.collect()] == [f"{e * 100:.2f}%" for e in (0.00125, 0.01625)]
    names = spark.range(-1, 8).select(palette(F.col("id")).alias("p")).collect()
    assert [n.p for n in names[:3]] == ["brown", "red", "green"] and names[-1].p == "green"


def test_missing_anchors_stop_the_job(spark, table):
    positions = table(POSITIONS, [(0, "a", 1.0, 2.0), (0, "b", 3.0, 4.0), (1, "b", 5.0, 6.0)])
    anchors = table("name string, x double, y double", [("a", 0.0, 0.0), ("nowhere", 1.0, 1.0)])
    with pytest.raises(ValueError, match="anchor is no place: nowhere"):
        geo.apply_anchors(positions, anchors)
    moved = {(r.run_id, r.name): (r.x, r.y) for r in geo.apply_anchors(positions, anchors.filter("name = 'a'")).collect()}
    assert moved == {(0, "a"): (0.0, 0.0), (0, "b"): (3.0, 4.0), (1, "b"): (5.0, 6.0)}
    with pytest.raises(PySparkException, match="no anchor a in run 1"):
        geo.rescale_about(positions, "a").collect()
    points = table("run_id long, name string, lon double, lat double", [(0, "a", None, None), (0, "b", 80.0, 40.0)])
    with pytest.raises(PySparkException, match="no anchor a in run 0"):
        geo.lcc_forward(points, "a").collect()
