"""Maps stored along the curve: the same rows from a small part of the bytes."""

import math
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import DISTANCES, POSITIONS
from placemap.functions.curve import BITS, key_ranges, z_key
from placemap.operators import metrics
from placemap.operators.geometry import in_box
from placemap.sources import zoom


def _key(x, y, low, side):
    cx, cy = (min(max(math.floor((v - at) / (side / 2**BITS)), 0), 2**BITS - 1) for v, at in ((x, low[0]), (y, low[1])))
    return sum(((cx >> b & 1) << 2 * b) | ((cy >> b & 1) << 2 * b + 1) for b in range(BITS))


def test_keys_interleave_the_cells(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-50, 150), rng.uniform(-50, 150)) for _ in range(200)] + [(-50.0, -50.0), (150.0, 150.0)]
    got = spark.createDataFrame(points, "x double, y double").select(z_key(F.col("x"), F.col("y"), (-50.0, -50.0), 200.0).alias("k")).collect()
    assert [r.k for r in got] == [_key(x, y, (-50.0, -50.0), 200.0) for x, y in points]
    odd = spark.createDataFrame([(float("nan"), 1.0), (1.0, None)], "x double, y double")
    assert {r[0] for r in odd.select(z_key(F.col("x"), F.col("y"), (0.0, 0.0), 1.0)).collect()} == {None}


def test_ranges_hold_every_point_of_the_box_and_little_else():
    rng = random.Random(2)
    low, side = (-10.0, 5.0), 100.0
    points = [(rng.uniform(-10, 90), rng.uniform(5, 105)) for _ in range(4000)]
    for _ in range(40):
        x, y, w, h = rng.uniform(-30, 90), rng.uniform(-10, 100), rng.choice([0, 3, 30]), rng.choice([0, 3, 30])
        box = (x, y, x + w, y + h)
        ranges = key_ranges(box, low, side)
        assert len(ranges) <= 64 and all(a <= b for a, b in ranges) and all(b + 1 < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
        held = [p for p in points if any(a <= _key(*p, low, side) <= b for a, b in ranges)]
        inside = [p for p in points if box[0] <= p[0] <= box[2] and box[1] <= p[1] <= box[3]]
        assert set(inside) <= set(held) and len(held) <= 1.6 * len(inside) + 40


def _rows_read(table):
    """Rows that the scan of an executed plan gave, after row groups were left out."""
    table.collect()
    plan = table._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value()


def _share_of_bytes(path, ranges):
    """Bytes of the row groups whose keys meet one of the ranges, of all bytes."""
    met = whole = 0
    for file in Path(path).rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        key = meta.schema.to_arrow_schema().get_field_index("z_key")
        for group in map(meta.row_group, range(meta.num_row_groups)):
            stats = group.column(key).statistics
            whole += group.total_byte_size
            met += group.total_byte_size * any(stats.min <= b and a <= stats.max for a, b in ranges)
    return met / whole


def test_a_small_box_reads_a_small_part(spark, tmp_path):
    rng = np.random.default_rng(3)
    n = 400_000
    places = spark.createDataFrame(pd.DataFrame({
        "run_id": rng.integers(0, 2, n), "name": [f"p{i}" for i in range(n)], "x": rng.uniform(0, 1000, n), "y": rng.uniform(0, 1000, n),
    })).repartition(6)
    path = str(tmp_path / "places")
    zoom.write_places(places, path, group_bytes=64 << 10)
    box = (310.0, 420.0, 410.0, 520.0)
    found = zoom.read_places(spark, path, box)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, in_box(places, box).collect()))
    low = spark.read.parquet(f"{path}/extent").first()
    assert _rows_read(zoom.read_places(spark, path, box)) < n / 20
    assert _share_of_bytes(f"{path}/rows", key_ranges(box, (low.x0, low.y0), low.side)) < 0.05
    assert zoom.read_places(spark, path, (5000.0, 0.0, 6000.0, 1.0)).count() == 0


def test_stored_edges_give_the_errors_of_the_box(spark, table, tmp_path):
    rng = np.random.default_rng(5)
    names = [f"p{i}" for i in range(300)]
    positions = table(POSITIONS, [(run, n, float(rng.uniform(0, 100)), float(rng.uniform(0, 100))) for run in (0, 1) for n in names])
    edges = table(DISTANCES, [(int(rng.integers(0, 2)), *map(str, rng.choice([*names, "unknown"], 2)), int(rng.integers(1, 900)), 1) for _ in range(4000)])
    path, box = str(tmp_path / "edges"), (20.0, 10.0, 70.0, 90.0)
    zoom.write_edges(edges, positions, path)
    stored = metrics.edge_error_of_ends(zoom.read_edges(spark, path, box), box)
    joined = metrics.edge_error(edges, positions, box)
    columns = sorted(joined.columns)
    assert sorted(stored.columns) == columns and stored.count() > 300
    a, b = (t.select(*columns).orderBy(*columns).toPandas() for t in (stored, joined))
    pd.testing.assert_frame_equal(a, b, rtol=1e-12)
    assert "Join" not in stored._jdf.queryExecution().executedPlan().toString()


def test_empty_and_single_places(spark, table, tmp_path):
    zoom.write_places(table(POSITIONS, []), str(tmp_path / "none"))
    assert zoom.read_places(spark, str(tmp_path / "none"), (0.0, 0.0, 9.0, 9.0)).count() == 0
    zoom.write_places(table(POSITIONS, [(0, "a", 5.0, 5.0), (0, "b", None, 5.0), (0, "c", float("nan"), 5.0)]), str(tmp_path / "one"))
    assert [r.name for r in zoom.read_places(spark, str(tmp_path / "one"), (5.0, 5.0, 5.0, 5.0)).collect()] == ["a"]
    with pytest.raises(Exception):
        zoom.write_places(table(POSITIONS, []), str(tmp_path / "one"))
