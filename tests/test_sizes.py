"""Plans of joins whose sides both grow with the input."""

import pytest
from pyspark.sql import functions as F

from conftest import DISTANCES, POSITIONS, SMALL
from placemap.operators import metrics
from placemap.operators.joins import beside_runs
from placemap.sources import zoom
from placemap.sources.writers import write_layers
from workload import QUERIES
from workload.file_queries import _layers
from workload.fixtures import Tables


def plan(table) -> str:
    return table._jdf.queryExecution().executedPlan().toString()


EDGES = (
    "edge_error edge_error_report edge_error_topk edge_labels edge_error_layer layers endpoint_join raw_stress kruskal_stress "
    "spring_force direction_force flagged_places"
)


@pytest.mark.parametrize("name", ["endpoint_join_salted", "model_comparison", "stress_history", *EDGES.split()])
def test_places_are_not_broadcast(spark, name):
    """Only rows of runs, or of ranges of them, may be; before, tables of places went through the driver."""
    found = plan(QUERIES[name](spark, SMALL))
    assert "SortMergeJoin" in found
    keys = [line.split("BroadcastHashJoin [")[1].split("]")[0] for line in found.splitlines() if "BroadcastHashJoin [" in line]
    assert not [key for key in keys if "name#" in key or "place_" in key or "_salt" in key or "suppkey" in key or "partkey" in key]


def test_layers_look_the_ends_up_once_and_are_written_compressed(spark, tmp_path):
    """Two joins by an end's name, before four; JSON in gzip."""
    layers = _layers(Tables(spark, SMALL))
    ends = [line for line in plan(layers).splitlines() if "Join [" in line and "place_" in line]
    assert len(ends) == 2
    write_layers(layers.limit(10), str(tmp_path / "layers"))
    assert all(p.suffix == ".gz" for p in (tmp_path / "layers").glob("part-*"))
    assert spark.read.json(str(tmp_path / "layers")).count() == 10


def test_values_of_many_runs_are_not_broadcast(spark):
    """Before, the copies of every run's values were."""
    table = spark.range(100).select((F.col("id") % 20).alias("run_id"), "id")
    values = table.groupBy("run_id").agg(F.max("id").alias("last"))
    many = beside_runs(table, values, limit=3)
    assert "SortMergeJoin" in plan(many) and "Broadcast" not in plan(many)
    assert sorted(map(tuple, many.collect())) == sorted((i % 20, i, 80 + i % 20) for i in range(100))


def test_the_square_of_stored_edges_needs_no_join(spark, table, tmp_path, monkeypatch):
    """Before, the edges were joined with both ends once for the square and once for the rows."""
    positions = table(POSITIONS, [(0, "a", 1.0, 2.0), (0, "b", 5.0, 9.0), (0, "c", float("inf"), 0.0)])
    edges = table(DISTANCES, [(0, "a", "b", 3, 3), (0, "b", "a", 4, 4), (0, "a", "unknown", 5, 5)])
    plans, first = [], type(positions).first
    monkeypatch.setattr(type(positions), "first", lambda rows: plans.append(plan(rows)) or first(rows))
    zoom.write_edges(edges, positions, str(tmp_path / "edges"))
    assert plans and not any("Join" in p for p in plans)
    found = zoom.read_edges(spark, str(tmp_path / "edges"), (0.0, 0.0, 9.0, 9.0))
    assert sorted((r.place_a, r.place_b, r.x1, r.y2) for r in found.collect()) == [("a", "b", 1.0, 9.0), ("b", "a", 5.0, 2.0)]


@pytest.mark.parametrize("name, module, step", [("edge_error_topk_large", metrics, "stored"), ("edge_error_zoom_stored", zoom, "_write")])
def test_places_are_not_broadcast_into_written_steps(spark, monkeypatch, name, module, step):
    """Before, tables of places went through the driver into what is written on the way."""
    plans, write = [], getattr(module, step)
    monkeypatch.setattr(module, step, lambda rows, *rest: plans.append(plan(rows)) or write(rows, *rest))
    QUERIES[name](spark, SMALL).collect()
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
