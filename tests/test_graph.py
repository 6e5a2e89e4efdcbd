from pyspark.sql import functions as F

from conftest import DISTANCES, POSITIONS
from placemap.operators import graph
from placemap.operators.joins import beside_runs, one_run, salted_join, with_endpoints

ROWS = [(0, "a", "b", 10, 10), (0, "a", "c", 20, 20), (0, "a", "b", 10, 10), (1, "x", "y", 5, 5)]


def test_vertices_and_degrees(table):
    distances = table(DISTANCES, ROWS)
    assert sorted(tuple(r) for r in graph.vertices(distances).collect()) == [
        (0, "a"), (0, "b"), (0, "c"), (1, "x"), (1, "y"),
    ]
    degree = {r.name: r.degree for r in graph.degrees(distances).collect()}
    assert degree == {"a": 3, "b": 2, "c": 1, "x": 1, "y": 1}


def test_adjacency_counts_copies(table):
    lists = {r.name: r for r in graph.adjacency(table(DISTANCES, ROWS)).collect()}
    assert [tuple(n) for n in lists["a"].neighbors] == [("b", 10, 10, 2), ("c", 20, 20, 1)]
    assert lists["a"].entries == 3 and lists["a"].pages == 1


def test_adjacency_pages_hold_a_hub_whole(spark):
    hub = spark.range(5000).select(
        F.lit(0).cast("long").alias("run_id"), F.lit("hub").alias("place_a"),
        F.concat(F.lit("p"), "id").alias("place_b"), F.col("id").alias("li_eval"), F.col("id").alias("li_spring"),
    )
    pages = graph.adjacency(hub, page_rows=500).filter("name = 'hub'").collect()
    assert {p.pages for p in pages} == {10} and sum(p.entries for p in pages) == 5000
    assert max(len(p.neighbors) for p in pages) < 700
    assert len({n.neighbor for p in pages for n in p.neighbors}) == 5000


def test_run_values_by_broadcast_and_by_salted_join(table):
    rows = table("run_id long, v long", [(i % 7, i) for i in range(200)])
    values = table("run_id long, w long", [(i, 10 * i) for i in range(5)])
    for how in ("left", "inner"):
        few, many = (sorted(map(str, beside_runs(rows, values, how, limit=n).select("run_id", "v", "w").collect())) for n in (100, 2))
        assert few == many
    assert "Broadcast" in beside_runs(rows, values)._jdf.queryExecution().executedPlan().toString()


def test_dense_ids_follow_name_order_for_any_number_of_ranges(spark):
    places = spark.range(3000).select(
        F.when(F.col("id") < 2900, 0).otherwise(1).cast("long").alias("run_id"),
        F.md5(F.col("id").cast("string")).alias("name"),
    )
    for partitions in (None, 1, 20):
        rows = graph.dense_ids(places, partitions).collect()
        for run in (0, 1):
            mine = sorted((r.name, r.id) for r in rows if r.run_id == run)
            assert [i for _, i in mine] == list(range(len(mine)))


def test_missing_names(table):
    places = table("run_id long, name string", [(0, "a"), (0, "b"), (1, "x"), (1, "y")])
    assert [tuple(r) for r in graph.missing_names(table(DISTANCES, ROWS), places).collect()] == [(0, "c")]


def test_unknown_places_and_shared_edges(table):
    positions = table(POSITIONS, [(0, "a", 0.0, 0.0), (0, "b", 3.0, 4.0), (1, "a", 1.0, 1.0), (1, "b", 2.0, 2.0)])
    keyed = with_endpoints(table(DISTANCES, ROWS), positions)
    assert keyed.count() == 2
    shared = table(DISTANCES, ROWS[:1]).drop("run_id")
    assert {(r.run_id, r.x2) for r in with_endpoints(shared, positions).collect()} == {(0, 3.0), (1, 2.0)}


def test_salted_join_gives_the_same_rows(spark):
    left = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    right = spark.range(2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain = sorted(tuple(r) for r in salted_join(left, right, ["k"]).collect())
    for how in ("inner", "left"):
        salted = salted_join(left, right, ["k"], salts=7, how=how).select("k", "id", "v").collect()
        wanted = plain if how == "inner" else sorted(tuple(r) for r in left.join(right, "k", "left").collect())
        assert sorted(map(str, (tuple(r) for r in salted))) == sorted(map(str, wanted))


def test_index_of_one_run_needs_no_nested_loop(spark, tmp_path):
    spark.range(100).selectExpr("concat('p', id) AS name").write.parquet(str(tmp_path / "places"))
    ids = graph.dense_ids(one_run(spark.read.parquet(str(tmp_path / "places"))))
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "SinglePartition" not in plan
    assert sorted(r.id for r in ids.collect()) == list(range(100))


def test_places_of_crowded_groups_give_the_same_lists(table):
    """Whether a place's entries are put together in one task or page by page."""
    rows = [(r, "hub", f"p{i % 40}", i % 3, 1) for r in (0, 1) for i in range(200)] + [(0, "p1", "p2", 7, 7)]
    distances = table(DISTANCES, rows)
    plain = sorted(map(str, graph.adjacency(distances, page_rows=9).collect()))
    assert plain == sorted(map(str, graph.adjacency(distances, page_rows=9, hub_rows=50).collect()))
    assert plain == sorted(map(str, graph.adjacency(distances, page_rows=9, hub_rows=0).collect()))


def test_entries_are_exchanged_once(table):
    """Before, by entry (twice), by place for the sizes, by place for the join."""
    plan = graph.adjacency(table(DISTANCES, ROWS), page_rows=1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
