"""Shape of the plans: no single-partition exchange, no row-wise Python, pruning down to the scan."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from conftest import SMALL
from placemap.operators import metrics
from placemap.operators.geometry import in_box
from placemap.operators.joins import with_endpoints
from placemap.plans.jobs import ensemble_statistics, evaluate
from placemap.sources.storage import shared_folder, stored
from workload import QUERIES
from workload.fixtures import ALIGN, Tables
from workload.map_queries import _truth


def _plan(table):
    out = io.StringIO()
    with redirect_stdout(out):
        table.explain("formatted")
    return out.getvalue()


PLAIN = [n for n in QUERIES if "roundtrip" not in n]
# These end in one global row or name the whole table's extent in a scalar subquery.
ONE_ROW = {"density_range", "repulsion", "net_force"}


@pytest.mark.parametrize("name", PLAIN)
def test_no_single_partition_and_no_cross_join(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(entry_point.queries()[name](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    if name not in ONE_ROW:
        assert "SinglePartition" not in plan
    # nothing is exchanged on the run alone to be joined
    for join in re.split(r"\n\n\(\d+\) ", plan):
        if re.match(r"(SortMergeJoin|ShuffledHashJoin)", join):
            assert not re.search(r"Left keys \[1\]: \[run_id#\d+L?\]", join), join
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_scan_reads_only_the_needed_columns(spark):
    tables = Tables(spark, SMALL)
    plan = _plan(metrics.raw_stress(tables.distances(), tables.positions()))
    columns = {c for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for c in re.findall(r"(\w+):", schema)}
    assert columns <= {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "s_suppkey", "p_partkey"}


def test_top_errors_are_limited_before_the_shuffle(spark):
    tables = Tables(spark, SMALL)
    plan = _plan(metrics.top_errors(metrics.edge_error(tables.distances(), tables.positions()), 5))
    assert "WindowGroupLimit" in plan


def test_box_reaches_the_scan(spark):
    tables = Tables(spark, SMALL)
    saved = stored(tables.positions(), "box")
    assert "PushedFilters: [IsNotNull(x)" in _plan(in_box(saved, (500, 325, 800, 400)))


def test_stored_tables_go_to_the_named_folder(spark):
    folder = shared_folder(spark)
    assert spark.range(3).transform(stored).count() == 3
    assert folder == shared_folder(spark)


def test_metrics_do_not_depend_on_partitioning(spark):
    tables = Tables(spark, SMALL)
    one = metrics.raw_stress(tables.distances().coalesce(1), tables.positions()).collect()
    many = metrics.raw_stress(tables.distances().repartition(13), tables.positions().repartition(5)).collect()
    assert {r.run_id: pytest.approx(r.raw_stress, rel=1e-12) for r in one} == {r.run_id: r.raw_stress for r in many}


def test_hub_with_a_third_of_all_edges(spark):
    """One place holds a third of the edges; salted and plain lookups agree."""
    tables = Tables(spark, SMALL)
    distances = tables.distances()
    hub = distances.withColumn("place_a", F.lit("S1"))
    skewed = distances.unionByName(distances).unionByName(hub)
    plain = {r.run_id: r.raw_stress for r in metrics.raw_stress(skewed, tables.positions()).collect()}
    salted = {r.run_id: r.raw_stress for r in metrics.raw_stress(skewed, tables.positions(), salts=16).collect()}
    assert plain == {k: pytest.approx(v, rel=1e-12) for k, v in salted.items()}


def test_evaluation_job(spark):
    tables = Tables(spark, SMALL)
    tables_out = evaluate(tables.distances(), tables.directions(), tables.positions(), _truth(tables), anchor=ALIGN)
    scores = tables_out["scores"].collect()
    assert len(scores) == 2 and all(s.rmse_km > 0 and 0 < s.kruskal_stress < 1 for s in scores)
    assert tables_out["places"].count() == tables.positions().count()
    assert tables_out["detail_errors"].count() <= tables_out["edge_errors"].count()


def test_metrics_of_stored_ends_exchange_no_edges(spark):
    """A second metric of a layout costs a scan: what is exchanged are sums per run."""
    tables = Tables(spark, SMALL)
    distances, positions = tables.distances(), tables.positions()
    ended = stored(with_endpoints(distances, positions), "ends")
    box = (500.0, 325.0, 800.0, 400.0)
    for found, joined in (
        (metrics.raw_stress_of_ends(ended), metrics.raw_stress(distances, positions)),
        (metrics.kruskal_stress_of_ends(ended), metrics.kruskal_stress(distances, positions)),
        (metrics.layout_scores_of_ends(ended), metrics.layout_scores(distances, positions)),
    ):
        plan = _plan(found)
        assert "Join" not in plan and len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) == 1 and "partial_" in plan
        columns = sorted(found.columns)
        for a, b in zip(*[t.select(*columns).orderBy("run_id").collect() for t in (found, joined)]):
            assert tuple(a) == pytest.approx(tuple(b), rel=1e-12)
    assert "Exchange" not in _plan(metrics.edge_error_of_ends(ended)) and "Exchange" not in _plan(metrics.edge_error_of_ends(ended, box))
    assert metrics.edge_error_of_ends(ended, box).count() == metrics.edge_error(distances, positions, box).count()


def test_ensemble_job(spark):
    done = ensemble_statistics(Tables(spark, SMALL).samples())
    low, high = done["density_range"].first()
    assert 0 < low < high
    assert done["ellipses"].count() == 3 * done["moments"].count()
