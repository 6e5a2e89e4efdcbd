import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import DIRECTIONS, DISTANCES, POSITIONS
from placemap.operators import directions as compass
from placemap.operators import metrics, series
from placemap.operators import truth as known

SQUARE = [(0, "a", 0.0, 0.0), (0, "b", 30.0, 40.0), (0, "c", 0.0, 0.0)]


def test_stress_of_exact_layout_is_zero(table):
    positions = table(POSITIONS, SQUARE)
    scores = metrics.layout_scores(table(DISTANCES, [(0, "a", "b", 500, 1)]), positions).first()
    assert scores.raw_stress == pytest.approx(0, abs=1e-9) and scores.kruskal_stress == pytest.approx(0, abs=1e-9)
    assert (scores.n_edges, scores.n_bad_edges) == (1, 0)


def test_stress_by_hand(table):
    distances = table(DISTANCES, [(0, "a", "b", 400, 1), (0, "b", "a", 600, 1)])
    scores = metrics.layout_scores(distances, table(POSITIONS, SQUARE)).first()
    assert scores.raw_stress == pytest.approx(2 * 41.5**2)
    assert scores.kruskal_stress == pytest.approx(math.sqrt(2 * 41.5**2 / (2 * 207.5**2)))
    assert scores.n_bad_edges == 2


def test_an_edge_on_the_threshold_counts_as_in_the_report(table):
    """3 % as pixels give it, a little more as kilometres did."""
    positions = table(POSITIONS, [(0, "a", 0.0, 0.0), (0, "b", 12.36, 0.0)])
    distances = table(DISTANCES, [(0, "a", "b", 120, 1)])
    assert metrics.error_report(metrics.edge_error(distances, positions)).count() == 0
    assert metrics.layout_scores(distances, positions).first().n_bad_edges == 0


def test_coinciding_ends_give_no_kruskal(table):
    assert metrics.kruskal_stress(table(DISTANCES, [(0, "a", "c", 5, 1)]), table(POSITIONS, SQUARE)).first()[1] is None


def test_edge_error_threshold_sign_and_zero_li(table):
    distances = table(DISTANCES, [
        (0, "a", "b", 500, 1), (0, "b", "a", 400, 1), (0, "a", "b", 1000, 1), (0, "b", "c", 0, 1),
    ])
    errors = metrics.edge_error(distances, table(POSITIONS, SQUARE))
    rows = {r.li_eval: r for r in errors.collect()}
    assert rows[500].error == 0 and rows[400].error == pytest.approx(0.25) and rows[0].error is None
    assert rows[400].delta_km == pytest.approx(41.5) and rows[1000].delta_km == pytest.approx(-207.5)
    assert [r.li_eval for r in metrics.error_report(errors).collect()] == [1000, 400]
    assert [r.li_eval for r in metrics.error_report(errors, threshold=0.5).collect()] == []


def test_exact_threshold_is_excluded(spark):
    errors = spark.createDataFrame([(0.03,), (math.nextafter(0.03, 1),)], "error double")
    assert metrics.above_threshold(errors).count() == 1


def test_zoomed_error_equals_plain_error(table):
    positions = table(POSITIONS, [(0, "a", 510.0, 330.0), (0, "b", 540.0, 370.0), (0, "c", 0.0, 0.0)])
    distances = table(DISTANCES, [(0, "a", "b", 450, 1), (0, "a", "c", 450, 1)])
    zoomed = metrics.edge_error(distances, positions, (500, 325, 800, 400)).collect()
    assert [r.place_b for r in zoomed] == ["b"]
    assert zoomed[0].error == pytest.approx(5 / 45) and zoomed[0].delta_km == pytest.approx(5 * 4.15)
    assert metrics.edge_error(distances, positions, (1, 1, 2, 2)).count() == 0


def test_top_errors_in_slices_equal_plain_ranking(spark):
    errors = spark.range(5000).selectExpr(
        "id % 2 AS run_id", "concat('a', id) AS place_a", "'b' AS place_b", "id AS li_eval", "id AS li_spring",
        "(id * 7919 % 5003) / 5003D AS error",
    )
    small = {(r.run_id, r.rank, r.place_a) for r in metrics.top_errors(errors, 900).collect()}
    large = {(r.run_id, r.rank, r.place_a) for r in metrics.top_errors(errors, 1000).collect() if r.rank <= 900}
    assert small == large and len(small) == 1800


def test_alias_precedence(table):
    truth = table("row_no long, aliases array<string>, lon double, lat double", [
        (0, ["?", "a", "b"], 80.0, 40.0),   # first known alias is a, not b
        (1, ["c"], 81.0, 40.0),
        (2, ["", None, "c"], 82.0, 41.0),   # the later row for c wins
        (3, ["d"], 0.0, 0.0),               # (0, 0) means unknown
        (4, ["nowhere"], 85.0, 41.0),
    ])
    places = table("run_id long, name string", [(0, n) for n in "abcd"])
    rows = {r.name: (r.lon, r.lat) for r in known.resolve_aliases(truth, places).collect()}
    assert rows == {"a": (80.0, 40.0), "b": (None, None), "c": (82.0, 41.0), "d": (None, None)}


def test_rmse_and_error_scale(table):
    errors = table("run_id long, name string, error_km double", [(0, "a", 3.0), (0, "b", 4.0), (1, "a", 0.0)])
    rows = {r.run_id: r.rmse_km for r in known.rmse(errors).collect()}
    assert rows == {0: pytest.approx(math.sqrt(12.5)), 1: 0.0}
    assert {r.run_id: r.rmse_km for r in known.rmse(errors, exclude=("a",)).collect()} == {0: 4.0}
    shares = {(r.run_id, r.name): (r.share, r.colour) for r in known.error_scale(errors).collect()}
    assert shares[(0, "b")] == (1.0, "#ff0000") and shares[(0, "a")] == (0.75, "#bf003f")
    assert shares[(1, "a")] == (None, None)


def test_direction_limits(table):
    positions = table(POSITIONS, [
        (0, "o", 0.0, 0.0), (0, "e", 5.0, 0.0), (0, "n", 0.0, -5.0), (0, "w", -5.0, 0.0), (0, "ne", 5.0, -5.0),
        (0, "same", 0.0, 0.0),
    ])
    rows = [
        ("o", "e", "東"), ("o", "e", "E"),
        ("o", "n", "東"),      # exactly 90 degrees off: allowed
        ("o", "w", "東"),      # 180 degrees off
        ("o", "ne", "東北"), ("o", "e", "東南"),
        ("o", "w", "NE"),      # 135 degrees off
        ("o", "same", "東"),   # no direction at all: allowed
        ("o", "e", "up"),      # unknown token
    ]
    constraints = table(DIRECTIONS, [(0, *r) for r in rows])
    broken = compass.direction_violations(constraints, positions).collect()
    found = {(r.place_b, r.direction) for r in broken}
    assert {("w", "東"), ("w", "NE")} <= found <= {("w", "東"), ("w", "NE"), ("e", "東南")}
    count = compass.violation_count(constraints, positions).first()
    assert count.n_checked == 8 and count.n_violations == len(found)
    assert [r.direction for r in compass.unknown_directions(constraints).collect()] == ["up"]
    flags = {r.name: r.violating for r in compass.flag_violating(positions, compass.direction_violations(constraints, positions)).collect()}
    assert flags["o"] and flags["w"] and not flags["n"]


def test_series(table):
    history = table("run_id long, iteration int, stress double", [(0, i, 10.0 ** (6 - i)) for i in range(1, 12)] + [(1, 1, 5.0)])
    summary = {r.run_id: r for r in series.history_summary(history).collect()}
    assert summary[0].last_stress == pytest.approx(1e-5) and summary[0].max_stress == 1e5 and summary[1].n_steps == 1
    shares = {(r.run_id, r.iteration): r for r in series.normalise(history).collect()}
    assert shares[(0, 1)].stress_share == 1 and shares[(0, 11)].stress_share == 0 and shares[(0, 6)].step_share == 0.5
    assert shares[(1, 1)].step_share is None
    marks = sorted((r.tick, r.step) for r in series.ticks(history).collect() if r.run_id == 0)
    assert marks == [(j, j * 2) for j in range(6)]


def test_top_errors_of_a_large_k_need_no_window_over_a_run(spark):
    """Ties, nulls, runs larger and smaller than k; the same rows as one sort of everything."""
    rng = np.random.default_rng(11)
    n = 60_000
    rows = pd.DataFrame({
        "run_id": rng.choice([0, 0, 0, 0, 1], n), "place_a": [f"a{i % 700}" for i in range(n)], "place_b": [f"b{i}" for i in range(n)],
        "li_eval": rng.integers(1, 9, n), "li_spring": 1, "error": np.round(rng.exponential(0.05, n), 4),
    })
    rows.loc[rows.index[:50], "run_id"] = 2
    rows.loc[rows.index[10:30], "error"] = None
    frame = spark.createDataFrame(rows, "run_id long, place_a string, place_b string, li_eval long, li_spring long, error double")
    frame = frame.withColumn("error", F.when(~F.isnan("error"), F.col("error"))).repartition(5)
    order = rows.sort_values(["run_id", "error", "place_a", "place_b"], ascending=[True, False, True, True], na_position="last")
    for k in (3, 2_000, 20_000):
        small, large = (metrics.top_errors(frame, k, limit) for limit in (10**9, 0))
        want = {(r.run_id, r.place_b): i for _, part in order.groupby("run_id") for i, r in enumerate(part.head(k).itertuples(), 1)}
        for table in (small, large):
            assert {(r.run_id, r.place_b): r["rank"] for r in table.collect()} == want
    reached = metrics._least_errors(frame, 2_000).collect()
    left = sum(int(((rows.run_id == r.run_id) & ((rows.error >= r._least) if r._least is not None else True)).sum()) for r in reached)
    assert 4_050 <= left < 4_800
    assert metrics.top_errors(frame.limit(0), 10, 0).count() == 0
