import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import DIRECTIONS, DISTANCES, POSITIONS
from placemap.operators import forces
from placemap.operators import repulsion as crowds
from placemap.operators.repulsion import repulsion


def _brute(x, y, min_d=0.1, strength=5000.0):
    dx, dy = x[:, None] - x[None, :], y[:, None] - y[None, :]
    reach = np.maximum(np.hypot(dx, dy), min_d) ** 2
    return strength * (dx / reach).sum(1), strength * (dy / reach).sum(1)


def _frame(spark, runs):
    rows = [(run, f"{run}-{i}", float(a), float(b)) for run, (x, y) in runs.items() for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["run_id", "name", "x", "y"]))


def _check(result, runs):
    for run, (x, y) in runs.items():
        mine = result[result.run_id == run].set_index("name").loc[[f"{run}-{i}" for i in range(len(x))]]
        fx, fy = _brute(np.asarray(x), np.asarray(y))
        size = np.hypot(fx, fy).max() + 1
        assert np.abs(mine.fx - fx).max() / size < 1e-11 and np.abs(mine.fy - fy).max() / size < 1e-11


def test_repulsion_equals_all_pairs(spark):
    """A spread map, a dense spot, many places on one point, a tiny run and a single place."""
    rng = np.random.default_rng(1)
    x = np.r_[rng.uniform(120, 1080, 700), rng.normal(400, 0.4, 400), np.full(300, 600.0)]
    y = np.r_[rng.uniform(75, 675, 700), rng.normal(300, 0.4, 400), np.full(300, 375.0)]
    runs = {0: (x, y), 1: (rng.uniform(0, 100, 20), rng.uniform(0, 100, 20)), 2: ([5.0], [5.0]), 3: ([1.0, 1.0], [2.0, 2.0])}
    _check(repulsion(_frame(spark, runs), leaf=8).toPandas(), runs)


def test_repulsion_of_small_runs(spark):
    rng = np.random.default_rng(2)
    runs = {r: (rng.uniform(0, 1000, 35), rng.uniform(0, 700, 35)) for r in range(3)}
    runs[3] = ([7.0, 7.0, 7.05], [1.0, 1.0, 1.0])
    _check(repulsion(_frame(spark, runs)).toPandas(), runs)


def _met(frame, monkeypatch):
    """Pairs of cells that a crowd's rounds put out, and pairs of points met one by one."""
    found = []
    real = crowds.stored

    def stored(table, label):
        out = real(table, label)
        if label == "crowd-pairs":
            few = F.col("nt") * F.col("ns") <= 1024
            direct = F.when(few if "kind" not in out.columns else F.col("kind") == "few", F.col("nt") * F.col("ns"))
            found.append(out.agg(F.count(F.lit(1)), F.sum(direct)).first())
        return out

    monkeypatch.setattr(crowds, "stored", stored)
    repulsion(frame)
    return sum(cells for cells, _ in found), sum(points or 0 for _, points in found)


@pytest.mark.parametrize("size", [0.04, 0.3])
def test_crowded_spot_is_not_met_pairwise(spark, monkeypatch, size):
    """Four times the places in a spot: what lies within the limit or well beyond costs no more, the ring between the power 1.5."""
    rng = np.random.default_rng(4)
    met = {}
    for n in (4000, 16_000):
        x, y = rng.uniform(500, 500 + size, n), rng.uniform(300, 300 + size, n)
        runs = {0: (np.r_[x, 0.0, 1000.0], np.r_[y, 0.0, 700.0])}
        met[n] = _met(_frame(spark, runs), monkeypatch)
        if n == 4000:
            _check(repulsion(_frame(spark, runs)).toPandas(), runs)
    cells, points = zip(met[4000], met[16_000])
    assert cells[1] < 9.5 * cells[0] and points[1] <= 9.5 * points[0]
    assert points[1] < 16_000**2 / 8


def test_crowd_wider_than_the_limit(spark):
    rng = np.random.default_rng(8)
    runs = {0: (np.r_[rng.normal(500, 0.12, 500), 0.0, 900.0], np.r_[rng.normal(300, 0.12, 500), 0.0, 500.0])}
    _check(repulsion(_frame(spark, runs)).toPandas(), runs)


def test_a_far_place_deepens_its_own_run_only(spark):
    rng = np.random.default_rng(9)
    near = {r: (rng.uniform(0, 1000, 150), rng.uniform(0, 700, 150)) for r in (0, 1)}
    near[1][0][0] = 3e9
    frame = crowds._rooted(crowds._points(_frame(spark, near)), 0.1)
    depth = {r.run_id: r.deepest for r in frame.select("run_id", "deepest").distinct().collect()}
    assert depth[0] == 14 and depth[1] == 35
    with pytest.raises(Exception, match="without finite coordinates: 0-0"):
        repulsion(_frame(spark, {0: ([float("nan"), 1.0], [1.0, 2.0])})).collect()


def test_repulsion_sums_to_zero(spark):
    rng = np.random.default_rng(3)
    total = repulsion(_frame(spark, {0: (rng.uniform(0, 1000, 400), rng.uniform(0, 700, 400))}), leaf=8).agg(
        F.sum("fx").alias("fx"), F.sum("fy").alias("fy"), F.sum(F.abs("fx")).alias("size")
    ).first()
    assert abs(total.fx) < 1e-9 * total.size and abs(total.fy) < 1e-9 * total.size


def test_spring_force(table):
    positions = table(POSITIONS, [(0, "a", 0.0, 0.0), (0, "b", 30.0, 40.0), (0, "c", 0.0, 0.0)])
    pulled = forces.spring_force(table(DISTANCES, [(0, "a", "b", 1, 400), (0, "a", "c", 1, 100)]), positions, 2.0)
    at = {r.name: (r.fx, r.fy) for r in pulled.collect()}
    assert at["a"] == pytest.approx((12.0, 16.0)) and at["b"] == pytest.approx((-12.0, -16.0)) and at["c"] == (0, 0)


def test_direction_force_turns_the_right_way(table):
    positions = table(POSITIONS, [(0, "a", 0.0, 0.0), (0, "b", -10.0, 1.0)])
    # b should lie east of a but lies west and a little south: it must go round by the south
    turned = forces.direction_force(table(DIRECTIONS, [(0, "a", "b", "東")]), positions, 100.0)
    at = {r.name: (r.fx, r.fy) for r in turned.collect()}
    assert at["b"][0] > 0 and at["b"][1] > 0 and at["a"] == pytest.approx((-at["b"][0], -at["b"][1]))
    assert np.hypot(*at["b"]) == pytest.approx(100)
    # exactly opposite: the tie goes to the quarter turn of A -> B
    straight = table(POSITIONS, [(0, "a", 0.0, 0.0), (0, "b", -10.0, 0.0)])
    at = {r.name: (r.fx, r.fy) for r in forces.direction_force(table(DIRECTIONS, [(0, "a", "b", "東")]), straight, 1.0).collect()}
    assert at["b"] == pytest.approx((0, -1))


def test_net_force_adds_up(table):
    one = table("run_id long, name string, fx double, fy double", [(0, "a", 1.0, -2.0)])
    assert tuple(forces.net_force(one, one).first())[2:] == (2.0, -4.0)
