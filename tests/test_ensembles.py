import math
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placemap import constants
from placemap.operators import density as kde
from placemap.operators import ensemble as stats
from placemap.operators import series
from placemap.sources import states


def _samples(spark, groups):
    rows = [(i, name, float(a), float(b)) for name, (x, y) in groups.items() for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["run_id", "name", "x", "y"]))


def _scott(x, y, tx, ty):
    cov = np.cov(np.vstack([x, y])) * len(x) ** (-1 / 3)
    inv, norm = np.linalg.inv(cov), 2 * math.pi * math.sqrt(np.linalg.det(cov)) * len(x)
    dx, dy = tx[:, None] - x[None, :], ty[:, None] - y[None, :]
    quad = inv[0, 0] * dx * dx + 2 * inv[0, 1] * dx * dy + inv[1, 1] * dy * dy
    return np.exp(-0.5 * quad).sum(1) / norm


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(5)
    x = rng.normal(500, 30, 3000)
    return {
        "cloud": (x, 300 + 0.5 * (x - 500) + rng.normal(0, 10, 3000)),
        "two": (np.r_[rng.normal(200, 5, 150), rng.normal(900, 5, 150)], rng.normal(400, 40, 300)),
        "pair": (np.array([1.0, 2.0, 2.0]), np.array([1.0, 1.0, 3.0])),
        "line": (np.arange(5.0), np.arange(5.0)),
        "point": (np.full(4, 7.0), np.full(4, 7.0)),
        "single": (np.array([3.0]), np.array([3.0])),
    }


@pytest.mark.parametrize("method", ["cells", "direct"])
def test_densities_at_samples(spark, groups, method):
    got = kde.kde_points(_samples(spark, groups), method=method).toPandas()
    assert set(got.name) == {"cloud", "two", "pair"}
    for name in ("cloud", "two", "pair"):
        x, y = groups[name]
        want = _scott(x, y, x, y)
        mine = got[got.name == name].sort_values("run_id").density.to_numpy()
        assert np.abs(mine - want).max() < 1e-10 * want.max()


@pytest.mark.parametrize("method", ["cells", "direct"])
def test_densities_on_the_grid(spark, groups, method):
    got = kde.kde_grid(_samples(spark, groups), 30, 25, method=method).toPandas()
    assert len(got) == 3 * 30 * 25
    for name in ("cloud", "two"):
        mine = got[got.name == name].sort_values("cell")
        want = _scott(*groups[name], mine.x.to_numpy(), mine.y.to_numpy())
        peak = _scott(*groups[name], *groups[name]).max()
        assert np.abs(mine.density.to_numpy() - want).max() < 1e-10 * peak
    assert (mine.x.iloc[-1], mine.y.iloc[-1]) == (1200.0, 750.0)


def test_grid_density_sums_to_one(spark):
    rng = np.random.default_rng(6)
    samples = _samples(spark, {"n": (rng.normal(600, 40, 200), rng.normal(375, 40, 200))})
    total = kde.kde_grid(samples, 121, 76).agg(F.sum("density")).first()[0]
    assert total * (1200 / 120) * (750 / 75) == pytest.approx(1, abs=1e-3)


def test_eligibility_and_range(spark, groups, table):
    samples = _samples(spark, groups)
    assert {r.name for r in kde.kde_eligible(samples).collect()} == {"cloud", "two", "pair", "line"}
    nothing = kde.density_range(kde.kde_points(samples.filter("name = 'line'"))).first()
    assert tuple(nothing) == (0.0, 1.0)
    rows = table("name string, density double, relative double", [("a", 0.0, 0.0), ("a", 2.0, 0.5), ("a", 1e-9, kde.FLOOR)])
    assert tuple(kde.density_range(rows).first()) == (0.0, 2.0)
    assert kde.positive_density(rows).count() == 1


@pytest.mark.parametrize("count", [2000, 2100])
def test_positive_cells_do_not_depend_on_method_or_count(spark, count):
    rng = np.random.default_rng(count)
    samples = _samples(spark, {"n": (rng.normal(600, 40, count), rng.normal(375, 40, count))})
    cells = {m: {r.cell for r in kde.positive_density(kde.kde_grid(samples, 60, 60, method=m)).collect()} for m in ("cells", "direct")}
    assert cells["cells"] == cells["direct"] and 200 < len(cells["cells"]) < 3600


def test_moments_and_ellipses(spark, groups):
    samples = _samples(spark, groups)
    x, y = groups["cloud"]
    row = stats.sample_moments(samples).filter("name = 'cloud'").first()
    cov = np.cov(x, y)
    assert (row.sxx, row.sxy, row.syy) == pytest.approx((cov[0, 0], cov[0, 1], cov[1, 1]))
    values, vectors = np.linalg.eigh(cov)
    ellipses = {r.level: r for r in stats.confidence_ellipses(samples).filter("name = 'cloud'").collect()}
    assert ellipses[0.95].width == pytest.approx(2 * math.sqrt(values[1] * 5.991464547), rel=1e-6)
    assert ellipses[0.95].height == pytest.approx(2 * math.sqrt(values[0] * 5.991464547), rel=1e-6)
    want = math.degrees(math.atan2(vectors[1, 1], vectors[0, 1]))
    assert (ellipses[0.9].angle - want) % 180 == pytest.approx(0, abs=1e-6) or (ellipses[0.9].angle - want) % 180 == pytest.approx(180)
    areas = [ellipses[level].width * ellipses[level].height for level in (0.85, 0.90, 0.95)]
    assert areas == sorted(areas)
    kept = {r.name for r in stats.drop_degenerate(stats.confidence_ellipses(samples)).collect()}
    assert {"cloud", "two", "pair"} <= kept and not kept & {"point", "single"}


def test_distinct_points(spark, groups):
    samples = _samples(spark, groups)
    counts = {r.name: r.n_distinct for r in stats.distinct_points(samples).collect()}
    assert counts["point"] == 1 and counts["pair"] == 3 and counts["single"] == 1
    rough = {r.name: r.n_distinct for r in stats.distinct_points(samples, approximate=True).collect()}
    assert rough["cloud"] == pytest.approx(3000, rel=0.15)


def test_sweeps(spark):
    runs = stats.runs(spark, 4000)
    normal = stats.sweep_normal(runs, seed=2).toPandas().set_index("run_id")
    assert tuple(normal.loc[0]) == (1.0, 1.0)
    assert normal.k_spring.mean() == pytest.approx(1, abs=2e-3) and normal.k_spring.std() == pytest.approx(0.025, rel=0.05)
    assert normal.k_repulsion.std() == pytest.approx(0.1, rel=0.05)
    flat = stats.sweep_uniform(runs, seed=2).toPandas().set_index("run_id")
    assert flat.k_repulsion.between(0.8, 1.2).all() and flat.k_repulsion.std() == pytest.approx(0.4 / math.sqrt(12), rel=0.05)
    again = stats.sweep_normal(runs.repartition(5), seed=2).toPandas().set_index("run_id").sort_index()
    assert again.equals(normal.sort_index())


def test_flatten_samples(table):
    arrays = table("run_id long, points array<struct<x double, y double>>", [(0, [(1.0, 2.0), (3.0, 4.0)]), (1, [(5.0, 6.0), (7.0, 8.0)])])
    ids = table("name string, id long", [("a", 0), ("b", 1)])
    rows = sorted(tuple(r) for r in stats.flatten_samples(arrays, ids).collect())
    assert rows == [(0, "a", 1.0, 2.0), (0, "b", 3.0, 4.0), (1, "a", 5.0, 6.0), (1, "b", 7.0, 8.0)]
    with pytest.raises(Exception, match="no place for slot 1"):
        stats.flatten_samples(arrays, ids.filter("id = 0")).collect()


def test_grown_ensemble_equals_one_pass_and_reads_new_files_only(spark, tmp_path):
    """Batches of very different sizes and spreads; samples of earlier batches are gone when later ones are added."""
    rng = np.random.default_rng(6)
    parts = [
        pd.DataFrame({"run_id": np.arange(n), "name": rng.choice(["a", "b", "c"], n), "x": rng.normal(600, s, n), "y": rng.normal(1e6, s, n)})
        for n, s in ((500, 3.0), (1, 1.0), (40, 1e-6), (2000, 50.0))
    ]
    parts.append(pd.DataFrame({"run_id": [0], "name": ["alone"], "x": [1.0], "y": [2.0]}))
    folder = str(tmp_path / "states")
    for i, part in enumerate(parts):
        path = tmp_path / f"samples{i}"
        spark.createDataFrame(part).write.parquet(str(path))
        for _ in range(2):  # a retried batch replaces itself
            states.add_batch(spark.read.parquet(str(path)), folder, f"runs{i}")
        shutil.rmtree(path)
    got = states.grown_moments(spark, folder).toPandas().set_index("name").sort_index()
    whole = stats.sample_moments(spark.createDataFrame(pd.concat(parts))).toPandas().set_index("name").sort_index()
    assert list(got.columns) == list(whole.columns) and (got.n == whole.n).all()
    np.testing.assert_allclose(got.to_numpy(float), whole.to_numpy(float), rtol=1e-9, equal_nan=True)
    assert states.read_states(spark, folder).count() <= 3 * len(parts)


def test_states_merge_in_any_grouping(spark):
    rng = np.random.default_rng(7)
    samples = spark.createDataFrame(pd.DataFrame({"run_id": np.arange(900), "name": rng.choice(["a", "b"], 900), "x": rng.normal(size=900), "y": rng.normal(size=900)}))
    many = stats.moment_states(samples, "run_id")
    for fan_in in (1, 16):
        got = stats.moments_of(stats.merge_states(many, fan_in)).toPandas().sort_values("name")
        want = stats.sample_moments(samples).toPandas().sort_values("name")
        np.testing.assert_allclose(got.drop(columns="name").to_numpy(float), want.drop(columns="name").to_numpy(float), rtol=1e-11)
    assert stats.merge_states(many.limit(0)).count() == 0


def test_stress_history_over_pages_with_gaps(spark, table):
    """Steps before zero, beyond a page, and steps that some places lack; exchanged edge rows follow pages, not steps."""
    rng = np.random.default_rng(8)
    steps = [*range(-3, 140), 500]
    rows = [(run, s, n, float(rng.normal()), float(rng.normal())) for run in (0, 1) for s in steps for n in "abcd" if rng.random() < 0.9]
    edges = [(run, a, b, int(rng.integers(1, 90)), 1) for run in (0, 1) for a, b in ("ab", "ac", "bd", "ab", "xd") for _ in range(2)]
    at = {(r, s, n): (x, y) for r, s, n, x, y in rows}
    want = {}
    for run, a, b, li, _ in edges:
        for s in steps:
            if (run, s, a) in at and (run, s, b) in at:
                (x1, y1), (x2, y2) = at[run, s, a], at[run, s, b]
                gap = np.hypot(x1 - x2, y1 - y2) * constants.KM_PER_PX - li * constants.LI_KM
                want[run, s] = want.get((run, s), 0.0) + gap**2
    trajectory = table("run_id long, iteration int, name string, x double, y double", rows)
    distances = table("run_id long, place_a string, place_b string, li_eval long, li_spring long", edges)
    for salts in (1, 3):
        history = series.stress_history(distances, trajectory, salts)
        assert history.schema["iteration"].dataType.simpleString() == "int"
        got = {(r.run_id, r.iteration): r.stress for r in history.collect()}
        assert got == pytest.approx(want)
    twice = trajectory.unionByName(trajectory.limit(1))
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        series.stress_history(distances, twice).collect()


def test_a_crowded_cell_is_many_short_rows_and_one_polynomial(spark):
    """A third of the samples lie in one cell: it comes as lists of a batch each, and no row of a point holds a block."""
    rng = np.random.default_rng(9)
    n = 30_000
    x, y = rng.normal(0, 10, n), rng.normal(0, 10, n)
    x[: n // 3], y[: n // 3] = rng.normal(5, 1e-3, n // 3), rng.normal(5, 1e-3, n // 3)
    samples = _samples(spark, {"a": (x, y)}).repartition(6)
    placed = kde._round_coordinates(samples, kde.kernels(samples))
    slices = kde._packed(placed, samples.schema.fields)
    sizes = slices.select("cu", "cv", F.size("points").alias("s")).toPandas()
    assert sizes.s.sum() == n and sizes.groupby(["cu", "cv"]).s.sum().max() >= n // 3 and sizes.s.max() <= 10_000
    assert sizes.groupby(["cu", "cv"]).size().max() >= 6
    sums = placed.select(*kde.CELL, "du", "dv").mapInPandas(kde._power_sums, kde._BLOCKS)
    assert sums.count() < 0.6 * n
    got = kde.kde_points(samples).toPandas().sort_values("run_id")
    some = rng.choice(n, 60, replace=False)
    want = _scott(x, y, x[some], y[some])
    assert np.abs(got.density.to_numpy()[some] - want).max() < 1e-8 * want.max()
