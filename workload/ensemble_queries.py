"""Ensemble statistics, densities, random starts and stress histories."""

from pyspark.sql import functions as F

from placemap.constants import KEY
from placemap.operators import density as kde
from placemap.operators import ensemble as stats
from placemap.operators import graph, series
from placemap.operators.geometry import random_positions as draw
from placemap.operators.joins import one_run
from placemap.plans.layout import start_positions as start
from placemap.sources.states import add_batch, grown_moments
from placemap.sources.storage import new_path
from workload.fixtures import Tables
from workload.graph_queries import RAW
from workload.registry import pick, query, r, rounded

MOMENTS = """mo AS (SELECT name, COUNT(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS sxx, covar_samp(x,y) AS sxy,
  var_samp(y) AS syy FROM samples GROUP BY name)"""
KERNEL = f"""{MOMENTS},
ke AS (SELECT *, pow(n,-1/3e0) AS h2, sxx*syy-sxy*sxy AS det FROM mo WHERE n>=2 AND sxx*syy-sxy*sxy>1e-14*sxx*syy)"""


def _kernel_sum(tx: str, ty: str) -> str:
    dx, dy = f"({tx}-s.x)", f"({ty}-s.y)"
    quad = f"(k.syy*{dx}*{dx}-2*k.sxy*{dx}*{dy}+k.sxx*{dy}*{dy})/(k.det*k.h2)"
    return f"SUM(exp(-0.5e0*{quad}))/(k.n*2*pi()*sqrt(k.det)*k.h2)"


POINTS = f"""{KERNEL},
de AS (SELECT t.run_id, t.name, t.x, t.y, {_kernel_sum('t.x', 't.y')} AS density
  FROM samples t JOIN ke k ON k.name=t.name JOIN samples s ON s.name=t.name
  GROUP BY t.run_id, t.name, t.x, t.y, k.n, k.det, k.h2)"""
NX, NY = 20, 20
GRID = f"""{KERNEL},
gr AS (SELECT i*{NY}+j AS cell, i*1200e0/{NX - 1} AS x, j*750e0/{NY - 1} AS y FROM range({NX}) a(i) CROSS JOIN range({NY}) b(j)),
dg AS (SELECT k.name, g.cell, g.x, g.y, {_kernel_sum('g.x', 'g.y')} AS density
  FROM ke k CROSS JOIN gr g JOIN samples s ON s.name=k.name GROUP BY k.name, g.cell, g.x, g.y, k.n, k.det, k.h2)"""


@query(f"WITH {MOMENTS} SELECT name, {r('mx',6)} AS mx, {r('my',6)} AS my FROM mo")
def sample_mean(t: Tables):
    return pick(stats.sample_mean(t.samples()), "name", mx=6, my=6)


@query(f"WITH {MOMENTS} SELECT name, n, {r('sxx',6)} AS sxx, {r('sxy',6)} AS sxy, {r('syy',6)} AS syy FROM mo")
def sample_cov(t: Tables):
    return pick(stats.sample_cov(t.samples()), "name", "n", sxx=6, sxy=6, syy=6)


@query("SELECT name, COUNT(*) AS n, COUNT(DISTINCT (x, y)) AS n_distinct FROM samples GROUP BY name")
def distinct_points(t: Tables):
    return stats.distinct_points(t.samples())


@query("""SELECT name, COUNT(*) AS n FROM samples GROUP BY name
HAVING COUNT(*)>=2 AND COUNT(DISTINCT (x, y))>1""")
def kde_eligible(t: Tables):
    return kde.kde_eligible(t.samples())


ELLIPSES = f"""WITH {MOMENTS},
ei AS (SELECT *, greatest((sxx+syy)/2+sqrt(pow((sxx-syy)/2,2)+sxy*sxy),0) AS l1,
  greatest((sxx+syy)/2-sqrt(pow((sxx-syy)/2,2)+sxy*sxy),0) AS l2, degrees(0.5e0*atan2(2*sxy,sxx-syy)) AS angle FROM mo),
lv AS (SELECT * FROM (VALUES (0.95e0,0.3e0),(0.9e0,0.2e0),(0.85e0,0.1e0)) t(level,opacity))
SELECT name, level, opacity, {r('mx',6)} AS mx, {r('my',6)} AS my, {r('2*sqrt(l1*-2*ln(1-level))',6)} AS width,
  {r('2*sqrt(l2*-2*ln(1-level))',6)} AS height, {r('angle',6)} AS angle FROM ei CROSS JOIN lv WHERE l1>0 AND l2>0"""


@query(ELLIPSES)
def ellipses(t: Tables):
    table = stats.drop_degenerate(stats.confidence_ellipses(t.samples()))
    return pick(table, "name", "level", "opacity", mx=6, my=6, width=6, height=6, angle=6)


@query(ELLIPSES)
def ellipses_of_grown_ensemble(t: Tables):
    """The same ellipses from three batches of runs that were added one after the other; no batch is read again."""
    folder = new_path(t.spark, "moment-states")
    batch = F.pmod(F.xxhash64(KEY), F.lit(3))
    for i in range(3):
        add_batch(t.samples().filter(batch == i), folder, f"b{i}")
    table = stats.drop_degenerate(stats.ellipses_of(grown_moments(t.spark, folder)))
    return pick(table, "name", "level", "opacity", mx=6, my=6, width=6, height=6, angle=6)


def _density(table, *plain: str):
    """Densities per million square pixels, to more digits than the method's tolerance can change."""
    return table.select(*plain, rounded(F.col("density") * 1e6, 3).alias("density"))


@query(f"WITH {POINTS} SELECT run_id, name, {r('density*1e6',3)} AS density FROM de")
def kde_points(t: Tables):
    return _density(kde.kde_points(t.samples()), KEY, "name")


@query(f"WITH {POINTS} SELECT run_id, name, {r('density*1e6',3)} AS density FROM de")
def kde_points_cells(t: Tables):
    """The same densities with the method named."""
    return _density(kde.kde_points(t.samples(), method="cells"), KEY, "name")


@query(f"WITH {GRID} SELECT name, cell, {r('x',6)} AS x, {r('y',6)} AS y, {r('density*1e6',3)} AS density FROM dg")
def kde_grid(t: Tables):
    table = kde.kde_grid(t.samples(), NX, NY).withColumn("cell", F.col("cell").cast("bigint"))
    table = table.withColumns({"x": rounded("x", 6), "y": rounded("y", 6)})
    return _density(table, "name", "cell", "x", "y")


@query(f"WITH {GRID} SELECT name, cell, {r('density*1e6',3)} AS density FROM dg")
def kde_grid_cells(t: Tables):
    table = kde.kde_grid(t.samples(), NX, NY, method="cells").withColumn("cell", F.col("cell").cast("bigint"))
    return _density(table, "name", "cell")


@query(f"""WITH {GRID} SELECT name, cell, {r('density*1e6',3)} AS density FROM dg JOIN ke USING (name)
WHERE density*2*pi()*sqrt(det)*h2>1e-6""")
def positive_density(t: Tables):
    """Grid cells whose density lies above the floor, a millionth of the most their place could have."""
    table = kde.kde_grid(t.samples(), NX, NY).withColumn("cell", F.col("cell").cast("bigint"))
    return _density(kde.positive_density(table), "name", "cell")


@query(f"WITH {POINTS} SELECT {r('MIN(density)*1e6',3)} AS min_density, {r('MAX(density)*1e6',3)} AS max_density FROM de")
def density_range(t: Tables):
    spread = kde.density_range(kde.kde_points(t.samples()))
    return spread.select(*[rounded(F.col(c) * 1e6, 3).alias(c) for c in spread.columns])


def _hash(*parts: str) -> str:
    return f"CAST('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,8) AS BIGINT)"


def _uniform(*parts: str) -> str:
    return f"({_hash(*parts)}/4294967296e0)"


def _normal(*parts: str) -> str:
    radius = f"sqrt(-2*ln(({_hash(*parts, chr(39) + 'r' + chr(39))}+0.5e0)/4294967296e0))"
    return f"({radius}*cos(2*pi()*{_uniform(*parts, chr(39) + 'a' + chr(39))}))"


_RX, _RY = _uniform("'3'", "run_id", "name", "'x'"), _uniform("'3'", "run_id", "name", "'y'")
RANDOM = f"rp AS (SELECT run_id, name, 120+960*{_RX} AS x, 75+600*{_RY} AS y FROM positions)"


@query(f"WITH {RANDOM} SELECT run_id, name, {r('x',6)} AS x, {r('y',6)} AS y FROM rp")
def random_positions(t: Tables):
    return pick(draw(t.positions(), seed=3), KEY, "name", x=6, y=6)


@query(f"""WITH {RANDOM}, c AS (SELECT run_id, avg(x) AS mx, avg(y) AS my FROM rp GROUP BY run_id)
SELECT rp.run_id, name, {r('(x-mx)/2+600',6)} AS x, {r('(y-my)/2+375',6)} AS y FROM rp JOIN c ON c.run_id=rp.run_id""")
def start_positions(t: Tables):
    return pick(start(t.positions().select(KEY, "name"), None, seed=3), KEY, "name", x=6, y=6)


@query(f"""SELECT vec_id AS run_id, {r(f"CASE vec_id WHEN 0 THEN 1 ELSE 1+0.025e0*{_normal("'1'", 'vec_id', "'spring'")} END",8)} AS k_spring,
  {r(f"CASE vec_id WHEN 0 THEN 1 ELSE 1+0.1e0*{_normal("'1'", 'vec_id', "'repulsion'")} END",8)} AS k_repulsion FROM embeddings""")
def sweep_normal(t: Tables):
    runs = t.read("embeddings").select(F.col("vec_id").alias(KEY))
    return pick(stats.sweep_normal(runs, seed=1), KEY, k_spring=8, k_repulsion=8)


@query(f"""SELECT vec_id AS run_id, {r(f"CASE vec_id WHEN 0 THEN 1 ELSE 1+0.05e0*(2*{_uniform("'1'", 'vec_id', "'spring'")}-1) END",8)} AS k_spring,
  {r(f"CASE vec_id WHEN 0 THEN 1 ELSE 1+0.2e0*(2*{_uniform("'1'", 'vec_id', "'repulsion'")}-1) END",8)} AS k_repulsion FROM embeddings""")
def sweep_uniform(t: Tables):
    runs = t.read("embeddings").select(F.col("vec_id").alias(KEY))
    return pick(stats.sweep_uniform(runs, seed=1), KEY, k_spring=8, k_repulsion=8)


@query(f"""WITH names AS (SELECT name, ROW_NUMBER() OVER (ORDER BY name)-1 AS id FROM one_map)
SELECT e.vec_id AS run_id, name, {r('600+300*CAST(embedding[2*id+1] AS DOUBLE)',6)} AS x,
  {r('375+300*CAST(embedding[2*id+2] AS DOUBLE)',6)} AS y
FROM embeddings e JOIN names ON 2*id+2<=len(embedding)""")
def flatten_samples(t: Tables):
    ids = graph.dense_ids(one_run(t.places()))
    return pick(stats.flatten_samples(t.sample_arrays(), ids), KEY, "name", x=6, y=6)


@query(f"""WITH tr AS (SELECT run_id, step, name, x*(1+step*2e-2) AS x, y*(1+step*1e-2) AS y FROM positions CROSS JOIN range(4) q(step))
SELECT d.run_id, a.step AS iteration, {r(f'{RAW}/1e6',6)} AS stress_m FROM distances d
JOIN tr a ON a.run_id=d.run_id AND a.name=d.place_a
JOIN tr b ON b.run_id=d.run_id AND b.name=d.place_b AND b.step=a.step GROUP BY d.run_id, a.step""")
def stress_history(t: Tables):
    """Stress of four steps of each run; every step stretches the layout."""
    step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("iteration")
    moved = t.positions().select(KEY, step, "name", "x", "y").withColumns({
        "x": F.col("x") * (1 + F.col("iteration") * 0.02), "y": F.col("y") * (1 + F.col("iteration") * 0.01),
    })
    table = series.stress_history(t.distances(), moved)
    return table.select(KEY, "iteration", rounded(F.col("stress") / 1e6, 6).alias("stress_m"))


@query(f"""SELECT run_id, {r('MIN(stress)',6)} AS min_stress, {r('MAX(stress)',6)} AS max_stress, COUNT(*) AS n_steps,
  {r('arg_max(stress, iteration)',6)} AS last_stress FROM history GROUP BY run_id""")
def history_summary(t: Tables):
    return pick(series.history_summary(t.history()), KEY, "n_steps", min_stress=6, max_stress=6, last_stress=6)


@query(f"SELECT run_id, iteration, {r('log10(stress+1e-8)',6)} AS log_stress FROM history")
def history_log(t: Tables):
    table = series.log_stress(t.history()).withColumn("iteration", F.col("iteration").cast("bigint"))
    return pick(table, KEY, "iteration", log_stress=6)


@query(f"""WITH l AS (SELECT run_id, iteration, log10(stress+1e-8) AS s FROM history),
g AS (SELECT run_id, MIN(s) AS lo, MAX(s) AS hi, MIN(iteration) AS a, MAX(iteration) AS b FROM l GROUP BY run_id)
SELECT l.run_id, iteration, {r('(iteration-a)/NULLIF(b-a,0)::DOUBLE',6)} AS step_share,
  {r('(s-lo)/NULLIF(hi-lo,0)',6)} AS stress_share FROM l JOIN g ON g.run_id=l.run_id""")
def history_normalised(t: Tables):
    table = series.normalise(t.history()).withColumn("iteration", F.col("iteration").cast("bigint"))
    return pick(table, KEY, "iteration", step_share=6, stress_share=6)


@query(f"""WITH g AS (SELECT run_id, COUNT(*) AS n FROM history GROUP BY run_id),
m AS (SELECT run_id, j AS tick, CAST(floor(j*(n-1)/5e0) AS BIGINT) AS step FROM g CROSS JOIN range(6) q(j))
SELECT m.run_id, tick, step, {r('stress',6)} AS stress FROM m JOIN history h ON h.run_id=m.run_id AND h.iteration=step+1""")
def history_ticks(t: Tables):
    table = series.ticks(t.history()).withColumn("tick", F.col("tick").cast("bigint"))
    return pick(table, KEY, "tick", "step", stress=6)
