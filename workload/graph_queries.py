"""Graph construction and distance metrics."""

from pyspark.sql import functions as F

from placemap.constants import KEY
from placemap.operators import graph, metrics
from placemap.operators.geometry import in_box
from placemap.operators.joins import sized_join, with_endpoints
from placemap.sources.storage import new_path
from placemap.sources.zoom import read_edges, read_places, write_edges, write_places
from workload.fixtures import Tables
from workload.registry import pick, query, r, rounded

BOX = (500.0, 325.0, 800.0, 400.0)

ENDS = """
  FROM distances d JOIN positions a ON a.run_id=d.run_id AND a.name=d.place_a
  JOIN positions b ON b.run_id=d.run_id AND b.name=d.place_b"""
LENGTH = "sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))"
ERROR = f"abs({LENGTH}-d.li_eval/1e1)/(d.li_eval/1e1)"
RAW = f"SUM(({LENGTH}*4.15e0-d.li_eval*0.415e0)*({LENGTH}*4.15e0-d.li_eval*0.415e0))"
KRUSKAL = f"sqrt({RAW}/NULLIF(SUM({LENGTH}*4.15e0*{LENGTH}*4.15e0),0))"


@query("SELECT DISTINCT run_id, place_a AS name FROM distances UNION SELECT DISTINCT run_id, place_b FROM distances")
def vertices(t: Tables):
    return graph.vertices(t.distances())


@query("SELECT run_id, name, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY name)-1 AS id FROM positions")
def dense_ids(t: Tables):
    return graph.dense_ids(t.positions().select(KEY, "name"), partitions=8)


@query("SELECT run_id, place_a, place_b FROM distances")
def edges(t: Tables):
    return graph.edges(t.distances())


@query("""
SELECT run_id, place_a, place_b, li_eval, li_spring FROM distances
UNION ALL SELECT run_id, place_b, place_a, li_eval, li_spring FROM distances""")
def symmetric_edges(t: Tables):
    return graph.symmetric_edges(t.distances())


@query("""
SELECT run_id, name, COUNT(*) AS degree FROM (
  SELECT run_id, place_a AS name FROM distances UNION ALL SELECT run_id, place_b FROM distances) e
GROUP BY run_id, name""")
def adjacency_degree(t: Tables):
    return graph.degrees(t.distances())


PAGE_ROWS = 20
_PAGE = "CAST('0x'||substr(md5(concat_ws('|','page',neighbor,li_eval,li_spring)),1,8) AS BIGINT)/4294967296e0"


@query(f"""
WITH e AS (
  SELECT run_id, place_a AS name, place_b AS neighbor, li_eval, li_spring FROM distances
  UNION ALL SELECT run_id, place_b, place_a, li_eval, li_spring FROM distances),
c AS (SELECT run_id, name, neighbor, li_eval, li_spring, COUNT(*) AS copies FROM e GROUP BY ALL),
n AS (SELECT run_id, name, CAST(ceil(COUNT(*)/{PAGE_ROWS}e0) AS BIGINT) AS pages FROM c GROUP BY run_id, name),
p AS (SELECT c.*, pages, CAST(floor({_PAGE}*pages) AS BIGINT) AS page FROM c JOIN n ON n.run_id=c.run_id AND n.name=c.name)
SELECT run_id, name, pages, page, CAST(SUM(copies) AS BIGINT) AS entries,
  md5(string_agg(neighbor||':'||li_eval||':'||li_spring||':'||copies, ',' ORDER BY neighbor, li_eval, li_spring)) AS list
FROM p GROUP BY run_id, name, pages, page""")
def adjacency(t: Tables):
    """Pages so small that most places have several."""
    lists = graph.adjacency(t.distances(), page_rows=PAGE_ROWS)
    text = F.transform(
        "neighbors",
        lambda n: F.concat_ws(":", n.neighbor, n.li_eval.cast("string"), n.li_spring.cast("string"), n.copies.cast("string")),
    )
    whole = [F.col(c).cast("bigint").alias(c) for c in ("pages", "page")]
    return lists.select(KEY, "name", *whole, "entries", F.md5(F.array_join(text, ",")).alias("list"))


@query("""
SELECT DISTINCT run_id, name FROM (
  SELECT run_id, place_a AS name FROM distances UNION ALL SELECT run_id, place_b FROM distances) e
WHERE name NOT IN (SELECT alias1 FROM ground_truth UNION ALL SELECT alias2 FROM ground_truth UNION ALL SELECT alias3 FROM ground_truth)""")
def missing_names(t: Tables):
    known = t.ground_truth().select(F.explode("aliases").alias("name"))
    return graph.missing_names(t.distances(), sized_join(t.positions(), known, "name", "left_semi"))


@query(f"SELECT d.run_id, place_a, place_b, li_eval, {r('a.x',6)} AS x1, {r('a.y',6)} AS y1, {r('b.x',6)} AS x2, {r('b.y',6)} AS y2 {ENDS}")
def endpoint_join(t: Tables):
    joined = with_endpoints(t.distances(), t.positions())
    return pick(joined, KEY, "place_a", "place_b", "li_eval", x1=6, y1=6, x2=6, y2=6)


@query(f"SELECT d.run_id, COUNT(*) AS n, {r(f'AVG({LENGTH})',6)} AS mean_px {ENDS} GROUP BY d.run_id")
def endpoint_join_salted(t: Tables):
    """The same lookup with hub places spread over eight tasks."""
    joined = with_endpoints(t.one_map_distances(), t.positions(), salts=8)
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return joined.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(length), 6).alias("mean_px"))


@query(f"SELECT d.run_id, {r(f'{RAW}/1e6',6)} AS raw_stress_m {ENDS} GROUP BY d.run_id")
def raw_stress(t: Tables):
    stress = metrics.raw_stress(t.distances(), t.positions())
    return stress.select(KEY, rounded(F.col("raw_stress") / 1e6, 6).alias("raw_stress_m"))


@query(f"SELECT d.run_id, {r(KRUSKAL,8)} AS kruskal_stress {ENDS} GROUP BY d.run_id")
def kruskal_stress(t: Tables):
    return pick(metrics.kruskal_stress(t.distances(), t.positions()), KEY, kruskal_stress=8)


@query(f"""SELECT d.run_id, {r(f'{RAW}/1e6',6)} AS raw_stress_m, {r(KRUSKAL,8)} AS kruskal_stress, COUNT(*) AS n_edges,
  COUNT(*) FILTER (WHERE {ERROR}>3e-2) AS n_bad_edges {ENDS} GROUP BY d.run_id""")
def layout_scores(t: Tables):
    scores = metrics.layout_scores(t.distances(), t.positions())
    scores = scores.withColumn("raw_stress_m", F.col("raw_stress") / 1e6)
    return pick(scores, KEY, "n_edges", "n_bad_edges", raw_stress_m=6, kruskal_stress=8)


@query(f"""SELECT d.run_id, place_a, place_b, li_eval, {r(ERROR,8)} AS error,
  {r(f'({LENGTH}-d.li_eval/1e1)*4.15e0',6)} AS delta_km, {r('d.li_eval*0.415e0',6)} AS ideal_km {ENDS}""")
def edge_error(t: Tables):
    errors = metrics.edge_error(t.distances(), t.positions())
    return pick(errors, KEY, "place_a", "place_b", "li_eval", error=8, delta_km=6, ideal_km=6)


@query(f"""SELECT d.run_id, place_a, place_b, li_eval, li_spring, {r(ERROR,8)} AS error {ENDS} WHERE {ERROR}>3e-2
ORDER BY 1, 6 DESC""")
def edge_error_report(t: Tables):
    report = metrics.error_report(metrics.edge_error(t.distances(), t.positions()))
    return pick(report, KEY, "place_a", "place_b", "li_eval", "li_spring", error=8)


@query(f"""
WITH e AS (SELECT d.run_id, place_a, place_b, li_eval, li_spring, {ERROR} AS error {ENDS}),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY error DESC, place_a, place_b, li_eval, li_spring) AS rank FROM e)
SELECT run_id, rank, place_a, place_b, {r('error',8)} AS error FROM k WHERE rank<=5""")
def edge_error_topk(t: Tables):
    top = metrics.top_errors(metrics.edge_error(t.distances(), t.positions()), 5)
    top = top.withColumn("rank", F.col("rank").cast("bigint"))
    return pick(top, KEY, "rank", "place_a", "place_b", error=8)


@query(f"""
WITH e AS (SELECT d.run_id, place_a, place_b, li_eval, li_spring, {ERROR} AS error {ENDS}),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY error DESC) AS rank FROM e)
SELECT run_id, COUNT(*) AS n, MAX(rank) AS last_rank, {r('MIN(error)',8)} AS least_error, {r('MAX(error)',8)} AS most_error,
  {r('AVG(error)',8)} AS mean_error FROM k WHERE rank<=20000 GROUP BY run_id""")
def edge_error_topk_large(t: Tables):
    """The 20,000 worst edges of each run, by a bound of the last one's error and ranks in ranges."""
    top = metrics.top_errors(metrics.edge_error(t.distances(), t.positions()), 20_000)
    error = F.col("error")
    found = top.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("last_rank"), F.min(error).alias("least_error"), F.max(error).alias("most_error"), F.avg(error).alias("mean_error")
    )
    return pick(found, KEY, "n", "last_rank", least_error=8, most_error=8, mean_error=8)


ZOOMED = "sqrt(1200e0*750/(300e0*75))"
INSIDE = "a.x BETWEEN 500 AND 800 AND a.y BETWEEN 325 AND 400 AND b.x BETWEEN 500 AND 800 AND b.y BETWEEN 325 AND 400"


ZOOM = f"""SELECT d.run_id, place_a, place_b, li_eval, {r(f'(a.x-650)*{ZOOMED}+600',6)} AS x1, {r(f'(a.y-362.5e0)*{ZOOMED}+375',6)} AS y1,
  {r(ERROR,8)} AS error {ENDS} WHERE {INSIDE}"""


@query(ZOOM)
def edge_error_zoom(t: Tables):
    errors = metrics.edge_error(t.distances(), t.positions(), BOX)
    return pick(errors, KEY, "place_a", "place_b", "li_eval", x1=6, y1=6, error=8)


@query(ZOOM)
def edge_error_zoom_stored(t: Tables):
    """The same errors from edges stored along a curve: only the box's stretches of it are read, and nothing is joined."""
    path = new_path(t.spark, "zoom-edges")
    write_edges(t.distances(), t.positions(), path)
    return pick(metrics.edge_error_of_ends(read_edges(t.spark, path, BOX), BOX), KEY, "place_a", "place_b", "li_eval", x1=6, y1=6, error=8)


@query(f"SELECT run_id, name, {r('x',6)} AS x, {r('y',6)} AS y FROM positions WHERE x BETWEEN 500 AND 800 AND y BETWEEN 325 AND 400")
def places_in_box_stored(t: Tables):
    path = new_path(t.spark, "zoom-places")
    write_places(t.positions(), path)
    return pick(read_places(t.spark, path, BOX), KEY, "name", x=6, y=6)


@query(f"SELECT d.run_id, place_a, place_b, li_eval, li_spring {ENDS} WHERE {INSIDE}")
def edges_in_box(t: Tables):
    return metrics.edges_in_box(t.distances(), in_box(t.positions(), BOX)).select(
        KEY, "place_a", "place_b", "li_eval", "li_spring"
    )


LEVEL = f"trunc(255*(1-least(greatest({ERROR},0),3e-2)/3e-2))::INT"


@query(f"""SELECT d.run_id, place_a, place_b, li_eval, format('#ff{{:02x}}{{:02x}}', {LEVEL}, {LEVEL}) AS colour,
  printf('%.2f%% (+%.2fkm)', {ERROR}*100, {ERROR}*(d.li_eval*0.415e0)) AS label,
  {r('(a.x+b.x)/2',6)} AS mid_x, {r('(a.y+b.y)/2',6)} AS mid_y {ENDS}""")
def edge_labels(t: Tables):
    labels = metrics.edge_labels(metrics.edge_error(t.distances(), t.positions()))
    return pick(labels, KEY, "place_a", "place_b", "li_eval", "colour", "label", mid_x=6, mid_y=6)
