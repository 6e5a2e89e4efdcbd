"""Every file layout written and read back, and the map layers."""

from pyspark.sql import functions as F

from placemap.constants import KEY
from placemap.operators import metrics
from placemap.operators import truth as known
from placemap.operators.geometry import anchor_rows, positions_to_lonlat
from placemap.operators.graph import dense_ids
from placemap.operators.joins import one_run, sized_join
from placemap.operators.layers import map_layers
from placemap.schemas import DISTANCES_CSV
from placemap.sources.storage import new_path
from placemap.sources import readers, writers
from workload.fixtures import ALIGN, Tables
from workload.graph_queries import ENDS, ERROR
from workload.map_queries import INVERSE, _truth
from workload.registry import pick, query, r, rounded


def _written(table, label: str, header: bool = False) -> str:
    path = new_path(table.sparkSession, label)
    table.write.option("header", header).csv(path)
    return path


def _origin(t: Tables):
    return anchor_rows(_truth(t), ALIGN, lon0="lon", lat0="lat")


@query("SELECT CAST(0 AS BIGINT) AS run_id, place_a, place_b, li_eval, li_spring FROM one_map_distances")
def csv_roundtrip_distances(t: Tables):
    return readers.read_distances(t.spark, _written(t.one_map_distances(), "distances", header=True))


@query("SELECT CAST(0 AS BIGINT) AS run_id, place_a, place_b, direction FROM one_map_directions")
def csv_roundtrip_directions(t: Tables):
    return readers.read_directions(t.spark, _written(t.one_map_directions(), "directions"))


@query(f"SELECT row_no, alias1, alias2, alias3, {r('lon',6)} AS lon, {r('lat',6)} AS lat FROM ground_truth")
def csv_roundtrip_ground_truth(t: Tables):
    places = {0: F.col("row_no"), 23: F.col("lon"), 24: F.col("lat")}
    places |= {i + 2: F.col("aliases")[i] for i in range(3)}
    wide = t.ground_truth().select(*[places.get(i, F.lit("")).alias(f"c{i}") for i in range(25)])
    rows = readers.read_ground_truth(t.spark, _written(wide, "truth", header=True), row_no_column=0)
    alias = [F.coalesce(F.col("aliases")[i], F.lit("")).alias(f"alias{i + 1}") for i in range(3)]
    return rows.select("row_no", *alias, rounded("lon", 6).alias("lon"), rounded("lat", 6).alias("lat"))


@query("SELECT name, CAST(CASE name WHEN 'P3' THEN 1 ELSE group_id END AS BIGINT) AS group_id FROM classes")
def csv_roundtrip_classes(t: Tables):
    rows = readers.read_classes(t.spark, _written(t.classes(), "classes"), overrides={"P3": 1})
    return rows.select("name", F.col("group_id").cast("bigint").alias("group_id"))


@query(f"WITH {INVERSE} SELECT run_id, name, {r('lon',6)} AS lon, {r('lat',6)} AS lat, CAST(5 AS BIGINT) AS cluster FROM ll")
def csv_roundtrip_positions_lonlat(t: Tables):
    """Both layouts as map files."""
    path = new_path(t.spark, "positions-lonlat")
    writers.write_positions_lonlat(t.positions(), _origin(t), path, by_run=True)
    rows = readers.read_positions_lonlat(t.spark, path).withColumn("cluster", F.col("cluster").cast("bigint"))
    return pick(rows, KEY, "name", "cluster", lon=6, lat=6)


@query(f"""WITH {INVERSE}, i AS (SELECT name, (ROW_NUMBER() OVER (ORDER BY name)-1)%6 AS cluster FROM one_map)
SELECT run_id, ll.name, {r('lon',6)} AS lon, {r('lat',6)} AS lat, cluster FROM ll JOIN i ON i.name=ll.name""")
def csv_roundtrip_samples_lonlat(t: Tables):
    path = new_path(t.spark, "samples-lonlat")
    writers.write_samples_lonlat(t.positions(), _origin(t), path)
    rows = readers.read_samples_lonlat(t.spark, path).withColumn("cluster", F.col("cluster").cast("bigint"))
    return pick(rows, KEY, "name", "cluster", lon=6, lat=6)


@query(f"WITH {INVERSE} SELECT run_id, name, {r('lon',6)} AS lon, {r('lat',6)} AS lat FROM ll")
def parquet_roundtrip_samples(t: Tables):
    path = new_path(t.spark, "samples-parquet")
    writers.write_samples_lonlat(t.positions(), _origin(t), path, format="parquet")
    return pick(t.spark.read.parquet(path), KEY, "name", lon=6, lat=6)


LAYER = f"""el AS (SELECT e.run_id, place_a AS start_name, a.lon AS start_lon, a.lat AS start_lat, place_b AS end_name,
    b.lon AS end_lon, b.lat AS end_lat, error AS err_val
  FROM (SELECT d.run_id, place_a, place_b, {ERROR} AS error {ENDS}) e
  JOIN ll a ON a.run_id=e.run_id AND a.name=e.place_a JOIN ll b ON b.run_id=e.run_id AND b.name=e.place_b)"""


def _edge_columns(digits: str) -> str:
    return ", ".join(f"{r(c, 6)} AS {c}" for c in ("start_lon", "start_lat", "end_lon", "end_lat")) + digits


@query(f"WITH {INVERSE}, {LAYER} SELECT run_id, start_name, end_name, {_edge_columns('')}, {r('err_val',8)} AS err_val FROM el")
def csv_roundtrip_edge_errors(t: Tables):
    positions = t.positions()
    path = new_path(t.spark, "edge-errors")
    writers.write_edge_errors(metrics.edge_error(t.distances(), positions), positions, _origin(t), path, by_run=True)
    rows = readers.read_edge_errors(t.spark, path)
    return pick(rows, KEY, "start_name", "end_name", start_lon=6, start_lat=6, end_lon=6, end_lat=6, err_val=8)


@query(f"WITH {INVERSE}, {LAYER} SELECT run_id, start_name, end_name, {_edge_columns('')}, {r('err_val',8)} AS err_val FROM el")
def edge_error_layer(t: Tables):
    positions = t.positions()
    layer = metrics.edge_error_layer_of_places(t.distances(), positions_to_lonlat(positions, _origin(t)))
    return pick(layer, KEY, "start_name", "end_name", start_lon=6, start_lat=6, end_lon=6, end_lat=6, err_val=8)


@query(f"SELECT run_id, name, {r('x',6)} AS x, {r('y',6)} AS y FROM positions")
def csv_roundtrip_positions(t: Tables):
    path = new_path(t.spark, "positions")
    writers.write_positions(t.positions(), path, by_run=True)
    return pick(t.spark.read.schema("name string, x double, y double, run_id bigint").csv(path), KEY, "name", x=6, y=6)


@query("""SELECT CASE WHEN li_eval%7=0 THEN NULL ELSE place_a END AS place_a, CASE WHEN li_eval%7=0 THEN NULL ELSE li_eval END AS li_eval,
  CASE WHEN li_eval%7=0 THEN concat_ws(',', place_a, place_b, li_eval||'?', li_spring) END AS line,
  CASE WHEN li_eval%7=0 THEN 'no bigint in li_eval' END AS reason FROM one_map_distances""")
def rejects(t: Tables):
    """Good and bad rows of a file of distances; together they are all its rows."""
    li = F.col("li_eval").cast("string")
    table = t.one_map_distances().withColumn("li_eval", F.when(F.col("li_eval") % 7 == 0, F.concat(li, F.lit("?"))).otherwise(li))
    good, bad = readers.with_rejects(t.spark, _written(table, "broken", header=True), DISTANCES_CSV, header=True)
    none = F.lit(None).cast("string")
    return good.select("place_a", "li_eval", none.alias("line"), none.alias("reason")).unionByName(
        bad.select(none.alias("place_a"), F.lit(None).cast("bigint").alias("li_eval"), "line", "reason")
    )


@query("""SELECT run_id, COUNT(*) FILTER (li_eval%7<>0) AS n_good, COUNT(*) FILTER (li_eval%7=0) AS n_bad, COUNT(*) AS n_lines,
  COUNT(DISTINCT CASE WHEN li_eval%7=0 THEN 'no bigint in li_eval' END) AS n_reasons
FROM (SELECT p.run_id, d.li_eval FROM one_map_distances d CROSS JOIN (SELECT range AS run_id FROM range(2)) p) GROUP BY run_id""")
def rejects_by_run(t: Tables):
    """Good and bad lines of a folder of files per run, each table counted by itself; no line number occurs twice in a file."""
    li = F.col("li_eval").cast("string")
    broken = F.when(F.col("li_eval") % 7 == 0, F.concat(li, F.lit("?"))).otherwise(li)
    path = new_path(t.spark, "broken-runs")
    table = t.one_map_distances().withColumn("li_eval", broken).withColumn(KEY, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    table.write.option("header", True).partitionBy(KEY).csv(path)
    good, bad = readers.with_rejects(t.spark, path, DISTANCES_CSV, header=True)
    n_good = good.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_good"))
    n_bad = bad.groupBy(KEY).agg(F.count_distinct("file", "line_no").alias("n_bad"), F.count_distinct("reason").alias("n_reasons"))
    both = n_good.unionByName(n_bad, allowMissingColumns=True).groupBy(KEY).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_good", "n_bad", "n_reasons")])
    return both.withColumn("n_lines", F.col("n_good") + F.col("n_bad"))


_LEVEL = "trunc(255*(1-least(greatest(err_val,0),3e-2)/3e-2))::INT"
_NAMES = "['red','green','blue','orange','purple','brown']"
LAYERS = f"""{INVERSE}, {LAYER},
ix AS (SELECT name, (ROW_NUMBER() OVER (ORDER BY name)-1)%6 AS cluster FROM one_map),
ly AS (
  SELECT run_id, 'node' AS layer, name, lon, lat, {_NAMES}[5+1] AS colour, 5e0 AS radius, 0.9e0 AS opacity, name AS tooltip,
    NULL AS end_name, NULL::DOUBLE AS end_lon, NULL::DOUBLE AS end_lat, NULL::DOUBLE AS weight FROM ll
  UNION ALL SELECT run_id, 'sample', ll.name, lon, lat, {_NAMES}[cluster+1], 2e0, 0.5e0, NULL, NULL, NULL, NULL, NULL
    FROM ll JOIN ix ON ix.name=ll.name
  UNION ALL SELECT run_id, 'truth', name, lon, lat, {_NAMES}[2+1], 5e0, 0.9e0, name, NULL, NULL, NULL, NULL FROM truth
    WHERE lon IS NOT NULL
  UNION ALL SELECT run_id, 'edge', start_name, start_lon, start_lat, format('#ff{{:02x}}{{:02x}}', {_LEVEL}, {_LEVEL}), NULL, NULL,
    printf('%.1f%%', err_val*100), end_name, end_lon, end_lat, 4.5e0 FROM el)
SELECT run_id, layer, name, {r('lon',6)} AS lon, {r('lat',6)} AS lat, colour, radius, opacity, tooltip, end_name,
  {r('end_lon',6)} AS end_lon, {r('end_lat',6)} AS end_lat, weight FROM ly"""


def _layers(t: Tables):
    positions = t.positions()
    lonlat = positions_to_lonlat(positions, _origin(t))
    ids = dense_ids(one_run(t.places()))
    cluster = ids.select("name", F.pmod("id", F.lit(6)).alias("cluster"))
    return map_layers(
        lonlat.withColumn("cluster", F.lit(5)), sized_join(lonlat, cluster, "name"),
        known.truth_layer(lonlat, _truth(t)), metrics.edge_error_layer_of_places(t.distances(), lonlat),
    )


_PLAIN = (KEY, "layer", "name", "colour", "radius", "opacity", "tooltip", "end_name", "weight")


@query(f"WITH {LAYERS}")
def layers(t: Tables):
    return pick(_layers(t), *_PLAIN, lon=6, lat=6, end_lon=6, end_lat=6)


@query(f"WITH {LAYERS}")
def json_roundtrip_layers(t: Tables):
    table = _layers(t)
    path = new_path(t.spark, "layers")
    writers.write_layers(table, path)
    return pick(t.spark.read.schema(table.schema).json(path), *_PLAIN, lon=6, lat=6, end_lon=6, end_lat=6)
