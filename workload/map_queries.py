"""Projections, known coordinates and compass constraints."""

import math

from pyspark.sql import functions as F

from placemap.constants import KEY
from placemap.operators import directions as compass
from placemap.operators import geometry as geo
from placemap.operators import metrics
from placemap.operators import truth as known
from placemap.plans.jobs import anchors_from_truth
from workload.fixtures import ALIGN, SECOND, Tables
from workload.graph_queries import ENDS, KRUSKAL
from workload.registry import pick, query, r

# The cone's constants, worked out by hand from both parallels and the ellipsoid: exponent, metres, metres, degrees.
CONE_N, CONE_SCALE, CONE_RHO0, CONE_LON0 = "0.6525767244663818e0", "12277317.05374555e0", "7802591.046333162e0", "82.99310002e0"
A, ECC = 6378137.0, math.sqrt((2 - 1 / 298.257223563) / 298.257223563)


def _truth(t: Tables):
    return known.resolve_aliases(t.ground_truth(), t.positions())


def lcc_sql(lon: str, lat: str) -> tuple[str, str]:
    """Projected metres as SQL, in the textbook form with powers."""
    phi = f"radians({lat})"
    s = f"({ECC!r}e0*sin({phi}))"
    t = f"(tan(pi()/4-{phi}/2)/pow((1-{s})/(1+{s}),{ECC / 2!r}e0))"
    rho = f"({CONE_SCALE}*pow({t},{CONE_N}))"
    theta = f"({CONE_N}*radians({lon}-{CONE_LON0}))"
    return f"({rho}*sin({theta}))", f"({CONE_RHO0}-{rho}*cos({theta}))"


_X, _Y = lcc_sql("t.lon", "t.lat")
_OX, _OY = lcc_sql("o.lon", "o.lat")
FORWARD = f"""fwd AS (
  SELECT t.run_id, t.name, ({_X}-{_OX})/1000 AS x_km, -({_Y}-{_OY})/1000 AS y_km
  FROM truth t LEFT JOIN truth o ON o.run_id=t.run_id AND o.name='{ALIGN}')"""

COMPARED = f"""{FORWARD},
cmp AS (
  SELECT p.run_id, p.name, (p.x-600)*4.15e0 AS x_km, (p.y-500)*4.15e0 AS y_km, f.x_km AS gx, f.y_km AS gy,
    sqrt(((p.x-600)*4.15e0-f.x_km)*((p.x-600)*4.15e0-f.x_km)+((p.y-500)*4.15e0-f.y_km)*((p.y-500)*4.15e0-f.y_km)) AS error_km
  FROM positions p JOIN fwd f ON f.run_id=p.run_id AND f.name=p.name WHERE f.x_km IS NOT NULL)"""


@query(f"SELECT run_id, name, {r('lon',6)} AS lon, {r('lat',6)} AS lat FROM truth")
def alias_resolution(t: Tables):
    return pick(_truth(t), KEY, "name", lon=6, lat=6)


@query(f"SELECT run_id, name, {r('lon',6)} AS lon, {r('lat',6)} AS lat, CAST(2 AS BIGINT) AS cluster FROM truth")
def truth_layer(t: Tables):
    layer = known.truth_layer(t.positions(), _truth(t))
    return pick(layer.withColumn("cluster", F.col("cluster").cast("bigint")), KEY, "name", "cluster", lon=6, lat=6)


@query(f"WITH {FORWARD} SELECT run_id, name, {r('x_km',6)} AS x_km, {r('y_km',6)} AS y_km FROM fwd")
def lcc_forward(t: Tables):
    return pick(geo.lcc_forward(_truth(t), ALIGN), KEY, "name", x_km=6, y_km=6)


@query(f"SELECT run_id, name, {r('lon',6)} AS lon, {r('lat',6)} AS lat FROM truth")
def lcc_there_and_back(t: Tables):
    """Forward and inverse projection give the known coordinates back."""
    truth = _truth(t)
    origin = geo.anchor_rows(truth, ALIGN, lon0="lon", lat0="lat")
    back = geo.lcc_inverse(geo.lcc_forward(truth, ALIGN).select(KEY, "name", "x_km", "y_km"), origin)
    return pick(back, KEY, "name", lon=6, lat=6)


def _inverse_sql() -> str:
    north = f"({CONE_RHO0}-y_m)"
    steps = []
    for i in range(6):
        s = f"({ECC!r}e0*sin(phi{i}))"
        steps.append(
            f"s{i + 1} AS (SELECT *, pi()/2-2*atan(t*pow((1-{s})/(1+{s}),{ECC / 2!r}e0)) AS phi{i + 1} FROM s{i})"
        )
    return f"""m AS (
  SELECT p.run_id, p.name, (p.x-600)*4.15e0*1000+{_OX} AS x_m, -(p.y-500)*4.15e0*1000+{_OY} AS y_m
  FROM positions p JOIN truth o ON o.run_id=p.run_id AND o.name='{ALIGN}'),
t0 AS (SELECT *, pow(sqrt(x_m*x_m+{north}*{north})/{CONE_SCALE}, 1/{CONE_N}) AS t,
  degrees(atan2(x_m,{north})/{CONE_N})+{CONE_LON0} AS lon FROM m),
s0 AS (SELECT *, pi()/2-2*atan(t) AS phi0 FROM t0),
{", ".join(steps)},
ll AS (SELECT run_id, name, lon, degrees(phi6) AS lat FROM s6)"""


INVERSE = _inverse_sql()


@query(f"WITH {INVERSE} SELECT run_id, name, {r('lon',6)} AS lon, {r('lat',6)} AS lat FROM ll")
def lcc_inverse(t: Tables):
    origin = geo.anchor_rows(_truth(t), ALIGN, lon0="lon", lat0="lat")
    return pick(geo.positions_to_lonlat(t.positions(), origin), KEY, "name", lon=6, lat=6)


@query(f"WITH {COMPARED} SELECT run_id, name, {r('x_km',6)} AS x_km, {r('gx',6)} AS truth_x_km, {r('error_km',6)} AS error_km FROM cmp")
def truth_error(t: Tables):
    compared = known.compare_truth(t.positions(), _truth(t), ALIGN)
    return pick(compared, KEY, "name", x_km=6, truth_x_km=6, error_km=6)


@query(f"WITH {COMPARED} SELECT run_id, {r('sqrt(avg(error_km*error_km))',6)} AS rmse_km, COUNT(*) AS n_places FROM cmp GROUP BY run_id")
def rmse(t: Tables):
    return pick(known.rmse(known.compare_truth(t.positions(), _truth(t), ALIGN)), KEY, "n_places", rmse_km=6)


@query(f"""WITH {COMPARED} SELECT run_id, {r('sqrt(avg(error_km*error_km))',6)} AS rmse_km, COUNT(*) AS n_places FROM cmp
WHERE name NOT IN ('{ALIGN}','{SECOND}') GROUP BY run_id""")
def rmse_without_anchors(t: Tables):
    compared = known.compare_truth(t.positions(), _truth(t), ALIGN)
    return pick(known.rmse(compared, exclude=(ALIGN, SECOND)), KEY, "n_places", rmse_km=6)


@query(f"""WITH {COMPARED}, s AS (SELECT run_id, name, least(error_km/(MAX(error_km) OVER (PARTITION BY run_id)),1) AS share FROM cmp)
SELECT run_id, name, {r('share',8)} AS share,
  format('#{{:02x}}00{{:02x}}', trunc(255*share)::INT, trunc(255*(1-share))::INT) AS colour FROM s""")
def error_scale(t: Tables):
    return pick(known.error_scale(known.compare_truth(t.positions(), _truth(t), ALIGN)), KEY, "name", "colour", share=8)


@query(f"""WITH {COMPARED}, a AS (SELECT run_id, sqrt(avg(error_km*error_km)) AS rmse_km FROM cmp GROUP BY run_id),
k AS (SELECT d.run_id, {KRUSKAL} AS kruskal_stress {ENDS} GROUP BY d.run_id)
SELECT a.run_id, {r('rmse_km',6)} AS rmse_km, {r('kruskal_stress',8)} AS kruskal_stress FROM a JOIN k ON a.run_id=k.run_id""")
def model_comparison(t: Tables):
    table = metrics.model_comparison(t.distances(), t.positions(), _truth(t), ALIGN)
    return pick(table, KEY, rmse_km=6, kruskal_stress=8)


@query(f"""WITH c AS (SELECT run_id, avg(x) AS mx, avg(y) AS my FROM positions GROUP BY run_id)
SELECT p.run_id, name, {r('(x-mx)/2+600',6)} AS x, {r('(y-my)/2+375',6)} AS y FROM positions p JOIN c ON c.run_id=p.run_id""")
def shift(t: Tables):
    return pick(geo.shift(t.positions()), KEY, "name", x=6, y=6)


@query(f"""WITH {FORWARD}, a AS (SELECT run_id, name, x_km/4.15e0+600 AS x, y_km/4.15e0+500 AS y FROM fwd
  WHERE name IN ('{ALIGN}','{SECOND}'))
SELECT p.run_id, p.name, {r('coalesce(a.x,p.x)',6)} AS x, {r('coalesce(a.y,p.y)',6)} AS y
FROM positions p LEFT JOIN a ON a.run_id=p.run_id AND a.name=p.name""")
def anchors(t: Tables):
    fixed = anchors_from_truth(_truth(t), ALIGN, (SECOND,))
    return pick(geo.apply_anchors(t.positions(), fixed), KEY, "name", x=6, y=6)


@query(f"SELECT run_id, name, {r('(x-600)*4.15e0',6)} AS x_km, {r('(y-500)*4.15e0',6)} AS y_km FROM positions")
def px_to_km(t: Tables):
    return pick(geo.px_to_km(t.positions()), KEY, "name", x_km=6, y_km=6)


@query(f"WITH {FORWARD} SELECT run_id, name, {r('x_km/4.15e0+600',6)} AS x, {r('y_km/4.15e0+500',6)} AS y FROM fwd")
def km_to_px(t: Tables):
    return pick(geo.km_to_px(geo.lcc_forward(_truth(t), ALIGN)), KEY, "name", x=6, y=6)


@query(f"""WITH f AS (
  SELECT a.run_id, a.x AS x1, a.y AS y1, 5e-1-atan2(b.y-a.y,b.x-a.x) AS turn
  FROM positions a JOIN positions b ON b.run_id=a.run_id AND b.name='{SECOND}' WHERE a.name='{ALIGN}'),
m AS (SELECT p.run_id, name, (x-x1)*4.15e0 AS dx, (y-y1)*4.15e0 AS dy, turn FROM positions p JOIN f ON f.run_id=p.run_id)
SELECT run_id, name, {r('dx*cos(turn)-dy*sin(turn)',6)} AS x_km, {r('dx*sin(turn)+dy*cos(turn)',6)} AS y_km FROM m""")
def align_rotate(t: Tables):
    return pick(geo.align_rotate(t.positions(), ALIGN, SECOND, 0.5), KEY, "name", x_km=6, y_km=6)


def _geodesic_sql(lon0: float, lat0: float) -> str:
    f, a = 1 / 298.257223563, A
    b = a * (1 - f)
    tan_u = (1 - f) * math.tan(math.radians(lat0))
    cos_u = 1 / math.sqrt(1 + tan_u * tan_u)
    sin_u = tan_u * cos_u
    parts = [f"""g0 AS (SELECT run_id, name, sqrt(x_km*x_km+y_km*y_km)*1000 AS s, atan2(y_km,x_km) AS az FROM (
  SELECT run_id, name, (x-600)*4.15e0 AS x_km, (y-500)*4.15e0 AS y_km FROM positions) k),
g1 AS (SELECT *, {cos_u!r}e0*sin(az) AS sa, atan2({tan_u!r}e0,cos(az)) AS s1 FROM g0),
g2 AS (SELECT *, (1-sa*sa)*{(a * a - b * b) / (b * b)!r}e0 AS uu FROM g1),
g3 AS (SELECT *, 1+uu/16384e0*(4096+uu*(-768+uu*(320-175*uu))) AS ca, uu/1024e0*(256+uu*(-128+uu*(74-47*uu))) AS cb FROM g2),
h0 AS (SELECT *, s/({b!r}e0*ca) AS sg0, s/({b!r}e0*ca) AS sg FROM g3)"""]
    for i in range(6):
        m = "cos(2*s1+sg)"
        parts.append(f"""h{i + 1} AS (SELECT * REPLACE (sg0+cb*sin(sg)*({m}+cb/4*(cos(sg)*(2*{m}*{m}-1)
  -cb/6*{m}*(4*sin(sg)*sin(sg)-3)*(4*{m}*{m}-3))) AS sg) FROM h{i})""")
    parts.append(f"""e AS (SELECT *, {sin_u!r}e0*sin(sg)-{cos_u!r}e0*cos(sg)*cos(az) AS ac,
  {f / 16!r}e0*(1-sa*sa)*(4+{f!r}e0*(4-3*(1-sa*sa))) AS cc, cos(2*s1+sg) AS m FROM h6),
ll AS (SELECT run_id, name,
  degrees(atan2({sin_u!r}e0*cos(sg)+{cos_u!r}e0*sin(sg)*cos(az), {1 - f!r}e0*sqrt(sa*sa+ac*ac))) AS lat,
  {lon0!r}e0+degrees(atan2(sin(sg)*sin(az), {cos_u!r}e0*cos(sg)-{sin_u!r}e0*sin(sg)*cos(az))
    -(1-cc)*{f!r}e0*sa*(sg+cc*sin(sg)*(m+cc*cos(sg)*(2*m*m-1)))) AS lon FROM e)""")
    return ",\n".join(parts)


@query(f"WITH {_geodesic_sql(89.840644, 40.527633)} SELECT run_id, name, {r('lon',6)} AS lon, {r('lat',6)} AS lat FROM ll")
def geodesic_offset(t: Tables):
    return pick(geo.geodesic_offset(geo.px_to_km(t.positions())), KEY, "name", lon=6, lat=6)


@query(f"SELECT run_id, name, {r('x',6)} AS x, {r('y',6)} AS y FROM positions WHERE x BETWEEN 500 AND 800 AND y BETWEEN 325 AND 400")
def in_box(t: Tables):
    return pick(geo.in_box(t.positions(), (500, 325, 800, 400)), KEY, "name", x=6, y=6)


@query(f"""SELECT run_id, name, {r('(x-650)*sqrt(40e0)+600',6)} AS x, {r('(y-362.5e0)*sqrt(40e0)+375',6)} AS y FROM positions
WHERE x BETWEEN 500 AND 800 AND y BETWEEN 325 AND 400""")
def zoom(t: Tables):
    box = (500, 325, 800, 400)
    return pick(geo.zoom(geo.in_box(t.positions(), box), box), KEY, "name", x=6, y=6)


@query(f"SELECT run_id, name, {r('x',6)} AS x, {r('750-y',6)} AS y FROM positions")
def flip_y(t: Tables):
    return pick(geo.flip_y(t.positions()), KEY, "name", x=6, y=6)


@query(f"""SELECT p.run_id, p.name, {r('(p.x-a.x)*0.412e0+600',6)} AS x, {r('(p.y-a.y)*0.412e0+500',6)} AS y
FROM positions p JOIN positions a ON a.run_id=p.run_id AND a.name='{ALIGN}'""")
def rescale_about(t: Tables):
    return pick(geo.rescale_about(t.positions(), ALIGN), KEY, "name", x=6, y=6)


@query("""SELECT run_id, name, CAST(trunc((x-600)*4.15e0*(1.2e0/4.15e0)+700) AS BIGINT) AS px,
  CAST(trunc((y-500)*4.15e0*(1.2e0/4.15e0)+500) AS BIGINT) AS py FROM positions""")
def canvas(t: Tables):
    placed = geo.to_canvas(geo.px_to_km(t.positions()))
    return placed.select(KEY, "name", F.col("px").cast("bigint").alias("px"), F.col("py").cast("bigint").alias("py"))


VECTORS = """
v AS (SELECT * FROM (VALUES ('E',1e0,0e0,true),('W',-1e0,0e0,true),('N',0e0,-1e0,true),('S',0e0,1e0,true),
  ('SE',1e0,1e0,false),('NW',-1e0,-1e0,false),('NE',1e0,-1e0,false),('SW',-1e0,1e0,false)) t(direction,vx,vy,cardinal)),
u AS (SELECT d.run_id, place_a, place_b, d.direction, cardinal, vx, vy,
    (b.x-a.x)/sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) AS ux, (b.y-a.y)/sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) AS uy
  FROM directions d JOIN v ON v.direction=d.direction
  JOIN positions a ON a.run_id=d.run_id AND a.name=d.place_a JOIN positions b ON b.run_id=d.run_id AND b.name=d.place_b),
c AS (SELECT *, CASE WHEN cardinal THEN ux*vx+uy*vy ELSE (ux*vx+uy*vy)/sqrt(2e0) END AS cosine FROM u),
broken AS (SELECT * FROM c WHERE cosine < CASE WHEN cardinal THEN 0e0 ELSE 1/sqrt(2e0) END)"""


@query(f"""WITH {VECTORS} SELECT run_id, place_a, place_b, direction, {r('ux',8)} AS ux, {r('uy',8)} AS uy, {r('cosine',8)} AS cosine FROM c""")
def direction_cosine(t: Tables):
    table = compass.direction_cosine(t.directions(), t.positions())
    return pick(table, KEY, "place_a", "place_b", "direction", ux=8, uy=8, cosine=8)


@query(f"WITH {VECTORS} SELECT run_id, place_a, place_b, direction, {r('cosine',8)} AS cosine FROM broken")
def violations(t: Tables):
    table = compass.direction_violations(t.directions(), t.positions())
    return pick(table, KEY, "place_a", "place_b", "direction", cosine=8)


@query(f"""WITH {VECTORS} SELECT c.run_id, COUNT(*) AS n_checked,
  COUNT(*) FILTER (WHERE cosine < CASE WHEN cardinal THEN 0e0 ELSE 1/sqrt(2e0) END) AS n_violations FROM c GROUP BY c.run_id""")
def violation_count(t: Tables):
    return compass.violation_count(t.directions(), t.positions())


@query(f"""WITH {VECTORS} SELECT p.run_id, p.name, EXISTS (SELECT 1 FROM broken b
  WHERE b.run_id=p.run_id AND (b.place_a=p.name OR b.place_b=p.name)) AS violating FROM positions p""")
def flagged_places(t: Tables):
    broken = compass.direction_violations(t.directions(), t.positions())
    return compass.flag_violating(t.positions(), broken).select(KEY, "name", "violating")


@query("""SELECT run_id, place_a, place_b, CASE direction WHEN 'SW' THEN '?' ELSE direction END AS direction
FROM directions WHERE direction='SW'""")
def unknown_directions(t: Tables):
    """Tokens outside the compass are reported, here every SW turned into a question mark."""
    token = F.when(F.col("direction") == "SW", "?").otherwise(F.col("direction"))
    return compass.unknown_directions(t.directions().withColumn("direction", token))
