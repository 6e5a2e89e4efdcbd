"""Forces at a snapshot of a layout."""

from placemap.constants import KEY
from placemap.operators import forces
from placemap.operators.repulsion import repulsion as repel
from workload.fixtures import Tables
from workload.graph_queries import ENDS, LENGTH
from workload.map_queries import VECTORS
from workload.registry import pick, query, r

SPRING = f"""sp AS (
  SELECT d.run_id, place_a, place_b, 15000e0*(d.li_spring/1e1-{LENGTH})*(b.x-a.x)/{LENGTH} AS fx,
    15000e0*(d.li_spring/1e1-{LENGTH})*(b.y-a.y)/{LENGTH} AS fy {ENDS}),
spring AS (SELECT run_id, name, SUM(fx) AS fx, SUM(fy) AS fy FROM (
  SELECT run_id, place_b AS name, fx, fy FROM sp UNION ALL SELECT run_id, place_a, -fx, -fy FROM sp) s GROUP BY run_id, name)"""
REPEL = """repel AS (
  SELECT a.run_id, a.name,
    SUM(5000e0*(a.x-b.x)/pow(greatest(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)),1e-1),2)) AS fx,
    SUM(5000e0*(a.y-b.y)/pow(greatest(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)),1e-1),2)) AS fy
  FROM positions a JOIN positions b ON b.run_id=a.run_id GROUP BY a.run_id, a.name)"""
TURN = f"""{VECTORS.strip()},
tn AS (SELECT run_id, place_a, place_b, CASE WHEN -uy*vx+ux*vy >= 0 THEN 10000e0 ELSE -10000e0 END AS side, ux, uy FROM broken),
turn AS (SELECT run_id, name, SUM(fx) AS fx, SUM(fy) AS fy FROM (
  SELECT run_id, place_b AS name, -side*uy AS fx, side*ux AS fy FROM tn
  UNION ALL SELECT run_id, place_a, side*uy, -side*ux FROM tn) s GROUP BY run_id, name)"""
NET = f"""{SPRING}, {REPEL}, {TURN},
net AS (SELECT run_id, name, SUM(fx) AS fx, SUM(fy) AS fy FROM (
  SELECT * FROM spring UNION ALL SELECT * FROM repel UNION ALL SELECT * FROM turn) s GROUP BY run_id, name)"""


def _out(source: str) -> str:
    return f"SELECT run_id, name, {r('fx', 4)} AS fx, {r('fy', 4)} AS fy FROM {source}"


@query(f"WITH {SPRING} {_out('spring')}")
def spring_force(t: Tables):
    return pick(forces.spring_force(t.distances(), t.positions()), KEY, "name", fx=4, fy=4)


@query(f"WITH {REPEL} {_out('repel')}")
def repulsion(t: Tables):
    return pick(repel(t.positions()), KEY, "name", fx=4, fy=4)


@query(f"WITH {TURN} {_out('turn')}")
def direction_force(t: Tables):
    return pick(forces.direction_force(t.directions(), t.positions()), KEY, "name", fx=4, fy=4)


@query(f"WITH {NET} {_out('net')}")
def net_force(t: Tables):
    positions = t.positions()
    total = forces.net_force(
        forces.spring_force(t.distances(), positions), repel(positions),
        forces.direction_force(t.directions(), positions),
    )
    return pick(total, KEY, "name", fx=4, fy=4)
