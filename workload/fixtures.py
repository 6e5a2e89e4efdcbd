"""Place tables derived from the driver's Parquet files, as DataFrames and as SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemap.constants import KEY
from placemap.operators.joins import sized_join

ALIGN, SECOND = "S0", "P2"
RUNS = (0, 1)


class Tables:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _keys(self) -> DataFrame:
        """Both kinds of places with the number their coordinates are derived from."""
        supplier = self.read("supplier").select(F.lit("S").alias("kind"), F.col("s_suppkey").alias("k"), F.lit(0).alias("o"))
        part = self.read("part").select(F.lit("P").alias("kind"), F.col("p_partkey").alias("k"), F.lit(1).alias("o"))
        return supplier.unionByName(part).withColumn("name", F.concat("kind", F.col("k").cast("string")))

    def places(self) -> DataFrame:
        """The one map's places, without run."""
        return self._keys().select("name")

    def one_map(self) -> DataFrame:
        x, y = _place(F.col("k"), F.col("o"))
        return self._keys().select("name", x.alias("x"), y.alias("y"))

    def positions(self) -> DataFrame:
        """Two layouts; the second is stretched in x by 3 % and in y by 1 %."""
        run = F.explode(F.array(*[F.lit(r).cast("bigint") for r in RUNS])).alias(KEY)
        return self.one_map().select(run, "name", "x", "y").select(
            KEY, "name",
            (F.col("x") * (1 + F.col(KEY) * 0.03)).alias("x"), (F.col("y") * (1 + F.col(KEY) * 0.01)).alias("y"),
        )

    def one_map_distances(self) -> DataFrame:
        """Matched by the numbers of both places; names and coordinates are made from them, once they need not travel."""
        s, p = F.col("l_suppkey"), F.col("l_partkey")
        turn = ((F.col("l_orderkey") + F.col("l_linenumber")) % 13).cast("byte").alias("turn")
        lines = self.read("lineitem").select(s, p, turn)
        lines = sized_join(lines, self.read("supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey")
        ends = sized_join(lines, self.read("part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
        (ax, ay), (bx, by) = _place(s, F.lit(0)), _place(p, F.lit(1))
        dx, dy = ax - bx, ay - by
        li = F.sqrt(dx * dx + dy * dy) * 10
        off = 1 + (F.col("turn") - 6) / F.lit(100.0)
        return ends.select(
            F.concat(F.lit("S"), s.cast("string")).alias("place_a"), F.concat(F.lit("P"), p.cast("string")).alias("place_b"),
            F.floor(li * off + 1).cast("bigint").alias("li_eval"), F.floor(li + 1).cast("bigint").alias("li_spring"),
        )

    def distances(self) -> DataFrame:
        return _for_runs(self.one_map_distances())

    def one_map_directions(self) -> DataFrame:
        tokens = F.array(*[F.lit(t) for t in TOKENS])
        return self.read("lineitem").select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("place_a"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("place_b"),
            F.element_at(tokens, (F.col("l_orderkey") % 8 + 1).cast("int")).alias("direction"),
        )

    def directions(self) -> DataFrame:
        return _for_runs(self.one_map_directions())

    def ground_truth(self) -> DataFrame:
        s, p = F.col("s_suppkey"), F.col("p_partkey")

        def named(kind: str, key):
            return F.concat(F.lit(kind), key.cast("string"))

        def lonlat(key, a: int, b: int):
            return [
                (F.lit(73.3) + key * a % 1900 / F.lit(100.0)).alias("lon"),
                (F.lit(37.2) + key * b % 700 / F.lit(100.0)).alias("lat"),
            ]

        empty = F.lit("")
        suppliers = self.read("supplier").filter(s % 10 != 7).select(
            F.when(s % 8 == 5, -1 - s).otherwise(s * 40).alias("row_no"),
            F.array(
                F.when(s % 3 == 0, named("S", s)).otherwise(named("x", s)),
                F.when(s % 4 == 1, empty).otherwise(named("S", s)),
                F.when(s % 5 == 0, named("P", s)).otherwise(empty),
            ).alias("aliases"),
            *lonlat(s, 37, 53),
        )
        parts = self.read("part").filter(p % 10 != 3).select(
            (p * 2 + 1).alias("row_no"), F.array(empty, named("P", p), empty).alias("aliases"), *lonlat(p, 41, 59)
        )
        return suppliers.unionByName(parts)

    def samples(self) -> DataFrame:
        """Every pair of numbers of a vector as a point, in a run of its own; five places."""
        pair = F.posexplode(F.expr("transform(sequence(0, 31), i -> struct(embedding[2 * i] AS a, embedding[2 * i + 1] AS b))"))
        return self.read("embeddings").select("vec_id", "label", pair.alias("i", "p")).select(
            (F.col("vec_id") * 32 + F.col("i")).alias(KEY), F.concat(F.lit("N"), (F.col("label") % 5).cast("string")).alias("name"),
            (600 + 300 * F.col("p.a").cast("double")).alias("x"), (375 + 300 * F.col("p.b").cast("double")).alias("y"),
        )

    def sample_arrays(self) -> DataFrame:
        """Every embedding read as 32 points."""
        point = F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda i: F.struct(
                (600 + 300 * F.col("embedding")[2 * i].cast("double")).alias("x"),
                (375 + 300 * F.col("embedding")[2 * i + 1].cast("double")).alias("y"),
            ),
        )
        return self.read("embeddings").select(F.col("vec_id").alias(KEY), point.alias("points"))

    def history(self) -> DataFrame:
        return self.spark.sql(
            "SELECT user_id AS run_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration, "
            "value AS stress FROM {events}",
            events=self.read("events"),
        )

    def classes(self) -> DataFrame:
        return self._keys().select("name", (F.col("k") % 5).cast("int").alias("group_id"))


TOKENS = ("E", "W", "N", "S", "SE", "NW", "NE", "SW")


def _place(k, o) -> tuple:
    """Coordinates of the place with number ``k``."""
    return 120 + ((k * 7919 + o * 4801) % 9600) / F.lit(10.0), 75 + ((k * 104729 + o * 3001) % 6000) / F.lit(10.0)


def _for_runs(table: DataFrame) -> DataFrame:
    return table.select(F.explode(F.array(*[F.lit(r).cast("bigint") for r in RUNS])).alias(KEY), "*")


# The same tables as common table expressions, in dependency order.
CTES = {
    "one_map": """
  SELECT 'S'||s_suppkey AS name, 120+(s_suppkey*7919%9600)/1e1 AS x, 75+(s_suppkey*104729%6000)/1e1 AS y FROM supplier
  UNION ALL
  SELECT 'P'||p_partkey, 120+((p_partkey*7919+4801)%9600)/1e1, 75+((p_partkey*104729+3001)%6000)/1e1 FROM part""",
    "runs": "SELECT CAST(r AS BIGINT) AS run_id FROM (VALUES (0), (1)) t(r)",
    "positions": """
  SELECT run_id, name, x*(1+run_id*3e-2) AS x, y*(1+run_id*1e-2) AS y FROM one_map CROSS JOIN runs""",
    "one_map_distances": """
  SELECT e.place_a, e.place_b,
    CAST(floor(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))*10*(1+(e.k%13-6)/1e2)+1) AS BIGINT) AS li_eval,
    CAST(floor(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))*10+1) AS BIGINT) AS li_spring
  FROM (SELECT 'S'||l_suppkey AS place_a, 'P'||l_partkey AS place_b, l_orderkey+l_linenumber AS k FROM lineitem) e
  JOIN one_map a ON a.name=e.place_a JOIN one_map b ON b.name=e.place_b""",
    "distances": "SELECT run_id, d.* FROM one_map_distances d CROSS JOIN runs",
    "one_map_directions": """
  SELECT 'S'||l_suppkey AS place_a, 'P'||l_partkey AS place_b,
    CASE l_orderkey%8 WHEN 0 THEN 'E' WHEN 1 THEN 'W' WHEN 2 THEN 'N' WHEN 3 THEN 'S'
         WHEN 4 THEN 'SE' WHEN 5 THEN 'NW' WHEN 6 THEN 'NE' ELSE 'SW' END AS direction
  FROM lineitem""",
    "directions": "SELECT run_id, d.* FROM one_map_directions d CROSS JOIN runs",
    "ground_truth": """
  SELECT CASE WHEN s_suppkey%8=5 THEN -1-s_suppkey ELSE s_suppkey*40 END AS row_no,
    CASE WHEN s_suppkey%3=0 THEN 'S'||s_suppkey ELSE 'x'||s_suppkey END AS alias1,
    CASE WHEN s_suppkey%4=1 THEN '' ELSE 'S'||s_suppkey END AS alias2,
    CASE WHEN s_suppkey%5=0 THEN 'P'||s_suppkey ELSE '' END AS alias3,
    73.3e0+(s_suppkey*37%1900)/1e2 AS lon, 37.2e0+(s_suppkey*53%700)/1e2 AS lat
  FROM supplier WHERE s_suppkey%10<>7
  UNION ALL
  SELECT p_partkey*2+1, '', 'P'||p_partkey, '', 73.3e0+(p_partkey*41%1900)/1e2, 37.2e0+(p_partkey*59%700)/1e2
  FROM part WHERE p_partkey%10<>3""",
    "samples": """
  SELECT vec_id*32+i AS run_id, 'N'||(label%5) AS name,
    600+300*CAST(embedding[2*i+1] AS DOUBLE) AS x, 375+300*CAST(embedding[2*i+2] AS DOUBLE) AS y
  FROM embeddings CROSS JOIN range(32) q(i)""",
    "history": """
  SELECT user_id AS run_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration, value AS stress
  FROM events""",
    "classes": """
  SELECT name, CAST(row_id%5 AS INT) AS group_id
  FROM (SELECT 'S'||s_suppkey AS name, s_suppkey AS row_id FROM supplier
        UNION ALL SELECT 'P'||p_partkey, p_partkey FROM part) t""",
    # resolved truth: first known alias of a row, last row of a place
    "hits": """
  SELECT p.run_id, p.name, g.row_no, g.lon, g.lat,
    ROW_NUMBER() OVER (PARTITION BY p.run_id, g.row_no ORDER BY g.pos) AS nth
  FROM (SELECT row_no, lon, lat, 1 AS pos, alias1 AS name FROM ground_truth
        UNION ALL SELECT row_no, lon, lat, 2, alias2 FROM ground_truth
        UNION ALL SELECT row_no, lon, lat, 3, alias3 FROM ground_truth) g
  JOIN positions p ON p.name=g.name""",
    "truth": """
  SELECT p.run_id, p.name, b.lon, b.lat FROM positions p LEFT JOIN (
    SELECT run_id, name, lon, lat FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, name ORDER BY row_no DESC) AS last FROM hits WHERE nth=1) h
    WHERE last=1) b ON b.run_id=p.run_id AND b.name=p.name""",
}


def with_tables(sql: str) -> str:
    """Prefix ``sql`` with the tables it names, directly or through others."""
    import re

    needed: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in CTES:
            if name in words and name not in needed:
                needed.add(name)
                todo.append(CTES[name])
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        body = ",\n" + body[5:]
        return "WITH " + ",\n".join(parts) + body
    return "WITH " + ",\n".join(parts) + "\n" + body
