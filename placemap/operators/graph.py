"""The place graph: vertices, indices, adjacency, unknown names."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placemap.constants import KEY
from placemap.functions.chance import hash_uniform
from placemap.operators.joins import sized_join
from placemap.sources.storage import stored


def _keys(edges: DataFrame) -> list[str]:
    return [KEY] if KEY in edges.columns else []


def vertices(edges: DataFrame) -> DataFrame:
    """Distinct place names of both endpoint columns."""
    names = F.explode(F.array("place_a", "place_b")).alias("name")
    return edges.select(*_keys(edges), names).distinct()


def edges(distances: DataFrame) -> DataFrame:
    """The two endpoint columns, duplicates kept."""
    return distances.select(*_keys(distances), "place_a", "place_b")


def symmetric_edges(distances: DataFrame) -> DataFrame:
    """Every row once in each direction, in one scan."""
    forward = F.struct("place_a", "place_b")
    backward = F.struct(F.col("place_b").alias("place_a"), F.col("place_a").alias("place_b"))
    rest = [c for c in distances.columns if c not in ("place_a", "place_b")]
    both = distances.withColumn("_ends", F.explode(F.array(forward, backward)))
    return both.select(F.col("_ends.place_a"), F.col("_ends.place_b"), *rest)


def degrees(distances: DataFrame) -> DataFrame:
    """Number of adjacency entries of every place."""
    names = F.explode(F.array("place_a", "place_b")).alias("name")
    return distances.select(KEY, names).groupBy(KEY, "name").agg(F.count(F.lit(1)).alias("degree"))


#: Places are counted in so many hashed groups; a group with more than HUB_ROWS entries has a place that one task should not hold.
SPOTS, HUB_ROWS, TASK_ROWS = 65_536, 2_000_000, 250_000


def adjacency(distances: DataFrame, page_rows: int = 10_000, hub_rows: int = HUB_ROWS) -> DataFrame:
    """Neighbours as sorted arrays, one row per run, name and page.

    Equal entries are counted in ``copies`` before they are collected. A place with more than ``page_rows`` different
    entries has them dealt by hash over ``pages`` rows of about that many, so no array grows with the degree;
    others have page 0 of one.

    The entries are exchanged once, by place, into tasks of about TASK_ROWS; copies, pages and arrays are made where they then
    lie. Places of crowded groups, found by a count of its own, are put together entry by entry and page by page instead.
    """
    entries = symmetric_edges(distances).select(
        KEY, F.col("place_a").alias("name"), F.col("place_b").alias("neighbor"), "li_eval", "li_spring"
    )
    spot = F.pmod(F.xxhash64(KEY, "name"), F.lit(SPOTS))
    counts = entries.groupBy(spot.alias("spot")).agg(F.count(F.lit(1)).alias("n")).collect()
    crowded = [row["spot"] for row in counts if row["n"] > hub_rows]
    tasks = -(-sum(row["n"] for row in counts) // TASK_ROWS)
    own_pages = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(KEY, "name")) / page_rows).cast("int")
    lists = _lists(_counted(entries.filter(~spot.isin(crowded)).repartition(max(tasks, 1), KEY, "name")).withColumn("pages", own_pages))
    if not crowded:
        return lists
    hubs = _counted(entries.filter(spot.isin(crowded)))
    sizes = hubs.groupBy(KEY, "name").agg(F.ceil(F.count(F.lit(1)) / page_rows).cast("int").alias("pages"))
    # few, as each crowded group holds many entries; how they are joined is left to their number
    return lists.unionByName(_lists(hubs.join(sizes, [KEY, "name"])))


def _counted(entries: DataFrame) -> DataFrame:
    return entries.groupBy(KEY, "name", "neighbor", "li_eval", "li_spring").agg(F.count(F.lit(1)).alias("copies"))


def _lists(paged: DataFrame) -> DataFrame:
    """One sorted array per page from entries that know the number of pages of their place."""
    page = F.floor(hash_uniform("page", F.col("neighbor"), F.col("li_eval"), F.col("li_spring")) * F.col("pages")).cast("int")
    return paged.groupBy(KEY, "name", "pages", page.alias("page")).agg(
        F.sum("copies").alias("entries"),
        F.array_sort(F.collect_list(F.struct("neighbor", "li_eval", "li_spring", "copies"))).alias("neighbors"),
    )


def dense_ids(places: DataFrame, partitions: int | None = None) -> DataFrame:
    """Index 0..N-1 in name order within each run, without sorting a large run in one task.

    The places are dealt into ``partitions`` ranges of (run, name), written with their range's number, numbered inside
    each and shifted by the counts of the run's ranges before.
    """
    by = [F.col(KEY), F.col("name")]
    ranges = places.repartitionByRange(*by) if partitions is None else places.repartitionByRange(partitions, *by)
    placed = stored(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(KEY, "_range").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(KEY).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(KEY, "_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(KEY, "_range").orderBy("name")
    return (
        placed.join(offsets, [KEY, "_range"])
        .withColumn("id", F.row_number().over(inside) - 1 + F.col("_offset"))
        .select(*places.columns, F.col("id").cast("bigint").alias("id"))
    )


def missing_names(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Names used by edges (or anchors) that are no known place."""
    used = vertices(edges) if "place_a" in edges.columns else edges.select(*_keys(edges), "name").distinct()
    on = [KEY, "name"] if KEY in used.columns else ["name"]
    return sized_join(used, places.select(*on), on, "left_anti")
