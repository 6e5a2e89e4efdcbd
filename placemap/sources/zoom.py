"""Maps stored along a space-filling curve, so that a detail is read without the rest of the map.

Places are sorted by the curve's key of their coordinates, edges by that of their first end with both ends' coordinates beside
them. A box becomes a few ranges of keys, and Parquet leaves out all row groups that hold none of them.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemap.functions.curve import key_ranges, z_key
from placemap.operators.geometry import Box, in_box
from placemap.operators.joins import with_endpoints

KEY_COLUMN = "z_key"
GROUP_BYTES = 1 << 20


def _write(table: DataFrame, x: str, y: str, places: DataFrame, path: str, group_bytes: int, mode: str) -> None:
    """Rows in key order below ``rows``, and the square the keys refer to below ``extent``: that of ``places``, all ends of edges among them."""
    finite = places.filter((F.abs("x") < F.lit(float("inf"))) & (F.abs("y") < F.lit(float("inf"))))
    least = finite.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    x0, y0 = least["x0"] or 0.0, least["y0"] or 0.0
    side = max((least["x1"] or 0.0) - x0, (least["y1"] or 0.0) - y0, 1e-9) * (1 + 1e-9)
    extent = [(float(x0), float(y0), float(side))]
    table.sparkSession.createDataFrame(extent, "x0 double, y0 double, side double").coalesce(1).write.mode(mode).parquet(f"{path}/extent")
    keyed = table.withColumn(KEY_COLUMN, z_key(F.col(x), F.col(y), (x0, y0), side))
    # a second key deals out places that share a cell
    ordered = keyed.repartitionByRange(F.col(KEY_COLUMN), F.xxhash64(*table.columns)).sortWithinPartitions(KEY_COLUMN)
    ordered.write.mode(mode).option("parquet.block.size", group_bytes).parquet(f"{path}/rows")


def _read(spark: SparkSession, path: str, box: Box) -> DataFrame:
    low = spark.read.parquet(f"{path}/extent").first()
    rows = spark.read.parquet(f"{path}/rows")
    ranges = key_ranges(box, (low["x0"], low["y0"]), low["side"])

    def between(first: int, last: int) -> Column:
        return (F.col(KEY_COLUMN) >= first) & (F.col(KEY_COLUMN) <= last)

    return rows.filter(reduce(Column.__or__, [between(*r) for r in ranges]) if ranges else F.lit(False)).drop(KEY_COLUMN)


def write_places(positions: DataFrame, path: str, group_bytes: int = GROUP_BYTES, mode: str = "errorifexists") -> None:
    """All columns of a layout with ``x, y``. Row groups of about ``group_bytes`` are what can be left out."""
    _write(positions, "x", "y", positions, path, group_bytes, mode)


def read_places(spark: SparkSession, path: str, box: Box) -> DataFrame:
    """The places inside the box, edges included."""
    return in_box(_read(spark, path, box), box)


def write_edges(distances: DataFrame, positions: DataFrame, path: str, group_bytes: int = GROUP_BYTES, mode: str = "errorifexists", salts: int = 1) -> None:
    """Recorded distances with ``x1, y1, x2, y2`` of both ends; edges naming an unknown place are not kept."""
    _write(with_endpoints(distances, positions, salts), "x1", "y1", positions, path, group_bytes, mode)


def read_edges(spark: SparkSession, path: str, box: Box) -> DataFrame:
    """The edges with both ends inside the box, with their coordinates: no table of places is needed."""
    x_min, y_min, x_max, y_max = (float(v) for v in box)
    ends = [F.col(c).between(*limits) for c, limits in zip(("x1", "y1", "x2", "y2"), [(x_min, x_max), (y_min, y_max)] * 2)]
    return _read(spark, path, box).filter(reduce(Column.__and__, ends))
