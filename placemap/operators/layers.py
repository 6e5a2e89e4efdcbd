"""Map layers as one table: nodes, samples, known places and edges."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemap.constants import KEY
from placemap.functions.display import error_colour, error_label, palette
from placemap.operators.truth import with_truth


def run_key(table: DataFrame) -> list[str]:
    return [KEY] if KEY in table.columns else []


def _markers(points: DataFrame, layer: str, radius: int, opacity: float, tooltip: Column) -> DataFrame:
    return points.select(
        *run_key(points), F.lit(layer).alias("layer"), "name", "lon", "lat",
        palette(F.col("cluster")).alias("colour"), F.lit(float(radius)).alias("radius"),
        F.lit(opacity).alias("opacity"), tooltip.alias("tooltip"),
    )


def map_layers(nodes: DataFrame, samples: DataFrame, truth: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per drawable. The first three tables are ``name, lon, lat, cluster``; unknown places are left out.

    Tables that carry a run give rows that carry it.
    """
    silent = F.lit(None).cast("string")
    lines = edges.select(
        *run_key(edges), F.lit("edge").alias("layer"), F.col("start_name").alias("name"),
        F.col("start_lon").alias("lon"), F.col("start_lat").alias("lat"),
        "end_name", "end_lon", "end_lat",
        error_colour(F.col("err_val")).alias("colour"), F.lit(4.5).alias("weight"),
        error_label(F.col("err_val"), digits=1).alias("tooltip"),
    )
    parts = [
        _markers(nodes, "node", 5, 0.9, F.col("name")),
        _markers(samples, "sample", 2, 0.5, silent),
        _markers(with_truth(truth), "truth", 5, 0.9, F.col("name")),
        lines,
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
