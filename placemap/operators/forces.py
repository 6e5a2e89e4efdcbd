"""Forces on places at one snapshot of a layout; every result is ``run_id, name, fx, fy``."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemap.constants import DIRECTION_FORCE, KEY, SPRING_STIFFNESS
from placemap.functions.plane import dist, dot, li_to_px, perp
from placemap.operators.directions import direction_violations
from placemap.operators.joins import with_endpoints


def _number(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def _on_both_ends(edges: DataFrame, fx: Column, fy: Column) -> DataFrame:
    """Sum per place of a force on ``place_b`` and its opposite on ``place_a``."""
    on_b = F.struct(F.col("place_b").alias("name"), fx.alias("fx"), fy.alias("fy"))
    on_a = F.struct(F.col("place_a").alias("name"), (-fx).alias("fx"), (-fy).alias("fy"))
    parts = edges.select(KEY, F.explode(F.array(on_a, on_b)).alias("_f")).select(KEY, "_f.*")
    return _sum_forces(parts)


def _sum_forces(parts: DataFrame) -> DataFrame:
    return parts.groupBy(KEY, "name").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def spring_force(
    distances: DataFrame, positions: DataFrame, stiffness: float | Column = SPRING_STIFFNESS, salts: int = 1
) -> DataFrame:
    """Pull of every recorded distance towards its rest length (the second li column)."""
    length = dist(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    push = _number(stiffness) * (li_to_px(F.col("li_spring")) - F.col("_length"))
    ux = F.coalesce(F.try_divide(F.col("x2") - F.col("x1"), F.col("_length")), F.lit(0.0))
    uy = F.coalesce(F.try_divide(F.col("y2") - F.col("y1"), F.col("_length")), F.lit(0.0))
    edges = with_endpoints(distances, positions, salts).withColumn("_length", length)
    return _on_both_ends(edges, push * ux, push * uy)


def direction_force(
    directions: DataFrame, positions: DataFrame, force: float | Column = DIRECTION_FORCE, salts: int = 1
) -> DataFrame:
    """Turn the ends of every broken constraint: a constant force square to A -> B, on the side that helps."""
    px, py = perp(F.col("ux"), F.col("uy"))
    helps = dot(px, py, F.col("dir_x"), F.col("dir_y")) >= 0
    side = F.when(helps, _number(force)).otherwise(-_number(force))
    return _on_both_ends(direction_violations(directions, positions, salts=salts), side * px, side * py)


def net_force(*forces: DataFrame) -> DataFrame:
    """Sum of several force tables per place."""
    return _sum_forces(reduce(DataFrame.unionByName, forces))
