"""Compass constraints between places."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemap.constants import KEY
from placemap.functions.compass import direction_vector
from placemap.functions.plane import dist, dot
from placemap.operators.joins import sized_join, with_endpoints

CARDINAL_LIMIT = 0.0
DIAGONAL_LIMIT = 1 / math.sqrt(2)


def unknown_directions(directions: DataFrame) -> DataFrame:
    """Rows whose token is not a compass direction; they take no part in the results."""
    return directions.filter(direction_vector(F.col("direction")).isNull())


def direction_cosine(directions: DataFrame, positions: DataFrame, salts: int = 1) -> DataFrame:
    """Unit vector A -> B and its cosine with the stated direction; null for coinciding places."""
    length = dist(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    joined = with_endpoints(directions, positions, salts).withColumn("_v", direction_vector(F.col("direction")))
    units = joined.filter(F.col("_v").isNotNull()).withColumns({
        "ux": F.try_divide(F.col("x2") - F.col("x1"), length),
        "uy": F.try_divide(F.col("y2") - F.col("y1"), length),
        "dir_x": F.col("_v.dx"), "dir_y": F.col("_v.dy"), "cardinal": F.col("_v.cardinal"),
    })
    along = dot(F.col("ux"), F.col("uy"), F.col("dir_x"), F.col("dir_y"))
    cosine = F.when(F.col("cardinal"), along).otherwise(along / F.lit(math.sqrt(2)))
    return units.withColumn("cosine", cosine).drop("_v")


def direction_violations(
    directions: DataFrame, positions: DataFrame,
    cardinal_limit: float = CARDINAL_LIMIT, diagonal_limit: float = DIAGONAL_LIMIT, salts: int = 1,
) -> DataFrame:
    """Constraints the layout breaks: more than 90 degrees off (four winds) or 45 (in between)."""
    limit = F.when(F.col("cardinal"), F.lit(cardinal_limit)).otherwise(F.lit(diagonal_limit))
    return direction_cosine(directions, positions, salts).filter(F.col("cosine") < limit)


def violation_count(directions: DataFrame, positions: DataFrame) -> DataFrame:
    """Broken and checked constraints per run; runs without any broken one show zero."""
    limit = F.when(F.col("cardinal"), F.lit(CARDINAL_LIMIT)).otherwise(F.lit(DIAGONAL_LIMIT))
    return direction_cosine(directions, positions).groupBy(KEY).agg(
        F.count_if(F.col("cosine") < limit).alias("n_violations"), F.count(F.lit(1)).alias("n_checked")
    )


def flag_violating(places: DataFrame, violations: DataFrame) -> DataFrame:
    """Places with a flag telling whether any violation names them on either side."""
    names = F.explode(F.array("place_a", "place_b")).alias("name")
    named = violations.select(KEY, names).distinct().withColumn("_hit", F.lit(True))
    return (
        sized_join(places, named, [KEY, "name"], "left")
        .withColumn("violating", F.col("_hit").isNotNull())
        .drop("_hit")
    )
