"""Known coordinates: binding them to places and comparing layouts with them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemap.constants import KEY, REFERENCE_POINT, TRUTH_CLUSTER
from placemap.functions.display import diverging_colour
from placemap.functions.plane import dist
from placemap.operators.geometry import lcc_forward, px_to_km
from placemap.operators.joins import beside_runs, sized_join


def resolve_aliases(ground_truth: DataFrame, places: DataFrame) -> DataFrame:
    """Every place with its known ``lon, lat`` or nulls.

    A truth row binds to the first of its aliases that is a place; if several rows bind to one place the
    last row wins. The point (0, 0) means unknown.
    """
    named = ground_truth.select("row_no", F.posexplode("aliases").alias("_pos", "name"), "lon", "lat")
    hits = sized_join(named.filter(F.col("name") != ""), places.select(KEY, "name"), "name")
    bound = hits.groupBy(KEY, "row_no").agg(F.min_by(F.struct("name", "lon", "lat"), "_pos").alias("_hit"))
    known = (
        bound.groupBy(KEY, F.col("_hit.name").alias("name"))
        .agg(F.max_by("_hit", "row_no").alias("_hit"))
        .withColumn("_known", ~((F.col("_hit.lon") == 0) & (F.col("_hit.lat") == 0)))
        .select(
            KEY, "name",
            F.when(F.col("_known"), F.col("_hit.lon")).alias("lon"),
            F.when(F.col("_known"), F.col("_hit.lat")).alias("lat"),
        )
    )
    return sized_join(places.select(KEY, "name"), known, [KEY, "name"], "left")


def with_truth(points: DataFrame) -> DataFrame:
    return points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())


def truth_layer(places: DataFrame, truth: DataFrame, cluster: int = TRUTH_CLUSTER) -> DataFrame:
    """All places with their known coordinates (null when unknown) and a constant cluster."""
    known = truth.select(KEY, "name", "lon", "lat")
    return sized_join(places.select(KEY, "name"), known, [KEY, "name"], "left").withColumn("cluster", F.lit(cluster))


def compare_truth(positions: DataFrame, truth: DataFrame, anchor: str, ref=REFERENCE_POINT) -> DataFrame:
    """Distance in km between each place's layout position and its known position."""
    layout = px_to_km(positions.select(KEY, "name", "x", "y"), ref).select(KEY, "name", "x_km", "y_km")
    known = lcc_forward(with_truth(truth), anchor).select(
        KEY, "name", F.col("x_km").alias("truth_x_km"), F.col("y_km").alias("truth_y_km")
    )
    error = dist(F.col("truth_x_km"), F.col("truth_y_km"), F.col("x_km"), F.col("y_km"))
    return sized_join(layout, known, [KEY, "name"]).withColumn("error_km", error)


def rmse(errors: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Root mean square error per run; ``exclude`` leaves anchors out."""
    rows = errors.filter(~F.col("name").isin(*exclude)) if exclude else errors
    square = F.col("error_km") * F.col("error_km")
    return rows.groupBy(KEY).agg(F.sqrt(F.avg(square)).alias("rmse_km"), F.count("error_km").alias("n_places"))


def error_scale(errors: DataFrame) -> DataFrame:
    """Each place's error as a share of its run's largest, with the matching colour."""
    top = errors.groupBy(KEY).agg(F.max("error_km").alias("max_error_km"))
    share = F.when(F.col("max_error_km") > 0, F.least(F.col("error_km") / F.col("max_error_km"), F.lit(1.0)))
    return beside_runs(errors, top, "inner").withColumn("share", share).withColumn("colour", diverging_colour(F.col("share")))
