"""How well a layout keeps the recorded distances."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placemap.constants import ERROR_CAP, KEY, REFERENCE_POINT
from placemap.functions.display import error_colour, error_label
from placemap.functions.plane import dist, li_to_km, li_to_px, midpoint, px_length_to_km
from placemap.operators.geometry import Box, in_box, zoom, zoom_factor
from placemap.operators.joins import beside_runs, sized_join, with_endpoints
from placemap.operators.truth import compare_truth, rmse
from placemap.sources.storage import stored


def _length_px() -> Column:
    return dist(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))


def _relative_error(ideal_px: Column) -> Column:
    """In pixels for every caller: in kilometres an edge on the threshold may round to its other side."""
    return F.try_divide(F.abs(_length_px() - ideal_px), ideal_px)


def _with_km(ended: DataFrame) -> DataFrame:
    return ended.withColumns({"actual_km": px_length_to_km(_length_px()), "ideal_km": li_to_km(F.col("li_eval"))})


def _square_gap() -> Column:
    gap = F.col("actual_km") - F.col("ideal_km")
    return gap * gap


def _raw() -> Column:
    return F.sum(_square_gap()).alias("raw_stress")


def _kruskal() -> Column:
    actual = F.sum(F.col("actual_km") * F.col("actual_km"))
    return F.sqrt(F.try_divide(F.sum(_square_gap()), actual)).alias("kruskal_stress")


def raw_stress(distances: DataFrame, positions: DataFrame, salts: int = 1) -> DataFrame:
    """Sum of squared distance gaps per run, in square kilometres."""
    return raw_stress_of_ends(with_endpoints(distances, positions, salts))


def kruskal_stress(distances: DataFrame, positions: DataFrame, salts: int = 1) -> DataFrame:
    """Kruskal's stress-1 per run, normalised by the layout's own distances."""
    return kruskal_stress_of_ends(with_endpoints(distances, positions, salts))


def layout_scores(distances: DataFrame, positions: DataFrame, salts: int = 1) -> DataFrame:
    """Both stresses and the share of badly kept edges from one endpoint join."""
    return layout_scores_of_ends(with_endpoints(distances, positions, salts))


# The same for edges that bring the coordinates of both ends (with_endpoints, or edges stored with them): several metrics
# of one layout then share one join, and none of them exchanges the edges again.


def raw_stress_of_ends(ended: DataFrame) -> DataFrame:
    return _with_km(ended).groupBy(KEY).agg(_raw())


def kruskal_stress_of_ends(ended: DataFrame) -> DataFrame:
    return _with_km(ended).groupBy(KEY).agg(_kruskal())


def layout_scores_of_ends(ended: DataFrame) -> DataFrame:
    bad = F.count_if(_relative_error(li_to_px(F.col("li_eval"))) > ERROR_CAP).alias("n_bad_edges")
    return _with_km(ended).groupBy(KEY).agg(_raw(), _kruskal(), F.count(F.lit(1)).alias("n_edges"), bad)


def scores_of(errors: DataFrame) -> DataFrame:
    """Both stresses per run from edge errors that are already there."""
    actual = F.col("ideal_km") + F.col("delta_km")
    square = F.sum(F.col("delta_km") * F.col("delta_km"))
    return errors.groupBy(KEY).agg(
        square.alias("raw_stress"), F.sqrt(F.try_divide(square, F.sum(actual * actual))).alias("kruskal_stress")
    )


def edges_in_box(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Edges with both ends among the places of ``inside``."""
    names = inside.select(KEY, "name")
    starts, ends = names.toDF(KEY, "place_a"), names.toDF(KEY, "place_b")
    return sized_join(sized_join(edges, starts, [KEY, "place_a"], "left_semi"), ends, [KEY, "place_b"], "left_semi")


def edge_error(distances: DataFrame, positions: DataFrame, box: Box | None = None, salts: int = 1) -> DataFrame:
    """Relative error of every edge; with ``box`` only edges inside it, on zoomed coordinates.

    ``delta_km`` keeps the sign: positive where the layout is longer than the record.
    """
    factor = 1.0
    if box is not None:
        factor = zoom_factor(box)
        positions = zoom(in_box(positions, box), box)
    return _errors(with_endpoints(distances, positions, salts), factor)


def edge_error_of_ends(ended: DataFrame, box: Box | None = None) -> DataFrame:
    """:func:`edge_error` for edges that bring the coordinates of both ends, without any join."""
    if box is None:
        return _errors(ended, 1.0)
    for x, y in (("x1", "y1"), ("x2", "y2")):
        names = {x: "x", y: "y"}
        ended = zoom(in_box(ended.withColumnsRenamed(names), box), box).withColumnsRenamed({v: k for k, v in names.items()})
    return _errors(ended, zoom_factor(box))


def _errors(ended: DataFrame, factor: float) -> DataFrame:
    ideal = li_to_px(F.col("li_eval")) * F.lit(factor)
    actual = _length_px()
    return ended.withColumns({
        "error": _relative_error(ideal),
        "ideal_km": li_to_km(F.col("li_eval")),
        "delta_km": px_length_to_km((actual - ideal) / F.lit(factor)),
    })


def above_threshold(errors: DataFrame, threshold: float = ERROR_CAP) -> DataFrame:
    return errors.filter(F.col("error") > threshold)


def _report_order() -> list:
    return [F.desc("error"), "place_a", "place_b", "li_eval", "li_spring"]


def error_report(errors: DataFrame, threshold: float = ERROR_CAP) -> DataFrame:
    """Edges above the threshold, worst first within each run."""
    return above_threshold(errors, threshold).orderBy(KEY, *_report_order())


SLICES = 64
#: Steps of the quantiles that bound the k-th error of a run, and how many rows a sketch may be off by (one in so many).
STEPS, ACCURACY = 2_000, 10_000


def top_errors(errors: DataFrame, k: int = 5, window_rows: int = 1_000_000) -> DataFrame:
    """The ``k`` worst edges of every run with their ``rank``.

    While a run's last ranking keeps within ``window_rows``, edges are ranked inside 64 slices of the run first and then among
    the slices' best. For a larger ``k`` the errors are written once, a quantile sketch per run bounds the k-th error from
    below, and what reaches it is ranked in ranges of (run, error), so no task sees a whole run.
    """
    if SLICES * k <= window_rows:
        slices = Window.partitionBy(KEY, F.pmod(F.xxhash64("place_a", "place_b"), F.lit(SLICES))).orderBy(*_report_order())
        best = errors.withColumn("rank", F.row_number().over(slices)).filter(F.col("rank") <= k)
        whole = Window.partitionBy(KEY).orderBy(*_report_order())
        return best.withColumn("rank", F.row_number().over(whole).cast("bigint")).filter(F.col("rank") <= k)
    kept = stored(errors, "edge-errors")
    reached = beside_runs(kept, _least_errors(kept, k)).filter(F.col("_least").isNull() | (F.col("error") >= F.col("_least"))).drop("_least")
    return ranked_in_ranges(reached, _report_order()).filter(F.col("rank") <= k)


def _least_errors(errors: DataFrame, k: int) -> DataFrame:
    """Per run an error that at least ``k`` edges reach and not many more; null where all edges are needed."""
    at = [i / STEPS for i in range(STEPS + 1)]
    sketch = errors.groupBy(KEY).agg(F.count("error").alias("_n"), F.percentile_approx("error", at, ACCURACY).alias("_q"))
    # quantile i leaves n * (1 - i / STEPS) edges, give or take the sketch's error
    spare = 1 - F.lit(float(k)) / F.col("_n") - F.lit(2.0 / ACCURACY)
    step = F.floor(spare * STEPS).cast("int")
    return sketch.select(KEY, F.when((F.col("_n") > 0) & (step > 0), F.get("_q", step)).alias("_least"))


def ranked_in_ranges(rows: DataFrame, order: list) -> DataFrame:
    """``rank`` of every row within its run, from ranges of (run, order) that are numbered side by side."""
    placed = stored(rows.repartitionByRange(KEY, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(KEY, "_range").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(KEY).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(KEY, "_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(KEY, "_range").orderBy(*order)
    ranked = placed.join(offsets, [KEY, "_range"]).withColumn("rank", F.row_number().over(inside) + F.col("_before"))
    return ranked.select(*rows.columns, F.col("rank").cast("bigint").alias("rank"))


def edge_labels(errors: DataFrame) -> DataFrame:
    """Colour, text and middle point of every edge."""
    return errors.withColumns({
        "colour": error_colour(F.col("error")),
        "label": error_label(F.col("error"), F.col("ideal_km")),
        "mid_x": midpoint(F.col("x1"), F.col("x2")),
        "mid_y": midpoint(F.col("y1"), F.col("y2")),
    })


def edge_error_layer(errors: DataFrame, lonlat: DataFrame, salts: int = 1) -> DataFrame:
    """Edge errors with the longitude and latitude of both ends."""
    return _layer(with_endpoints(errors.select(KEY, "place_a", "place_b", "error"), lonlat, salts, ("lon", "lat")))


def edge_error_layer_of_places(distances: DataFrame, places: DataFrame, salts: int = 1) -> DataFrame:
    """The same for places that bring both ``x, y`` and ``lon, lat``: the ends are looked up once, not once for each pair."""
    return _layer(_errors(with_endpoints(distances, places, salts, ("x", "y", "lon", "lat")), 1.0))


def _layer(ended: DataFrame) -> DataFrame:
    return ended.select(
        KEY,
        F.col("place_a").alias("start_name"), F.col("lon1").alias("start_lon"), F.col("lat1").alias("start_lat"),
        F.col("place_b").alias("end_name"), F.col("lon2").alias("end_lon"), F.col("lat2").alias("end_lat"),
        F.col("error").alias("err_val"),
    )


def model_comparison(distances: DataFrame, positions: DataFrame, truth: DataFrame, anchor: str, ref=REFERENCE_POINT):
    """RMSE and Kruskal stress of every model (run) side by side."""
    accuracy = rmse(compare_truth(positions, truth, anchor, ref)).select(KEY, "rmse_km")
    parts = accuracy.unionByName(kruskal_stress(distances, positions), allowMissingColumns=True)
    return parts.groupBy(KEY).agg(F.max("rmse_km").alias("rmse_km"), F.max("kruskal_stress").alias("kruskal_stress"))
