"""Stress histories as tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemap.constants import KEY, LOG_FLOOR
from placemap.functions.plane import dist, li_to_km, px_length_to_km
from placemap.operators.joins import beside_runs, salted_join, sized_join


def step_pages(trajectory: DataFrame, page_steps: int = 64) -> DataFrame:
    """One row per run, place and page of ``page_steps`` steps: ``points``, an array by step up to its last one, null where one is missing.

    A place that has two positions in one step stops the job.
    """
    at = F.col("iteration").cast("bigint")
    rows = trajectory.select(
        KEY, "name", F.floor(at / page_steps).alias("page"), F.pmod(at, F.lit(page_steps)).cast("int").alias("_at"), F.struct("x", "y").alias("_p")
    )
    packed = rows.groupBy(KEY, "name", "page").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_p"))).alias("_m"))
    steps = F.sequence(F.lit(0), F.array_max(F.map_keys("_m")))
    return packed.select(KEY, "name", "page", F.transform(steps, lambda i: F.try_element_at("_m", i)).alias("points"))


def stress_history(distances: DataFrame, trajectory: DataFrame, salts: int = 1, page_steps: int = 64) -> DataFrame:
    """Raw stress of every recorded step; ``trajectory`` is ``run_id, iteration, name, x, y``.

    A place's positions of many steps are packed in one row, so an edge is joined once per page of steps, not once per
    step; its gaps are unpacked where they are summed. Steps in which an edge lacks an end go without that edge.
    """
    pages = step_pages(trajectory, page_steps)
    first = [KEY, "place_a"] if KEY in distances.columns else ["place_a"]
    edges = distances.select(*first, "place_b", "li_eval")
    begun = salted_join(edges, pages.select(KEY, F.col("name").alias("place_a"), "page", F.col("points").alias("_a")), first, salts)
    ended = salted_join(begun, pages.select(KEY, "page", F.col("name").alias("place_b"), F.col("points").alias("_b")), [KEY, "page", "place_b"], salts)

    step = ended.select(KEY, "page", "li_eval", F.posexplode(F.arrays_zip("_a", "_b")).alias("_at", "_p"))
    length = dist(F.col("_p._a.x"), F.col("_p._a.y"), F.col("_p._b.x"), F.col("_p._b.y"))
    gap = px_length_to_km(length) - li_to_km(F.col("li_eval"))
    step = step.select(KEY, "page", "_at", (gap * gap).alias("_square")).filter(F.col("_square").isNotNull())
    sums = step.groupBy(KEY, "page", "_at").agg(F.sum("_square").alias("stress"))
    iteration = (F.col("page") * page_steps + F.col("_at")).cast(trajectory.schema["iteration"].dataType)
    return sums.select(KEY, iteration.alias("iteration"), "stress")


def history_summary(history: DataFrame) -> DataFrame:
    return history.groupBy(KEY).agg(
        F.min("stress").alias("min_stress"),
        F.max("stress").alias("max_stress"),
        F.count(F.lit(1)).alias("n_steps"),
        F.max_by("stress", "iteration").alias("last_stress"),
    )


def log_stress(history: DataFrame) -> DataFrame:
    return history.withColumn("log_stress", F.log10(F.col("stress") + F.lit(LOG_FLOOR)))


def normalise(history: DataFrame) -> DataFrame:
    """Step and log stress of each run mapped to [0, 1]; null where the run has no extent."""
    logged = log_stress(history)
    ranges = logged.groupBy(KEY).agg(
        F.min("log_stress").alias("_low"), F.max("log_stress").alias("_high"),
        F.min("iteration").alias("_first"), F.max("iteration").alias("_last"),
    )
    return beside_runs(logged, ranges, "inner").select(
        *history.columns,
        F.try_divide(F.col("iteration") - F.col("_first"), F.col("_last") - F.col("_first")).alias("step_share"),
        F.try_divide(F.col("log_stress") - F.col("_low"), F.col("_high") - F.col("_low")).alias("stress_share"),
    )


def ticks(history: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` evenly spread axis steps of each run (counted from 0) with the stress there, null if the step is missing."""
    sizes = history.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"), F.min("iteration").alias("_first"))
    step = F.floor(F.col("tick") * (F.col("_n") - 1) / (n - 1)).cast("bigint")
    wanted = sizes.select(KEY, "_n", "_first", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tick"))
    marks = wanted.select(KEY, "tick", step.alias("step"), (step + F.col("_first")).alias("iteration"))
    return sized_join(marks, history.withColumn("iteration", F.col("iteration").cast("bigint")), [KEY, "iteration"], "left").select(
        KEY, "tick", "step", "stress"
    )
