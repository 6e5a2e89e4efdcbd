"""Parameter sweeps and per-place statistics of many runs."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemap.constants import CONFIDENCE_LEVELS, KEY, REPULSION_JITTER, SPRING_JITTER
from placemap.functions.chance import hash_normal, hash_uniform
from placemap.functions.moments import chi2_q2, eig2, major_axis_degrees
from placemap.operators.joins import sized_join


def runs(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias(KEY))


def normal_factor(name: str, jitter: float, seed: int = 0) -> Column:
    """Factor of one run, normal about 1 with half the jitter as deviation; run 0 is not changed."""
    draw = 1 + F.lit(jitter / 2) * hash_normal(seed, F.col(KEY), name)
    return F.when(F.col(KEY) == 0, 1.0).otherwise(draw)


def uniform_factor(name: str, jitter: float, seed: int = 0) -> Column:
    """Factor of one run, uniform on 1 - jitter .. 1 + jitter; run 0 is not changed."""
    draw = 1 + F.lit(jitter) * (2 * hash_uniform(seed, F.col(KEY), name) - 1)
    return F.when(F.col(KEY) == 0, 1.0).otherwise(draw)


def sweep_normal(table: DataFrame, spring_jitter=SPRING_JITTER, repulsion_jitter=REPULSION_JITTER, seed=0):
    """Spring and repulsion factors of every run."""
    return table.select(
        KEY,
        normal_factor("spring", spring_jitter, seed).alias("k_spring"),
        normal_factor("repulsion", repulsion_jitter, seed).alias("k_repulsion"),
    )


def sweep_uniform(table: DataFrame, spring_jitter=SPRING_JITTER, repulsion_jitter=REPULSION_JITTER, seed=0):
    return table.select(
        KEY,
        uniform_factor("spring", spring_jitter, seed).alias("k_spring"),
        uniform_factor("repulsion", repulsion_jitter, seed).alias("k_repulsion"),
    )


def flatten_samples(arrays: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per run and place from one ``points`` array per run; ``ids`` gives the place of each slot.

    A slot without a place stops the job.
    """
    slots = arrays.select(KEY, F.posexplode("points").alias("id", "_p"))
    names = ids.select(F.col("id").cast("int").alias("id"), "name")
    lost = F.raise_error(F.concat(F.lit("no place for slot "), F.col("id").cast("string")))
    name = F.coalesce("name", lost).alias("name")
    return sized_join(slots, names, "id", "left").select(KEY, name, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def sample_mean(samples: DataFrame) -> DataFrame:
    return samples.groupBy("name").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))


def _covariance() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.var_samp("x").alias("sxx"), F.covar_samp("x", "y").alias("sxy"), F.var_samp("y").alias("syy"),
    ]


def sample_cov(samples: DataFrame) -> DataFrame:
    """Sample covariance per place; null for a single sample."""
    return samples.groupBy("name").agg(*_covariance())


def sample_moments(samples: DataFrame) -> DataFrame:
    """Mean and covariance per place in one pass."""
    return samples.groupBy("name").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), *_covariance())


def distinct_points(samples: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of different positions per place."""
    point = F.struct("x", "y")
    count = F.approx_count_distinct(point) if approximate else F.count_distinct(point)
    return samples.groupBy("name").agg(F.count(F.lit(1)).alias("n"), count.alias("n_distinct"))


STATE = "n bigint, mx double, my double, cxx double, cxy double, cyy double"


def moment_states(samples: DataFrame, *by: str) -> DataFrame:
    """What is kept of a batch of samples per place (and per ``by``): number, means and sums of products of deviations."""
    n = F.count(F.lit(1))
    return samples.groupBy(*by, "name").agg(
        n.alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        (F.var_pop("x") * n).alias("cxx"), (F.covar_pop("x", "y") * n).alias("cxy"), (F.var_pop("y") * n).alias("cyy"),
    )


def _merged_pair(a: Column, b: Column) -> Column:
    """Both states as one: deviations from either mean are moved to the common mean."""
    n = a["n"] + b["n"]
    dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
    weight = a["n"] * b["n"] / n
    return F.when(b["n"] == 0, a).otherwise(F.struct(
        n.alias("n"), (a["mx"] + dx * b["n"] / n).alias("mx"), (a["my"] + dy * b["n"] / n).alias("my"),
        (a["cxx"] + b["cxx"] + dx * dx * weight).alias("cxx"), (a["cxy"] + b["cxy"] + dx * dy * weight).alias("cxy"),
        (a["cyy"] + b["cyy"] + dy * dy * weight).alias("cyy"),
    ))


def merge_states(states: DataFrame, fan_in: int = 256) -> DataFrame:
    """One state per place from any number of states of it.

    A place's states are merged in ``fan_in`` groups by hash and then the groups' results, so of a place with very many
    batches no row gathers more than a ``fan_in``-th of them.
    """
    fields = ("n", "mx", "my", "cxx", "cxy", "cyy")
    none = F.struct(F.lit(0).cast("bigint").alias("n"), *[F.lit(0.0).alias(f) for f in fields[1:]])
    ordered = F.array_sort(F.collect_list(F.struct(*fields)))  # so that a retried task adds up in the same order
    merged = F.aggregate(ordered, none, _merged_pair)

    def one_state(table: DataFrame, *by: Column | str) -> DataFrame:
        return table.groupBy("name", *by).agg(merged.alias("_s")).select("name", "_s.*")

    group = F.pmod(F.xxhash64(*fields), F.lit(fan_in)).alias("_group")
    return one_state(one_state(states, group))


def moments_of(states: DataFrame) -> DataFrame:
    """The table of :func:`sample_moments` from one state per place."""
    free = F.when(F.col("n") > 1, F.col("n") - 1)
    spread = [(F.col(c) / free).alias(s) for c, s in (("cxx", "sxx"), ("cxy", "sxy"), ("cyy", "syy"))]
    return states.select("name", "mx", "my", "n", *spread)


def confidence_ellipses(samples: DataFrame, levels=CONFIDENCE_LEVELS) -> DataFrame:
    """Full axes and tilt of the confidence ellipses of every place, larger axis first."""
    return ellipses_of(sample_moments(samples), levels)


def ellipses_of(moments: DataFrame, levels=CONFIDENCE_LEVELS) -> DataFrame:
    """The same from means and covariances that are already there."""
    large, small = eig2(F.col("sxx"), F.col("sxy"), F.col("syy"))
    steps = F.array(*[
        F.struct(F.lit(level).alias("level"), F.lit(chi2_q2(level)).alias("q"), F.lit(opacity).alias("opacity"))
        for level, opacity in levels
    ])
    return moments.withColumn("_l", F.explode(steps)).select(
        "name", "mx", "my", F.col("_l.level").alias("level"),
        (2 * F.sqrt(large * F.col("_l.q"))).alias("width"),
        (2 * F.sqrt(small * F.col("_l.q"))).alias("height"),
        major_axis_degrees(F.col("sxx"), F.col("sxy"), F.col("syy")).alias("angle"),
        F.col("_l.opacity").alias("opacity"),
    )


def drop_degenerate(ellipses: DataFrame) -> DataFrame:
    return ellipses.filter((F.col("width") > 0) & (F.col("height") > 0))
