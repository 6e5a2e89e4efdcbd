"""Statistics of ensembles that grow: a folder of mergeable states, one batch of runs at a time."""

from pyspark.sql import DataFrame, SparkSession

from placemap.operators.ensemble import STATE, merge_states, moment_states, moments_of


def add_batch(samples: DataFrame, folder: str, batch: str) -> None:
    """Write the states of a batch of samples. Only these samples are read; adding a batch again replaces it."""
    if not batch or "/" in batch or "=" in batch:
        raise ValueError(f"not a name of a batch: {batch!r}")
    moment_states(samples).write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def read_states(spark: SparkSession, folder: str) -> DataFrame:
    """All batches' states; their number follows places and batches, not samples."""
    return spark.read.schema(f"name string, {STATE}, batch string").parquet(folder)


def grown_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Means and covariances per place over all batches, as from one pass over all their samples."""
    return moments_of(merge_states(read_states(spark, folder)))
