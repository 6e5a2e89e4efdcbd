"""Small helpers shared by the operators."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: White space of the word and line rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = b" \t\n\x0b\x0c\r"


def ship(spark: SparkSession) -> None:
    """Let local workers import this package; a cluster's executors get it with the job (--py-files)."""
    context = spark.sparkContext
    if context.master.startswith("local"):
        context.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def without(table: DataFrame, *names: str) -> DataFrame:
    """Drop columns an operator is about to add; names compare as Spark resolves them, ignoring case."""
    taken = {n.lower() for n in names}
    return table.select(*[table[f"`{c}`"] for c in table.columns if c.lower() not in taken])
