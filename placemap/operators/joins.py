"""Lookups of place rows for edges."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemap.constants import KEY


def one_run(table: DataFrame, run_id: int = 0) -> DataFrame:
    """Give a table without ``run_id`` one.

    The value is a column's hash clamped to ``run_id``, so that the optimizer does not fold it: a join on a
    constant key would become a nested loop that may broadcast the large side.
    """
    value = F.lit(run_id).cast("bigint")
    return table.select(F.greatest(F.least(F.xxhash64(table.columns[0]), value), value).alias(KEY), "*")


def sized_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join of two tables that both grow with the input: both are exchanged and sorted, which spills.

    Left to itself the optimizer broadcasts a side whose size it guesses to be small. Its guess is a share of the file's
    compressed size and does not count the rows an explode makes, so tables of millions of places went through the driver and
    into the memory of every task.
    """
    return left.join(right.hint("merge"), [on] if isinstance(on, str) else list(on), how)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], salts: int = 1, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys may be spread over ``salts`` tasks.

    With one salt the plan is the ordinary join and skewed partitions are left to adaptive execution.
    With more, the (smaller) right side is repeated once per salt and each left row meets one copy. Neither is broadcast.
    """
    if salts <= 1:
        return sized_join(left, right, on, how)
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return sized_join(left.withColumn("_salt", salt), copies, [*on, "_salt"], how).drop("_salt")


def beside_runs(
    table: DataFrame, values: DataFrame, how: str = "left", on: str | list[str] = KEY, limit: int = 10_000, salts: int = 64
) -> DataFrame:
    """Put one row of ``values`` per run (or other key) beside the rows of ``table``, without exchanging ``table`` by run alone.

    The values are computed once, by a job of their own. Up to ``limit`` of them are broadcast; with more, runs are
    spread over ``salts`` tasks each. Both ways give the same rows.
    """
    found = values.limit(limit + 1).collect()
    if len(found) > limit:
        return salted_join(table, values, [on] if isinstance(on, str) else on, salts, how)
    return table.join(F.broadcast(table.sparkSession.createDataFrame(found, values.schema)), on, how)


def with_endpoints(edges: DataFrame, positions: DataFrame, salts: int = 1, columns: Sequence[str] = ("x", "y")) -> DataFrame:
    """Add ``x1, y1, x2, y2`` (or other ``columns``) of both ends; edges naming an unknown place do not survive.

    Edges without ``run_id`` belong to every run, so replicates need no copy of the edge table.
    """
    ends = positions.select(KEY, "name", *columns)
    start = ends.toDF(KEY, "place_a", *[f"{c}1" for c in columns])
    end = ends.toDF(KEY, "place_b", *[f"{c}2" for c in columns])
    first = [KEY, "place_a"] if KEY in edges.columns else ["place_a"]
    found = salted_join(edges, start, first, salts)
    return salted_join(found, end, [KEY, "place_b"], salts)


def spread(table: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition into the session's number of shuffle partitions and keep that number.

    For small tables whose rows cause much work each; adaptive execution would merge their partitions by
    size and leave most cores idle. The extra hash keeps the optimizer from taking the columns' present
    partitioning for this one.
    """
    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(partitions, F.xxhash64(*columns))
