"""Name -> query and name -> SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.fixtures import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its own name."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[build.__name__] = with_tables(sql)
        return build

    return register


def rounded(column: Column | str, digits: int) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, digits) + F.lit(0.0)


def pick(table: DataFrame, *plain: str, **digits: int) -> DataFrame:
    """Select ``plain`` columns as they are and the others rounded."""
    return table.select(*plain, *[rounded(c, d).alias(c) for c, d in digits.items()])


def r(expression: str, digits: int) -> str:
    """SQL twin of :func:`rounded`."""
    return f"(round({expression},{digits})+0e0)"
