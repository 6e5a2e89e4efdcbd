"""Repeatable random numbers that depend on row values only, never on partitioning."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _draw(parts: tuple) -> Column:
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *texts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")


def hash_uniform(*parts: Column | str | int) -> Column:
    """Uniform on [0, 1) from the given values."""
    return _draw(parts) / F.lit(float(2**32))


def hash_normal(*parts: Column | str | int) -> Column:
    """Standard normal by the Box-Muller transform."""
    radius = F.sqrt(F.lit(-2.0) * F.log((_draw((*parts, "r")) + 0.5) / F.lit(float(2**32))))
    return radius * F.cos(F.lit(2 * math.pi) * hash_uniform(*parts, "a"))
