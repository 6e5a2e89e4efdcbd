"""Colours and label texts."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from placemap.constants import ERROR_CAP, NODE_COLOURS
from placemap.functions.plane import clamp


def error_colour(error: Column, cap: float = ERROR_CAP) -> Column:
    """White at no error, red from ``cap`` on, as ``#rrggbb``."""
    level = (F.lit(255.0) * (1 - clamp(error, 0.0, cap) / F.lit(cap))).cast("int")
    return F.when(error.isNotNull(), F.format_string("#ff%02x%02x", level, level))


def diverging_colour(share: Column) -> Column:
    """Blue at 0, red at 1, as ``#rrggbb``."""
    red = (F.lit(255.0) * share).cast("int")
    blue = (F.lit(255.0) * (1 - share)).cast("int")
    return F.when(share.isNotNull(), F.format_string("#%02x00%02x", red, blue))


def palette(index: Column, names: Sequence[str] = NODE_COLOURS) -> Column:
    """Cycle through ``names``."""
    choice = F.pmod(index, F.lit(len(names))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(n) for n in names]), choice)


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text; ties are settled on the exact binary value."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value, F.lit(pattern))


def error_label(error: Column, km: Column | None = None, digits: int = 2) -> Column:
    """``1.23% (+4.56km)`` with ``km``, otherwise only the percentage."""
    percent = F.concat(fixed(error * 100, digits), F.lit("%"))
    if km is None:
        return percent
    return F.concat(percent, F.lit(" (+"), fixed(error * km, digits), F.lit("km)"))
