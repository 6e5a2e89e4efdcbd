"""Plane geometry and unit conversion."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from placemap.constants import KM_PER_PX, LI_KM, LI_PER_PX


def dist(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def perp(x: Column, y: Column) -> tuple[Column, Column]:
    """The vector turned a quarter turn from x towards y."""
    return -y, x


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def midpoint(a: Column, b: Column) -> Column:
    return (a + b) / 2


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def li_to_km(li: Column) -> Column:
    return li * F.lit(LI_KM)


def li_to_px(li: Column) -> Column:
    return li / F.lit(float(LI_PER_PX))


def px_length_to_km(px: Column) -> Column:
    return px * F.lit(KM_PER_PX)
