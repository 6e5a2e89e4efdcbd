"""Z-order keys of points: places that are near each other on the plane are mostly near each other in key order."""

import heapq
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 20  # per axis


def _spread(value: Column) -> Column:
    """A zero bit after every bit of a number of up to 32 bits."""
    for shift in (16, 8, 4, 2, 1):
        mask = sum(((1 << shift) - 1) << at for at in range(0, 64, 2 * shift))
        mask -= (1 << 64) * (mask >= 1 << 63)
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return value


def z_key(x: Column, y: Column, low: tuple[float, float], side: float) -> Column:
    """Key of the cell of a point in the square from ``low``; null without finite coordinates."""

    def cell(value: Column, least: float) -> Column:
        at = F.floor((value - F.lit(least)) / F.lit(side / 2**BITS))
        return F.when(F.abs(value) < F.lit(float("inf")), F.least(F.greatest(at, F.lit(0)), F.lit(2**BITS - 1))).cast("bigint")

    return _spread(cell(x, low[0])).bitwiseOR(F.shiftleft(_spread(cell(y, low[1])), 1))


def key_ranges(box: tuple[float, float, float, float], low: tuple[float, float], side: float, most: int = 64) -> list[tuple[int, int]]:
    """Ranges of keys, ``most`` at most, that hold every point of the box (x_min, y_min, x_max, y_max) and little else.

    The largest squares that the box only cuts are divided first, until there are enough.
    """
    size = side / 2**BITS
    x1, y1, x2, y2 = (
        min(max(math.floor((box[i] - low[i % 2]) / size), -1), 2**BITS) for i in range(4)
    )

    def place(level: int, cx: int, cy: int) -> tuple[int, int]:
        key = sum(((cx >> b & 1) << 2 * b) | ((cy >> b & 1) << 2 * b + 1) for b in range(level))
        width = 4 ** (BITS - level)
        return key * width, (key + 1) * width - 1

    def kind(level: int, cx: int, cy: int) -> str:
        s = 1 << BITS - level
        ax, ay, bx, by = cx * s, cy * s, (cx + 1) * s - 1, (cy + 1) * s - 1
        if bx < x1 or ax > x2 or by < y1 or ay > y2:
            return "out"
        return "in" if ax >= x1 and bx <= x2 and ay >= y1 and by <= y2 else "cut"

    root = (0, 0, 0)
    if kind(*root) == "out":
        return []
    inside, cut = ([root], []) if kind(*root) == "in" else ([], [root])
    while cut and len(inside) + len(cut) + 3 <= most and cut[0][0] < BITS:
        level, cx, cy = heapq.heappop(cut)
        for child in ((level + 1, 2 * cx + i, 2 * cy + j) for i in (0, 1) for j in (0, 1)):
            found = kind(*child)
            if found == "in":
                inside.append(child)
            elif found == "cut":
                heapq.heappush(cut, child)
    merged: list[tuple[int, int]] = []
    for first, last in sorted(place(*c) for c in inside + cut):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = merged[-1][0], max(last, merged[-1][1])
        else:
            merged.append((first, last))
    return merged
