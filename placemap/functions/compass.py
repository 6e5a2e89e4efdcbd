"""Compass tokens as vectors on screen axes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from placemap.constants import CARDINALS, DIAGONALS, SYNONYMS


def direction_vector(token: Column) -> Column:
    """``struct(dx, dy, cardinal)`` for a known token, null for an unknown one."""
    known = {**CARDINALS, **DIAGONALS}
    known |= {short: known[long] for short, long in SYNONYMS.items()}
    entries: list[Column] = []
    for name, (dx, dy) in known.items():
        entries += [
            F.lit(name),
            F.struct(
                F.lit(float(dx)).alias("dx"),
                F.lit(float(dy)).alias("dy"),
                F.lit(dx * dy == 0).alias("cardinal"),
            ),
        ]
    return F.try_element_at(F.create_map(*entries), token)
