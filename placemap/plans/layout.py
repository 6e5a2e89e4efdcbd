"""Where a layout starts."""

from pyspark.sql import DataFrame

from placemap.operators.geometry import apply_anchors, random_positions, shift


def start_positions(places: DataFrame, anchors: DataFrame | None, seed: int = 0) -> DataFrame:
    """Random start, drawn together about the canvas centre, anchors in place."""
    start = shift(random_positions(places, seed))
    return start if anchors is None else apply_anchors(start, anchors)
