"""The three jobs of a map study: evaluate a layout, study an ensemble, assemble map layers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemap.constants import ALIGN_ANCHOR, DETAIL_BOX, ERROR_CAP, KEY, REFERENCE_POINT, SECOND_ANCHOR
from placemap.operators import density, directions as compass, ensemble as stats, metrics, truth as known
from placemap.operators.geometry import flip_y, km_to_px, lcc_forward
from placemap.operators.joins import beside_runs, one_run, with_endpoints
from placemap.operators.layers import map_layers
from placemap.sources import readers
from placemap.sources.storage import stored


def anchors_from_truth(
    truth: DataFrame, align: str = ALIGN_ANCHOR, others: tuple[str, ...] = (SECOND_ANCHOR,), ref=REFERENCE_POINT
) -> DataFrame:
    """The alignment anchor on the reference pixel, the others where their coordinates put them."""
    names = truth.filter(F.col("name").isin(align, *others))
    return km_to_px(lcc_forward(names, align), ref).select(KEY, "name", "x", "y")


def evaluate(
    distances: DataFrame, directions: DataFrame, positions: DataFrame, truth: DataFrame,
    anchor: str = ALIGN_ANCHOR, ref=REFERENCE_POINT, box=DETAIL_BOX, threshold: float = ERROR_CAP,
) -> dict[str, DataFrame]:
    """Everything that is reported about finished layouts, as tables.

    The ends of the edges are looked up once, by a job of its own; scores, errors, report and details read what it has written.
    """
    ended = stored(with_endpoints(distances, positions), "edges-with-ends")
    errors = metrics.edge_error_of_ends(ended)
    compared = known.compare_truth(positions, truth, anchor, ref)
    broken = compass.direction_violations(directions, positions)
    return {
        "scores": beside_runs(metrics.layout_scores_of_ends(ended), known.rmse(compared)),
        "edge_errors": errors,
        "report": metrics.error_report(errors, threshold),
        "detail_errors": metrics.edge_error_of_ends(ended, box),
        "truth_errors": known.error_scale(compared),
        "violations": broken,
        "places": compass.flag_violating(positions, broken),
    }


def ensemble_statistics(samples: DataFrame) -> dict[str, DataFrame]:
    """Ellipses and densities of a table of sampled positions; densities use upward y."""
    flipped = flip_y(samples)
    points = density.kde_points(flipped)
    return {
        "moments": stats.sample_moments(samples),
        "ellipses": stats.drop_degenerate(stats.confidence_ellipses(samples)),
        "density_points": points,
        "density_range": density.density_range(points),
        "density_grid": density.positive_density(density.kde_grid(flipped)),
    }


def layers_from_files(
    spark: SparkSession, positions: str, samples: str, edge_errors: str, ground_truth: str
) -> DataFrame:
    """Map layers from saved tables."""
    nodes = readers.read_positions_lonlat(spark, positions)
    places = one_run(nodes.select("name"))
    truth = known.resolve_aliases(readers.read_ground_truth(spark, ground_truth), places)
    return map_layers(
        nodes, readers.read_samples_lonlat(spark, samples), known.truth_layer(places, truth),
        readers.read_edge_errors(spark, edge_errors),
    )
