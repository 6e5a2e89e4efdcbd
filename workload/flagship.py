"""Which recorded distances do the layouts contradict, and how good are they overall?"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemap.constants import KEY
from placemap.operators import metrics
from placemap.operators.joins import beside_runs
from placemap.sources.storage import stored
from workload.fixtures import Tables


def contradicted_distances(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    distances, positions = tables.distances(), tables.positions()
    # the ends are looked up once, for the report and for the scores
    errors = stored(metrics.edge_error(distances, positions), "edge-errors")
    return (
        beside_runs(metrics.above_threshold(errors), metrics.scores_of(errors), "inner")
        .select(KEY, "place_a", "place_b", "li_eval", "error", "delta_km", "raw_stress", "kruskal_stress")
        .orderBy(KEY, F.desc("error"), "place_a", "place_b")
    )
