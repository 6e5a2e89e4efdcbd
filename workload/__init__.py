"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from workload import ensemble_queries, file_queries, force_queries, graph_queries, map_queries  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
