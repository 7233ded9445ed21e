"""Importing the query modules fills the registry."""

from driftgauge.plans import (  # noqa: F401
    coverage_queries,
    io_queries,
    iterated_queries,
    model_queries,
    rank_queries,
    resample_queries,
    sampling_queries,
    score_queries,
    table_queries,
)
from driftgauge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
