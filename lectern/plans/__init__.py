"""All queries of the library by name, with their oracle SQL."""

from lectern.plans import feature_queries, grouping_queries, more_queries, record_queries, response_queries, stream_queries, structure_queries, study_queries, text_queries  # noqa: F401
from lectern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
