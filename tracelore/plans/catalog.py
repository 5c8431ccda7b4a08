"""All queries of the trace operators; importing the modules registers them."""

from __future__ import annotations

from tracelore.plans import evaluation_queries, feature_queries, fixture_queries, graph_queries, model_queries, parsing_queries, relational_queries, sequence_queries, source_queries, stream_queries  # noqa: F401
from tracelore.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "behavior_profile"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
