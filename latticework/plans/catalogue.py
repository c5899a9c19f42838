"""All registered queries: importing this module registers them."""

from latticework.plans import call_queries, graph_queries, kernel_queries, source_queries  # noqa: F401
from latticework.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
