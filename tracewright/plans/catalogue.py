"""Every query of the trace engine by name, with SQL for comparison."""

from . import comm_queries, flow_queries, interval_queries, lookup_queries, memory_queries, region_queries, scalar_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
