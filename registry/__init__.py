"""The driver tables seen as study records, the registered queries and their SQL counterparts."""

from registry.base import ORACLES, QUERIES
from registry import q_sources, q_extract, q_derive, q_counts, q_disclosure, q_reports  # noqa: F401  (fill the tables)

__all__ = ["ORACLES", "QUERIES"]
