"""All registered queries outside the training-data operators."""

from __future__ import annotations

from millrace.plans import page_queries, shape_queries, table_queries, text_queries, wire_queries  # noqa: F401  (importing registers)
from millrace.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
