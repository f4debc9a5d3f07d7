"""Every query by name, and the SQL that says the same."""

from __future__ import annotations

from .plans import detail_queries, file_queries, graph_queries, list_queries, markup_queries, page_queries, search_queries  # noqa: F401
from .plans.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
