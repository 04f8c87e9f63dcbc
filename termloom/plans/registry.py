"""All queries of the analytics part, with the SQL that checks them."""

from __future__ import annotations

import importlib

from .base import ORACLES, QUERIES

for _name in ("term_queries", "text_queries", "list_queries", "graph_queries", "source_queries", "stream_queries"):
    importlib.import_module(f"{__package__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
