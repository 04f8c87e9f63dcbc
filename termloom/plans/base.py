"""Where queries and their SQL are collected."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, *parts: str):
    """Register a query; ``parts`` are common table expressions that go before ``sql``."""

    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = (f"WITH {', '.join(parts)}\n" if parts else "") + sql
        return function

    return keep
