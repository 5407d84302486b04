"""All queries outside the subpackage llm: a query is registered with its SQL, or with None where SQL cannot express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def load() -> None:
    from . import conversations, corpus, relational, retrieval, streams  # noqa: F401


load()
