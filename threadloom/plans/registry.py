"""Registry of the runnable queries: name, blueprint ids, Spark form and (where SQL can say it) the oracle text."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from threadloom.sources.testviews import oracle


class Entry(NamedTuple):
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register a query.  `sql` may name any adapter view; `views` adds local ones."""

    def register(run):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(ids, run, oracle(sql, views) if sql else None)
        return run

    return register
