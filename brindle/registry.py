"""Named queries: each a Spark callable, most with an independent SQL oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    run: Query
    oracle: str | None
    tags: tuple[str, ...] = field(default_factory=tuple)


ENTRIES: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None, tags: str = "") -> Callable[[Query], Query]:
    """Register a query; tags are the ids of the operator inventory it covers."""

    def add(f: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(name, f, oracle, tuple(tags.split()))
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: e.run for k, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.oracle for k, e in ENTRIES.items() if e.oracle}
