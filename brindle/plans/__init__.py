"""The query catalogue; each module registers its queries on import."""

from __future__ import annotations

import importlib
import re

from brindle import registry
from brindle.tables import NAMES, view

MODULES = ("tpch", "relational", "joins", "aggregates", "windows", "functions_scalar", "functions_nested", "storage", "events", "delivery")


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"brindle.plans.{m}")


def run_sql(spark, sf_dir: str, text: str, args=None):
    """SQL text over the tables it names; args are typed parameters, by name or by position."""
    used = [n for n in NAMES if re.search(rf"\b{n}\b", text)]
    if used:  # the tables are common table expressions of the text, so the session's own views stay as they are
        head = re.match(r"\s*with\s+(recursive\s+)?", text, re.I)
        tables = ", ".join(f"{n} as (select * from {view(spark, sf_dir, n)})" for n in used)
        text = f"with {head[1] or ''}{tables}, {text[head.end():]}" if head else f"with {tables} {text}"
    return spark.sql(text, args=args) if args else spark.sql(text)


def both(name: str, text: str, tags: str = "", oracle: str | None = None) -> None:
    """A query given as SQL; the oracle is the same text unless its dialect differs."""
    registry.query(name, oracle or text, tags)(lambda spark, sf_dir: run_sql(spark, sf_dir, text))
