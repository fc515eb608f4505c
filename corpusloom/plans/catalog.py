"""All queries of the core and their SQL; the llm subpackage is added by __spark_entry__.py."""

from __future__ import annotations

import importlib

MODULES = ("text", "relations", "tabular", "retrieval", "learning", "streams")


def load() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        try:
            module = importlib.import_module(f"corpusloom.plans.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"corpusloom.plans.{name}":
                raise
            continue
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
