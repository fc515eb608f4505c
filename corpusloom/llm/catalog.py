"""The queries and SQL of the problem modules, for __spark_entry__.py."""

from __future__ import annotations

import importlib

MODULES = ("p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8")


def load() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        try:
            module = importlib.import_module(f"corpusloom.llm.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"corpusloom.llm.{name}":
                raise
            continue
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
