"""Problem 6: queries over eval_items.text and documents.text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.leaks import matches
from corpusloom.session import table

LEAST_WORDS = 12


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), LEAST_WORDS)


QUERIES = {"p6_found": p6_found}
SQL: dict[str, str] = {}
