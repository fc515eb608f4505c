"""Problem 3: queries over entities.text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.names import linked, variant_pairs
from corpusloom.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(table(spark, sf_dir, "entities"))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an entity row: the key of what it means."""
    return linked(table(spark, sf_dir, "entities"))


QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities}
SQL: dict[str, str] = {}
