"""Problem 8: queries over documents.text and reading_labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.reading import levels
from corpusloom.session import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES = {"p8_found": p8_found}
SQL: dict[str, str] = {}
