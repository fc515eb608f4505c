"""Problem 1: queries over corrections and mini_llms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.pairs import defects
from corpusloom.session import table


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs: src_table, row_id, question, answer."""
    a = table(spark, sf_dir, "corrections").select(F.lit("corrections").alias("src_table"), F.col("correction_id").alias("row_id"), "question", F.col("wrong_answer").alias("answer"))
    b = table(spark, sf_dir, "mini_llms").select(F.lit("mini_llms").alias("src_table"), F.col("pair_id").alias("row_id"), F.col("instruction").alias("question"), F.col("output").alias("answer"))
    return a.union(b)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(pairs(spark, sf_dir))


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
