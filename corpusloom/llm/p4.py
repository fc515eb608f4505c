"""Problem 4: queries over mem_chunks.text and annotations.quote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.scans import damages, paragraphs
from corpusloom.session import cut, table


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables: src_table, row_id, doc, text."""
    a = table(spark, sf_dir, "mem_chunks").select(F.lit("mem_chunks").alias("src_table"), F.col("id").cast("string").alias("row_id"), "doc", "text")
    b = table(spark, sf_dir, "annotations").select(F.lit("annotations").alias("src_table"), F.col("id").alias("row_id"), F.col("source").alias("doc"), F.col("quote").alias("text"))
    return a.union(b)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damages(texts(spark, sf_dir))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a continuous paragraph."""
    t = texts(spark, sf_dir)
    return paragraphs(t, cut(damages(t)))


QUERIES = {"p4_found": p4_found, "p4_paragraphs": p4_paragraphs}
SQL: dict[str, str] = {}
