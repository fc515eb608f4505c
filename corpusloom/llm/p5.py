"""Problem 5: queries over mem_chunks.vec, mem_feedback.vec and corrections.question_embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.vectors import nearest
from corpusloom.session import table

CORRECTION_MODEL, CORRECTION_DIM = "nomad-64", 64


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors: key, model, dim, vec."""
    parts = [
        table(spark, sf_dir, t).select(F.concat(F.lit(f"{t}:"), F.col("id").cast("string")).alias("key"), "model", F.col("dim").cast("int").alias("dim"), "vec")
        for t in ("mem_chunks", "mem_feedback")
    ]
    parts.append(
        table(spark, sf_dir, "corrections").select(
            F.concat(F.lit("corrections:"), F.col("correction_id").cast("string")).alias("key"),
            F.lit(CORRECTION_MODEL).alias("model"),
            F.lit(CORRECTION_DIM).alias("dim"),
            F.col("question_embedding").alias("vec"),
        )
    )
    return parts[0].union(parts[1]).union(parts[2]).filter(F.col("model").isNotNull())


def rows(spark: SparkSession, sf_dir: str) -> int:
    """From the files' footers."""
    return sum(table(spark, sf_dir, t).count() for t in ("mem_chunks", "mem_feedback", "corrections"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(vectors(spark, sf_dir), 5, 0.85, rows(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = p5_neighbours(spark, sf_dir)
    return n.select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
