"""Problem 2: queries over corpus_analysis.keywords and graph_data.shared_keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.sets import classes_of, similar_classes, similar_pairs, term_set
from corpusloom.session import table

THRESHOLD, LEAST_TERMS = 0.6, 5


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables as records: rec, terms."""
    analysis = table(spark, sf_dir, "corpus_analysis").select(F.concat(F.lit("corpus_analysis:"), "id").alias("rec"), term_set(F.col("keywords.term")).alias("terms"))
    graph = table(spark, sf_dir, "graph_data").select(F.concat(F.lit("graph_data:"), F.col("link_id").cast("string")).alias("rec"), term_set(F.col("shared_keywords")).alias("terms"))
    return analysis.union(graph)


def rows(spark: SparkSession, sf_dir: str) -> int:
    """From the files' footers."""
    return sum(table(spark, sf_dir, t).count() for t in ("corpus_analysis", "graph_data"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(records(spark, sf_dir), THRESHOLD, LEAST_TERMS, rows(spark, sf_dir))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record: its class of equal sets and the number of other classes similar to it."""
    classes, members = classes_of(records(spark, sf_dir), LEAST_TERMS)
    pairs = similar_classes(classes, THRESHOLD, rows(spark, sf_dir))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("links"))
    return members.join(degree, "cid", "left").select("rec", F.col("cid").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes}
SQL = {
    "p2_found": """
WITH raw AS (
  SELECT 'corpus_analysis:' || id AS rec, unnest(list_transform(keywords, lambda k: k.term)) AS term FROM corpus_analysis
  UNION ALL
  SELECT 'graph_data:' || CAST(link_id AS VARCHAR), unnest(shared_keywords) FROM graph_data
), tok AS (
  SELECT DISTINCT rec, lower(regexp_replace(term, '^\\s+|\\s+$', '', 'g')) AS term FROM raw
  WHERE term IS NOT NULL AND regexp_replace(term, '^\\s+|\\s+$', '', 'g') <> ''
), size AS (SELECT rec, count(*) AS n FROM tok GROUP BY rec HAVING count(*) >= 5),
kept AS (SELECT t.rec, t.term, s.n FROM tok t JOIN size s ON t.rec = s.rec)
SELECT a.rec AS rec_a, b.rec AS rec_b
FROM kept a JOIN kept b ON a.term = b.term AND a.rec < b.rec
GROUP BY a.rec, b.rec, a.n, b.n
HAVING count(*) >= 0.6 * (a.n + b.n - count(*)) - 1e-9
""",
}
