"""Problem 7: queries over documents.text by source, and source_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.mixing import Mixture, entropy, normal, tempered, token_counts
from corpusloom.session import table


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    return Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the largest size that meets all targets: one row a use of a document."""
    return _mixture(spark, sf_dir).uses


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that this mixture really reaches."""
    return _mixture(spark, sf_dir).shares()


def p7_stretched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached at twice the size that meets all targets: the exponent is bisected to what the repetitions allow."""
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets")
    return Mixture(documents, targets, total=2 * Mixture(documents, targets).total).shares()


def p7_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights without targets: natural shares tempered to the entropy of the targets."""
    m = table(spark, sf_dir, "source_targets").select("target_share").collect()
    goal = entropy(normal({str(i): r[0] for i, r in enumerate(m)}))
    n = {r["source"]: r["sum(tokens)"] for r in token_counts(table(spark, sf_dir, "documents")).groupBy("source").sum("tokens").collect()}
    natural = normal({k: float(x) for k, x in n.items()})
    w = tempered(natural, goal)
    return spark.createDataFrame([(k, natural[k], w[k]) for k in sorted(w)], "source string, natural_share double, weight double")


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_stretched": p7_stretched, "p7_tempered": p7_tempered}
SQL: dict[str, str] = {}
