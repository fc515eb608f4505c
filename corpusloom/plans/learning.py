"""Queries of the learning operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import learning as L
from corpusloom.operators import retrieval as R
from corpusloom.operators import structure as S
from corpusloom.plans.text import docs
from corpusloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("nmf_topics")
def nmf_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics of each document with enough pieces."""
    return L.document_topics(R.window_chunks(S.paragraphs(docs(spark, d))))


@query("character_clusters")
def character_clusters(spark: SparkSession, d: str) -> DataFrame:
    return L.project_characters(table(spark, d, "entities").select("entity_id", "project", "text", "label", "mention_count", "lower_count", "paras").distinct())


@query("standardised", "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity, round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 6) AS l_discount FROM lineitem")
def standardised(spark: SparkSession, d: str) -> DataFrame:
    x = L.standardise(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"])
    return x.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_discount", 6).alias("l_discount"))


@query("regression_fit", "SELECT 'intercept' AS feature, round(regr_intercept(l_extendedprice, l_quantity), 4) AS coefficient FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem")
def regression_fit(spark: SparkSession, d: str) -> DataFrame:
    return L.linear_fit(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice").select("feature", F.round("coefficient", 4).alias("coefficient"))


@query("regression_many")
def regression_many(spark: SparkSession, d: str) -> DataFrame:
    return L.linear_fit(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@query("mae_r2", "WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem), e AS (SELECT l_extendedprice AS y, l_extendedprice - (i + s * l_quantity) AS e FROM lineitem, f) SELECT count(*) AS n, round(avg(abs(e)), 3) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM e")
def mae_r2(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    p = L.predict(x, L.linear_fit(x, ["l_quantity"], "l_extendedprice"), ["l_quantity"])
    return L.errors(p, "l_extendedprice").select("n", F.round("mae", 3).alias("mae"), "r2")


@query("instruction_format", "SELECT DISTINCT pair_id, concat_ws(' ', instruction, output) AS text FROM mini_llms")
def instruction_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mini_llms").select("pair_id", F.concat_ws(" ", "instruction", "output").alias("text")).distinct()


@query("conversations", "WITH m AS (SELECT project, task, id, unnest([{'o': id * 2, 'role': 'user', 'content': input_text}, {'o': id * 2 + 1, 'role': 'assistant', 'content': coalesce(final_text, output_text)}]) AS m FROM mem_feedback) SELECT project, task, count(*) AS turns, string_agg(m.role || ': ' || m.content, chr(10) ORDER BY m.o) AS log FROM m WHERE m.content IS NOT NULL GROUP BY 1, 2")
def conversations(spark: SparkSession, d: str) -> DataFrame:
    """The log of each task, two messages a judgement."""
    x = table(spark, d, "mem_feedback")
    m = F.array(F.struct((F.col("id") * 2).alias("o"), F.lit("user").alias("role"), F.col("input_text").alias("content")), F.struct((F.col("id") * 2 + 1).alias("o"), F.lit("assistant").alias("role"), F.coalesce("final_text", "output_text").alias("content")))
    y = x.select("project", "task", F.explode(m).alias("m")).filter("m.content is not null")
    log = F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda s: F.concat(s["role"], F.lit(": "), s["content"])), "\n")
    return y.groupBy("project", "task").agg(F.count(F.lit(1)).alias("turns"), log.alias("log"))
