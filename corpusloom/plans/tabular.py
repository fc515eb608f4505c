"""Queries on the order tables: the data-frame operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import tabular as B
from corpusloom.plans import as_bigint
from corpusloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _union(f, cols) -> str:
    return " UNION ALL ".join(f(c) for c in cols)


@query("select_numeric", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_numeric(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer")
    return x.select(B.numeric_columns(x))


@query("select_text", "SELECT c_name, c_mktsegment FROM customer")
def select_text(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer")
    return x.select(B.text_columns(x))


@query("column_pattern", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def column_pattern(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer")
    return x.select(B.columns_like(x, "e"))


@query("first_columns", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def first_columns(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders")
    return x.select(x.columns[:3])


@query("dropped_columns", "SELECT s_suppkey, s_acctbal AS balance FROM supplier")
def dropped_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").drop("s_name", "s_nationkey").withColumnRenamed("s_acctbal", "balance")


@query("filter_and", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def filter_and(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query("not_in_filter", "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'fr') OR lang IS NULL")
def not_in_filter(spark: SparkSession, d: str) -> DataFrame:
    return B.not_in(table(spark, d, "documents").select("doc_id", "lang"), "lang", ["en", "fr"])


@query("complete_rows", "SELECT doc_id, lang, source, title FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND title IS NOT NULL")
def complete_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", "title").na.drop("any")


@query("describe_numeric", _union(lambda c: f"SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM lineitem", LINE))
def describe_numeric(spark: SparkSession, d: str) -> DataFrame:
    return B.describe(table(spark, d, "lineitem"), LINE)


@query("describe_categorical", _union(lambda c: f"SELECT '{c}' AS \"column\", sum(n) AS count, count(*) AS \"unique\", arg_min({c}, n * -100000 + r) AS top, max(n) AS freq FROM (SELECT {c}, count(*) AS n, row_number() OVER (ORDER BY {c}) AS r FROM orders WHERE {c} IS NOT NULL GROUP BY 1)", ["o_orderstatus", "o_orderpriority"]))
def describe_categorical(spark: SparkSession, d: str) -> DataFrame:
    return B.describe_text(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("summary_numeric", _union(lambda c: f"SELECT '{c}' AS \"column\", count({c}) AS count, sum({c}) AS sum, avg({c}) AS mean, median({c}) AS median, min({c}) AS min, max({c}) AS max, stddev_samp({c}) AS std, max({c}) - min({c}) AS range, stddev_samp({c}) / avg({c}) * 100 AS cv FROM lineitem", ["l_quantity", "l_extendedprice"]))
def summary_numeric(spark: SparkSession, d: str) -> DataFrame:
    return B.summary(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("group_multi_agg", "SELECT o_orderpriority, count(o_totalprice) AS count, avg(o_totalprice) AS mean, sum(o_totalprice) AS sum, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def group_multi_agg(spark: SparkSession, d: str) -> DataFrame:
    return B.group_stats(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")


@query("value_counts", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.value_counts(table(spark, d, "customer"), "c_mktsegment")


@query("pair_counts", "SELECT source, filetype, count(*) AS n FROM documents WHERE source IS NOT NULL AND filetype IS NOT NULL GROUP BY 1, 2")
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.pair_counts(table(spark, d, "documents"), "source", "filetype")


@query("conditional_counts", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.value_counts(table(spark, d, "orders").filter("o_totalprice > 100000"), "o_orderpriority")


@query("distinct_values", "SELECT DISTINCT source FROM documents")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source").distinct()


@query("distinct_counts", "SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT project) AS projects FROM documents")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.count_distinct("project").alias("projects"))


@query("mode_min", "SELECT l_quantity, n FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, l_quantity LIMIT 1")
def mode_min(spark: SparkSession, d: str) -> DataFrame:
    return B.mode(table(spark, d, "lineitem"), "l_quantity")


@query("null_profile", _union(lambda c: f"SELECT '{c}' AS \"column\", sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS nulls, round(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / count(*) * 100, 4) AS percent FROM documents", ["text", "lang", "source", "title", "filetype"]))
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return B.nulls(table(spark, d, "documents"), ["text", "lang", "source", "title", "filetype"])


@query("shape", "SELECT count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE orders)) AS n_cols FROM orders")
def shape(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders")
    return x.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(x.columns)))


@query("pivot_agg", "SELECT o_orderpriority, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS F, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS O, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot_agg(spark: SparkSession, d: str) -> DataFrame:
    return B.pivot(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"])


@query(
    "crosstab_margins",
    """SELECT coalesce(o_orderpriority, 'All') AS o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P, count(*) AS "All"
  FROM orders GROUP BY ROLLUP (o_orderpriority)""",
)
def crosstab_margins(spark: SparkSession, d: str) -> DataFrame:
    return B.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("corr_matrix", _union(lambda p: f"SELECT '{p[0]}' AS a, '{p[1]}' AS b, round(corr({p[0]}, {p[1]}), 9) AS corr FROM lineitem", [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]))
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return B.correlations(table(spark, d, "lineitem"), LINE)


@query("rank_avg", "SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 100) DESC) + (count(*) OVER (PARTITION BY c_nationkey, floor(c_acctbal / 100)) - 1) / 2 AS rank FROM customer")
def rank_avg(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").withColumn("v", F.floor(F.col("c_acctbal") / 100))
    return x.select("c_custkey", "c_nationkey", B.average_rank(x, ["c_nationkey"], "v").alias("rank"))


@query(
    "percentile_rank",
    "WITH r AS (SELECT l_quantity, rank() OVER (ORDER BY l_quantity DESC) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rank, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS up, count(*) OVER () AS c FROM lineitem) SELECT l_quantity, count(*) AS n, max(rank) AS rank, round(max(up) / max(c) * 100, 6) AS percent FROM r GROUP BY 1",
)
def percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    return B.ranked_counts(table(spark, d, "lineitem"), "l_quantity")


@query("head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def head_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)


@query("tail_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def tail_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_orderkey")).limit(10)


@query("top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("sample_rows")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return B.sample(table(spark, d, "orders"), "o_orderkey", 100)


@query("train_test_split")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return B.split(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("dedupe_rows", "SELECT DISTINCT entity_id, project, text, label, mention_count FROM entities")
def dedupe_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("entity_id", "project", "text", "label", "mention_count").dropDuplicates()


@query("keep_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return B.keep_first(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("fixed_size_parts", "SELECT o_orderkey, floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1500) AS part FROM orders")
def fixed_size_parts(spark: SparkSession, d: str) -> DataFrame:
    return B.numbered_parts(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1500)


@query("category_codes", "WITH v AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) SELECT doc_id, documents.lang, coalesce(code, -1) AS code FROM documents LEFT JOIN v ON documents.lang = v.lang")
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    return B.codes(table(spark, d, "documents").select("doc_id", "lang"), "lang").select("doc_id", "lang", "code")


@query("short_numbers", "SELECT o_orderkey, CASE WHEN v >= 1000000 THEN printf('%.1fM', round(v / 1000000, 1)) WHEN v >= 1000 THEN printf('%.1fk', round(v / 1000, 1)) ELSE CAST(v AS VARCHAR) END AS short FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)")
def short_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.short_number(F.floor("o_totalprice").cast("long")).alias("short"))


@query("min_max_scaled", "SELECT c_custkey, c_nationkey, round(CASE WHEN max(c_acctbal) OVER w - min(c_acctbal) OVER w <= 1e-6 THEN 0.5 ELSE (c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w) END, 6) AS scaled FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def min_max_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Min-max per group by a join with the group's extremes; 0.5 where they coincide."""
    x = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    g = x.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return x.join(g, "c_nationkey").select("c_custkey", "c_nationkey", F.round(F.when(span <= 1e-6, 0.5).otherwise((F.col("c_acctbal") - F.col("lo")) / span), 6).alias("scaled"))


@query("rounded", "SELECT o_orderkey, round(o_totalprice / 7, 4) AS ratio FROM orders")
def rounded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 7, 4).alias("ratio"))


@query("dtype_breakdown", "SELECT data_type, count(*) AS n FROM (VALUES ('bigint'), ('bigint'), ('string'), ('double'), ('timestamp'), ('string')) AS t(data_type) GROUP BY 1")
def dtype_breakdown(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders")
    kinds = [("timestamp" if t.startswith("timestamp") else t,) for _, t in x.dtypes]
    return spark.createDataFrame(kinds, "data_type string").groupBy("data_type").agg(F.count(F.lit(1)).alias("n"))


@query("priced_lines", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_extendedprice) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def priced_lines(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_extendedprice").alias("avg_price"), F.count(F.lit(1)).alias("n")
    )


as_bigint(SQL, "describe_categorical", "count")
as_bigint(SQL, "null_profile", "nulls")
as_bigint(SQL, "fixed_size_parts", "part")
