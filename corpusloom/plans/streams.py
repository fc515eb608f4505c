"""Queries on events: windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import table
from corpusloom.streaming import windows as W


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    x = W.tumbling(table(spark, d, "events"))
    return x.select("start", "event_type", "n", F.round("total", 4).alias("total"))


def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    return W.sliding(table(spark, d, "events"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return W.sessions(table(spark, d, "events")).select("user_id", "start", "n")


QUERIES = {"event_windows": event_windows, "event_sliding": event_sliding, "event_sessions": event_sessions}
SQL = {
    "event_windows": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sliding": "SELECT start, event_type, count(*) AS n FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(k AS INTEGER)) AS start, event_type FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY 1, 2",
    "event_sessions": "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k",
}
