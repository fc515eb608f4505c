"""Windows over event streams; each works on a batch and on a stream.

An extension: the analytics that this package covers are batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None, keys: Sequence[str] = ("event_type",)) -> DataFrame:
    """start, keys, n, total: events in windows that don't overlap; ``late``: how long a stream waits."""
    x = events.withWatermark("ts", late) if late else events
    return x.groupBy(F.window("ts", width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str | None = None, keys: Sequence[str] = ("event_type",)) -> DataFrame:
    x = events.withWatermark("ts", late) if late else events
    return x.groupBy(F.window("ts", width, step), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, key: str = "user_id") -> DataFrame:
    """key, start, end, n: runs of events with no pause longer than ``gap``."""
    x = events.withWatermark("ts", late) if late else events
    return x.groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def running_totals(events: DataFrame, key: str = "user_id") -> DataFrame:
    """key, n, total so far, kept as state between batches of a stream."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for x in frames:
            n += len(x)
            total += float(x["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a folder, exactly once, and read the result."""
    df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(out)
