"""Session helpers: a local session for tests and the shared-folder checkpoint."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use.

    A cluster brings its own session; nothing in the library calls this.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; set one only where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")  # one machine: tests and the bench
    sc.setCheckpointDir(configured)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly over twice the session's cores, for work in Python whose cost isn't in the bytes of a row.

    Adaptive execution would leave few rows to one task.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; works for a file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than the session has cores, dealt out to all of them; a large one stays as it is.

    For work whose cost is in the rows' texts, not in reading them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width, at least 1."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def repo_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
