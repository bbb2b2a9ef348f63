"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Only where that is unset and all runs on one machine
    (tests), a temporary one; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("parchment.scratch", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='parchment-')}"
        spark.conf.set("parchment.scratch", root)
    return f"{root.rstrip('/')}/parchment/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new shared folder and read again, for what more than one branch of a
    plan needs."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: How much of a table, as it is stored, one task takes.
PIECE = 4 << 20


def pieces(df: DataFrame) -> int:
    """How many tasks df is dealt to: in proportion to the size that the planner reads from its files, so that
    a task's memory stays the same as tables grow. Tables of unknown size, which aren't from files, are dealt as
    Spark does. Not for joins, whose sizes the planner multiplies."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    session = df.sparkSession
    if size > session.sparkContext.defaultParallelism * PIECE * 10_000:
        return int(session.conf.get("spark.sql.shuffle.partitions"))
    return max(session.sparkContext.defaultParallelism, -(-size // PIECE))
