"""Streaming queries: each runs a stream over a table's files to the end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions.storage import shared_folder
from parchment.operators import registry
from parchment.plans.tables import documents, table
from parchment.streaming import events, ingest

MODEL = "local-deterministic-v1-128"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream: one file beside the others, or a folder of files."""
    schema = table(spark, sf_dir, name).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")
    # A watermark needs a timestamp of the session's time zone.
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else stream


def _read(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    folder = shared_folder(spark, "stream")
    return spark.read.parquet(ingest.latest_rows(stream, f"{folder}/out", f"{folder}/checkpoint", mode))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.16: events per day and type from a stream with a watermark."""
    rows = _read(spark, events.windowed(_stream(spark, sf_dir, "events")))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("total", 4).alias("total"))


STREAM_WINDOWS = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.16: events in two-day windows that begin every day."""
    rows = events.windowed(table(spark, sf_dir, "events"), "2 days", "1 day")
    return rows.groupBy(F.date_format("window_start", "yyyy-MM-dd").alias("first_day")).agg(F.sum("events").alias("events"))


STREAM_SLIDING_WINDOWS = """
WITH d AS (SELECT ts::DATE AS d FROM events), w AS (SELECT d AS s FROM d UNION ALL SELECT d - 1 FROM d)
SELECT strftime(s, '%Y-%m-%d') AS first_day, count(*)::BIGINT AS events FROM w GROUP BY 1"""


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.16, M06: sessions of users, four hours apart."""
    rows = events.sessions(table(spark, sf_dir, "events"))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


USER_SESSIONS = """
WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 4 HOURS)::INT, 0) AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1"""


def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each job after a stream of its events."""
    folder = shared_folder(spark, "jobs")
    ingest.run(events.job_states(_stream(spark, sf_dir, "events")), lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/checkpoint", "update")
    rows = spark.read.parquet(f"{folder}/out")
    return rows.groupBy("job_id").agg(F.max_by("state", "events").alias("state"), F.max("events").alias("events"))


JOB_STATES = """
WITH f AS (SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (event_type IN ('purchase', 'error')) AS e, count(*) AS events FROM events GROUP BY 1)
SELECT user_id AS job_id, CASE e WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS state, events FROM f"""


def batch_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from the table, without Python."""
    return events.settled_states(table(spark, sf_dir, "events"))


def stream_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First notices per user and type within the watermark, from a stream."""
    stream = events.distinct(_stream(spark, sf_dir, "events"), ["event_id"])
    folder = shared_folder(spark, "distinct")
    ingest.run(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"), f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("events"))


STREAM_DISTINCT_EVENTS = "SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY 1"


def stream_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry filled from a stream of documents: records and distinct contents."""
    folder = shared_folder(spark, "registry")
    stream = _stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_name"), F.col("text").alias("markdown"))
    sink = ingest.RegistrySink(spark, f"{folder}/registry", MODEL)
    ingest.run(stream, sink, f"{folder}/checkpoint")
    return sink.read().agg(F.count("*").alias("records"), F.countDistinct("content_hash").alias("contents"), F.min("position").alias("first_position"))


STREAM_REGISTRY = r"""
WITH h AS (SELECT sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS h FROM documents)
SELECT count(DISTINCT h) AS records, count(DISTINCT h) AS contents, 0::BIGINT AS first_position FROM h"""


def ingest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingesting the same documents again indexes nothing."""
    docs = registry.hashed(documents(spark, sf_dir))
    empty = spark.createDataFrame([], ingest.RECORD)
    once = registry.merged(empty, registry.ingest(docs, empty, MODEL), MODEL)
    return registry.totals(registry.ingest(docs, once, MODEL))


QUERIES = {
    "stream_windows": stream_windows,
    "sliding_windows": stream_sliding_windows,
    "user_sessions": user_sessions,
    "stream_job_states": stream_job_states,
    "batch_job_states": batch_job_states,
    "stream_distinct_events": stream_distinct_events,
    "stream_registry": stream_registry,
    "ingest_twice": ingest_twice,
}
ORACLES = {
    "stream_windows": STREAM_WINDOWS,
    "sliding_windows": STREAM_SLIDING_WINDOWS,
    "user_sessions": USER_SESSIONS,
    "stream_job_states": JOB_STATES,
    "batch_job_states": JOB_STATES,
    "stream_distinct_events": STREAM_DISTINCT_EVENTS,
    "stream_registry": STREAM_REGISTRY,
    "ingest_twice": "SELECT 'duplicate' AS status, count(*) AS documents FROM documents",
}
