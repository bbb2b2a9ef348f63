"""Event streams: windows with late data, job states, and notices to subscribers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a job, and what makes them.
QUEUED, RUNNING, COMPLETED, FAILED = "queued", "running", "completed", "failed"


def windowed(events: DataFrame, duration: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; events later than `late` behind the watermark don't count."""
    window = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    source = events.withWatermark("ts", late) if events.isStreaming else events
    rows = source.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events no further apart than `gap`."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    rows = source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return rows.select("user_id", F.col("w.start").alias("session_start"), "events")


def distinct(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; on a stream, within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def next_state(state: str, event_type: str) -> str:
    """queued at first; running with any event; completed by a purchase, failed by an error, both for good."""
    if state in (COMPLETED, FAILED):
        return state
    return {"purchase": COMPLETED, "error": FAILED}.get(event_type, RUNNING)


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, state, events): the state of each job (user_id) after its events in order of time.

    A stream keeps one small state per job and reports each job that a batch has changed; a table needs none.
    """
    if not events.isStreaming:
        return settled_states(events)

    import pandas as pd

    schema = "job_id bigint, state string, events bigint"

    def fold(state: str, n: int, rows: pd.DataFrame) -> tuple[str, int]:
        for kind in rows.sort_values(["ts", "event_id"]).event_type:
            state = next_state(state, kind)
        return state, n + len(rows)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else (QUEUED, 0)
        now, n = fold(now, n, pd.concat(list(frames)))
        state.update((now, n))
        yield pd.DataFrame({"job_id": [key[0]], "state": [now], "events": [n]})

    rows = events.select("user_id", "event_id", "event_type", "ts").groupBy("user_id")
    return rows.applyInPandasWithState(step, schema, "state string, events bigint", "update", "NoTimeout")


def settled_states(events: DataFrame) -> DataFrame:
    """The same states without Python: the first event that ends a job decides."""
    first = F.min_by("event_type", F.when(F.col("event_type").isin("purchase", "error"), F.struct("ts", "event_id")))
    state = F.when(first == "purchase", COMPLETED).when(first == "error", FAILED).otherwise(RUNNING)
    return events.groupBy(F.col("user_id").alias("job_id")).agg(state.alias("state"), F.count("*").alias("events"))
