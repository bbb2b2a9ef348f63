"""Reports of runs: totals, tables of outcomes and metrics, exported summaries, and writing them.

A report is a table of lines (part, position, line), so that one of any length is written without being in one
place; `text` puts a short one together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import text as t

#: The frame of an exported summary.
SUMMARY_HEAD, POINTS_HEAD, NO_SUMMARY, NO_POINTS = "## 요약", "## 핵심 포인트", "(요약 없음)", "- 핵심 포인트 없음"


def utc_now() -> Column:
    """The time of the query in UTC, to the second, as ISO 8601."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def run_totals(outcomes: DataFrame, stages: tuple[str, ...] = ()) -> DataFrame:
    """One row of a run's outcomes (status, and seconds by stage): documents in all and by status, and each
    stage's seconds."""
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_documents") for s in ("parsed", "fallback", "failed")]
    return outcomes.agg(F.count("*").alias("total_documents"), *counts, *(F.round(F.coalesce(F.sum(s), F.lit(0.0)), 3).alias(s) for s in stages))


def fields(row: DataFrame, title: str) -> DataFrame:
    """The head of a report: its title and a line for each column of a table of one row."""
    named = [F.concat(F.lit(f"- {c.replace('_', ' ').title()}: `"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("`")) for c in row.columns]
    return row.select(F.posexplode(F.array(F.lit(title), F.lit(""), *named)).alias("position", "line")).select(F.lit(0).alias("part"), F.col("position").cast("long").alias("position"), "line")


def _cells(columns: list[Column]) -> Column:
    safe = [F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *safe), F.lit(" |"))


def table_lines(rows: DataFrame, position: str, columns: dict[str, str], part: int = 1) -> DataFrame:
    """Rows as a markdown table below an empty line; columns: headings by column."""
    spark = rows.sparkSession
    head = [(part, -3, ""), (part, -2, f"| {' | '.join(columns.values())} |"), (part, -1, f"| {' | '.join('---' for _ in columns)} |")]
    body = rows.select(F.lit(part).alias("part"), F.col(position).cast("long").alias("position"), _cells([F.col(c) for c in columns]).alias("line"))
    return spark.createDataFrame(head, "part int, position bigint, line string").unionByName(body)


def text(lines: DataFrame) -> DataFrame:
    """A short report as one row (text)."""
    rows = F.array_sort(F.collect_list(F.struct("part", "position", "line")))
    return lines.agg(F.concat(F.array_join(F.transform(rows, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def summary_text(name: Column, document_id: Column, document_type: Column, summary: Column, points: Column) -> Column:
    """A summary as it is exported."""
    body = t.strip(t.text(summary))
    listed = F.transform(F.filter(F.transform(F.coalesce(points, F.array().cast("array<string>")), lambda x: t.strip(t.text(x))), lambda x: x != ""), lambda x: F.concat(F.lit("- "), x))
    lines = F.concat(
        F.array(F.concat(F.lit("# "), name, F.lit(" 요약")), F.lit(""), F.concat(F.lit("- Document ID: "), t.text(document_id.cast("string"))), F.concat(F.lit("- Document Type: "), t.text(document_type))),
        F.array(F.lit(""), F.lit(SUMMARY_HEAD), F.lit(""), F.when(body != "", body).otherwise(NO_SUMMARY), F.lit(""), F.lit(POINTS_HEAD), F.lit("")),
        F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(NO_POINTS))),
    )
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def save_lines(lines: DataFrame, path: str) -> None:
    """Write a report's lines in order, as text files in their order."""
    lines.orderBy("part", "position").select("line").write.mode("overwrite").text(path)


def save_json(rows: DataFrame, path: str) -> None:
    """Write rows as JSON, a line each, in UTF-8; nulls are kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
