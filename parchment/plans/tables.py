"""Input tables of the queries, and documents made of several pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, source_name, markdown) of the documents table."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_name"), F.col("text").alias("markdown"))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, page_number, text): a conversation is a document, its turns are the pages."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.col("text"))


def line_pages(spark: SparkSession, sf_dir: str, per_page: int = 10) -> DataFrame:
    """(document_id, page_number, text): documents cut into pages of `per_page` lines."""
    lines = documents(spark, sf_dir).select("document_id", F.split(F.coalesce("markdown", F.lit("")), "\n", -1).alias("l"))
    starts = F.sequence(F.lit(0), F.floor((F.size("l") - 1) / per_page).cast("int"))
    pages = lines.select("document_id", "l", F.explode(starts).alias("p"))
    return pages.select("document_id", (F.col("p") + 1).alias("page_number"), F.array_join(F.slice("l", F.col("p") * per_page + 1, F.lit(per_page)), "\n").alias("text"))


def fixture(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table; its rows are part of the query."""
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple]) -> str:
    """The same rows as a VALUES list of SQL."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
