"""Pages and tables as chunks that a language model can read without their document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import text as t
from parchment.operators import pages, tables

MOST_POINTS, MOST_FACTS, MOST_TITLE = 6, 80, 160


def compact_page(c: Column) -> Column:
    """Lines with single spaces, at most one empty line in a row."""
    lines = F.array_join(F.transform(t.lines(t.text(c)), t.collapse), "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def first_line(c: Column) -> Column:
    """The first line that is no heading, at most 160 characters; '' if none."""
    own = F.filter(F.transform(t.lines(c), t.strip), lambda x: (x != "") & ~x.startswith("#"))
    return F.substring(F.coalesce(F.get(own, 0), F.lit("")), 1, MOST_TITLE)


def clean_chunk(page: Column, title: Column, summary: Column, points: Column, body: Column) -> Column:
    """A page as a chunk: heading, title, summary, key points, content."""
    kept = F.slice(F.filter(F.transform(points, t.strip), lambda x: x != ""), 1, MOST_POINTS)
    listed = F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(
        F.format_string("## Page %d\n\nTitle: ", page), title,
        F.when(summary != "", F.concat(F.lit("\n\nSummary: "), summary)).otherwise(""),
        F.when(F.size(kept) > 0, F.concat(F.lit("\n\nKey points:\n"), listed)).otherwise(""),
        F.lit("\n\nContent:\n\n"), body,
    )


def llm_ready(docs: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(document_id, page_number, chunk_type, retrieval_lane, chunk_id, section_hint, text) of
    documents (document_id, markdown): one clean chunk a page, one relation chunk a table.

    summaries: (document_id, page_number, summary_text, key_points); pages' own by default. A
    document without page headings is one chunk as it is.
    """
    by_page = pages.split(docs, keep_heading=True).withColumn("text", compact_page(F.col("text")))
    made = summaries if summaries is not None else pages.summaries(pages.split(docs))
    rows = by_page.join(made.select("document_id", "page_number", "summary_text", "key_points"), ["document_id", "page_number"], "left")
    title = F.when(first_line(F.col("text")) != "", first_line(F.col("text"))).otherwise(F.format_string("Page %d", "page_number"))
    rows = rows.withColumns({"title": title, "summary_text": t.text("summary_text"), "key_points": F.coalesce("key_points", F.array().cast("array<string>"))})
    number = F.lpad(F.col("page_number").cast("string"), 2, "0")
    clean = rows.select(
        "document_id", "page_number", F.lit("clean_text").alias("chunk_type"), F.lit("clean_context").alias("retrieval_lane"), F.concat(F.lit("p"), number, F.lit("_clean_text")).alias("chunk_id"),
        F.col("title").alias("section_hint"), clean_chunk(F.col("page_number"), F.col("title"), F.col("summary_text"), F.col("key_points"), F.col("text")).alias("text"),
    )
    found = tables.islands(by_page)
    facts = tables.facts(found.withColumn("title", F.col("title")))
    facts = facts.groupBy("document_id", "page_number", "table_index").agg(F.sort_array(F.collect_list(F.struct("row", "period", tables.fact_text(facts).alias("line")))).alias("f"))
    related = found.join(facts, ["document_id", "page_number", "table_index"], "left").join(rows.select("document_id", "page_number", F.col("title").alias("page_title")), ["document_id", "page_number"])
    lines = F.array_join(F.slice(F.transform("f", lambda x: x["line"]), 1, MOST_FACTS), "\n")
    body = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n")
    text = F.concat(
        F.format_string("## Page %d Table %d\n\nContext: ", "page_number", "table_index"), F.col("page_title"),
        F.when(F.col("title") != "", F.concat(F.lit("\nTable title: "), F.col("title"))).otherwise(""),
        F.when(F.col("unit") != "", F.concat(F.lit("\nUnit: "), F.col("unit"))).otherwise(""),
        F.lit("\nType: structured_relation / markdown_table\n\n"), body,
        F.when(F.size(F.coalesce("f", F.array().cast(facts.schema["f"].dataType))) > 0, F.concat(F.lit("\n\nKPI facts:\n\n"), lines)).otherwise(""),
    )
    relation = related.select(
        "document_id", "page_number", F.lit("structured_relation").alias("chunk_type"), F.lit("relation").alias("retrieval_lane"),
        F.concat(F.lit("p"), number, F.lit("_table_"), F.lpad(F.col("table_index").cast("string"), 2, "0")).alias("chunk_id"), F.when(F.col("title") != "", F.col("title")).otherwise(F.col("page_title")).alias("section_hint"), text.alias("text"),
    )
    paged = by_page.select("document_id").distinct()
    whole = docs.join(paged, "document_id", "left_anti").select("document_id", t.strip(t.text("markdown")).alias("text")).where("text <> ''")
    whole = whole.select(
        "document_id", F.lit(None).cast("int").alias("page_number"), F.lit("clean_text").alias("chunk_type"), F.lit("clean_context").alias("retrieval_lane"), F.lit("document_clean_text").alias("chunk_id"), first_line(F.col("text")).alias("section_hint"), "text",
    )
    return clean.unionByName(relation).unionByName(whole)
