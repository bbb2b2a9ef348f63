"""Queries over lines and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.operators import blocks
from parchment.plans.tables import documents, fixture


def line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents by role."""
    rows = blocks.classified(blocks.normalised_lines(documents(spark, sf_dir)))
    return rows.groupBy("document_id").agg(
        F.count("*").alias("n_lines"), *[F.count_if(F.col("block_type") == k).alias(f"n_{k}") for k in ("title", "list", "paragraph", "unknown")], F.count_if("is_label").alias("n_labels"), F.count_if("is_value").alias("n_values"), F.sum("indent").alias("indent")
    )


def _sql(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern}')"


_ITEM = r"^(?:[-*•·※]\s*|[①-⑳]\s*|[ㄱ-ㅎ][.)]\s*|[가-하][.)]\s*|(?:\d+|[A-Za-z])[.)]\s*\D)"


def _value(c: str) -> str:
    return f"({_sql(c, blocks.DATE_VALUE)} OR {_sql(c, blocks.NUMERIC_VALUE)} OR (regexp_matches({c}, '\\d') AND length({c}) <= 24))"


def _words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '\\S+'))"


LINE_ROLES = rf"""
WITH r AS (SELECT doc_id AS document_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents),
l AS (SELECT document_id, trim(regexp_replace(regexp_replace(raw, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '[ \t]{{2,}}', ' ', 'g'), ' ' || chr(9)) AS c, length(regexp_extract(raw, '^[ \t]*')) AS indent FROM r),
k AS (SELECT *, CASE WHEN regexp_matches(c, '^\S(\s+\S)+$') THEN regexp_replace(c, '\s+', '', 'g') ELSE c END AS n FROM l WHERE c <> '' AND NOT (length(c) < 2 AND c NOT IN ('-', '*', '•', '·', '※') AND NOT regexp_matches(c, '^\d+$'))),
f AS (SELECT *, {_sql("c", _ITEM)} AS item, {_value("c")} AS val,
   regexp_matches(c, '^(?:\d+|[가-하])[.)](?:\s*\D.*)?$') OR (length(c) <= 32 AND NOT {_sql("c", _ITEM)} AND NOT {_value("c")} AND NOT {_sql("c", blocks.TERMINAL)} AND {_words("c")} <= 4) AS title,
   NOT {_sql("n", _ITEM)} AND NOT {_value("n")} AND length(n) <= 24 AND {_words("n")} <= 3 AS lab FROM k)
SELECT document_id, count(*) AS n_lines, count(*) FILTER (title) AS n_title, count(*) FILTER (NOT title AND item) AS n_list,
  count(*) FILTER (NOT title AND NOT item AND NOT regexp_matches(c, '^[^\pL\pN_]+$')) AS n_paragraph, count(*) FILTER (NOT title AND NOT item AND regexp_matches(c, '^[^\pL\pN_]+$')) AS n_unknown,
  count(*) FILTER (lab) AS n_labels, count(*) FILTER (val) AS n_values, sum(indent)::BIGINT AS indent FROM f GROUP BY 1"""

REPORT = (
    "현황\n"
    "개최일자\n장소\n2024-03-05\n25\n"
    "긴 설명이 이어지는 문단으로 서른두 글자를 넘기도록 충분히 길게 적은 첫 줄이며\n다음 줄로 이어집니다.\n"
    "1. 첫째 항목\n"
    "- 사과\n- 배\n"
    "구분\n1월\n구분\n"
    "\fA short title\nThis is a long closing paragraph of text that ends with a full stop, and nothing follows.\n***"
)


def report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of a small report."""
    raw = fixture(spark, [(1, REPORT)], "document_id int, markdown string")
    found = blocks.blocks(blocks.classified(blocks.normalised_lines(raw)))
    return found.select("block_index", "block.type", "block.section", "block.page", "block.line_start", "block.line_end", "block.chunk", "block.text")


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block counts, unknown ratio and chunks of every document."""
    found = blocks.blocks(blocks.classified_documents(documents(spark, sf_dir)))
    count = lambda k: F.count_if(F.col("block.type") == k)
    totals = found.groupBy("document_id").agg(
        F.count("*").alias("block_count"), count("title").alias("titles"), count("list").alias("lists"), count("paragraph").alias("paragraphs"), count("kv_table").alias("kv_table_count"), F.round(count("unknown") / F.count("*"), 4).alias("unknown_ratio")
    )
    sizes = blocks.chunks(found).groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.max(F.length("text")).alias("longest_chunk"))
    return totals.join(sizes, "document_id")


QUERIES = {"line_roles": line_roles, "report_blocks": report_blocks, "document_blocks": document_blocks}
ORACLES = {"line_roles": LINE_ROLES}
