"""Queries over markdown tables, facts and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions.storage import written
from parchment.operators import chunks, pages, tables
from parchment.plans.page_queries import _MARKDOWN, page_markdown
from parchment.plans.tables import conversation_pages, documents, fixture, table, values

UNIT = "Unit: orders"


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, page_number, text): each order year as a page of a KPI table, one row per
    priority and one column per quarter, with a title behind and a unit."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.col("o_orderpriority").alias("m"))
    wide = o.groupBy("y", "m").pivot("q", [1, 2, 3, 4]).count()
    rows = F.sort_array(F.collect_list(F.array("m", *[F.coalesce(F.format_number(F.col(str(q)), 0), F.lit("-")) for q in (1, 2, 3, 4)])))
    header = F.array(F.lit("Priority"), *[F.concat(F.lit(f"{q}Q"), F.substring(F.col("y").cast("string"), 3, 2)) for q in (1, 2, 3, 4)])
    page = F.concat_ws("\n", F.lit("Orders of the year"), F.lit(""), tables.render(header, F.col("rows")), F.lit(""), F.lit("KPI orders by quarter"), F.lit(f"({UNIT})"))
    return wide.groupBy("y").agg(rows.alias("rows")).select(F.lit(1).alias("document_id"), F.col("y").alias("page_number"), page.alias("text"))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts read back from rendered tables."""
    found = tables.facts(tables.islands(pages.split(pages.render(order_tables(spark, sf_dir)))))
    return found.select("page_number", "metric", "period", F.regexp_replace("value", ",", "").cast("long").alias("value"), "title", "unit")


ORDER_FACTS = f"""
SELECT year(o_orderdate)::INT AS page_number, o_orderpriority AS metric, quarter(o_orderdate) || 'Q' || right(year(o_orderdate)::VARCHAR, 2) AS period, count(*) AS value,
 'KPI orders by quarter' AS title, '{UNIT}' AS unit FROM orders GROUP BY ALL"""


def order_fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose facts cover enough rows and periods."""
    found = tables.facts(tables.islands(order_tables(spark, sf_dir)))
    return tables.coverage(found, 4).select("page_number", "n_rows", "n_full")


ORDER_FACT_COVERAGE = """
WITH r AS (SELECT year(o_orderdate)::INT AS page_number, o_orderpriority, count(DISTINCT quarter(o_orderdate)) AS n FROM orders GROUP BY 1, 2)
SELECT page_number, count(*) AS n_rows, count(*) FILTER (n >= 4) AS n_full FROM r GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (n >= 4) >= 0.6 * count(*)"""


def order_fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as lines of a relation chunk."""
    found = tables.facts(tables.islands(order_tables(spark, sf_dir)))
    return found.select(tables.fact_text(found).alias("fact"))


ORDER_FACT_LINES = f"""
SELECT '- Page ' || year(o_orderdate) || ' Table 1: KPI orders by quarter / ' || o_orderpriority || ' / ' || quarter(o_orderdate) || 'Q' || right(year(o_orderdate)::VARCHAR, 2) || ' = '
  || format('{{:,}}', count(*)) || ' ({UNIT})' AS fact FROM orders GROUP BY year(o_orderdate), quarter(o_orderdate), o_orderpriority"""

TABLES = [
    (1, "Quarterly results\n| Item | 1Q25 | 2Q25 | Note |\n|---|:--:|---|---|\n| Revenue | 1,200 | 1,350.5 | ok |\n| Margin | 12% | −3 | x |\n| 2024 | 1 | 2 | - |\nsome text\n손익계산서 요약\n(단위: 백만원)"),
    (2, "| only one row |\ntext\n\n| a | b |\n| c \\| d | e |\n| f |"),
    (3, "no table here\n- Page: 3"),
    (4, "# Page 9\nNear line\n| Metric | FY2023 | 2024 |\n| -- | -- | -- |\n| Users | 10 | n/a |\n| | 5 | 6 |"),
    (5, None),
    (6, "Sales table\n| m | '24 YTD | 하반기 |\n| Net | +1.5 | 7 |"),
]


def table_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of awkward pages with title, unit, widths and facts."""
    found = tables.islands(fixture(spark, TABLES, "page_number int, text string").withColumn("document_id", F.lit(1)))
    f = tables.facts(found).groupBy("page_number", "table_index").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "metric", "period", "value"))), ";").alias("facts"))
    return found.join(f, ["page_number", "table_index"], "left").select("page_number", "table_index", "title", "unit", F.size("rows").alias("n_rows"), tables.modal_width(F.col("rows")).alias("width"), F.coalesce("facts", F.lit("")).alias("facts"))


#: What the reading of TABLES must give, worked out by hand.
CONTEXTS = [
    (1, 1, "손익계산서 요약", "단위: 백만원", 5, 4, "Margin/1Q25/12%;Margin/2Q25/−3;Revenue/1Q25/1,200;Revenue/2Q25/1,350.5"),
    (2, 1, "text", "", 3, 3, ""),
    (4, 1, "Near line", "", 4, 3, ""),
    (6, 1, "Sales table", "", 2, 3, "Net/'24YTD/+1.5;Net/하반기/7"),
]
TABLE_CONTEXTS = f"SELECT page_number::INT AS page_number, table_index::INT AS table_index, title, unit, n_rows::INT AS n_rows, width::INT AS width, facts FROM (VALUES {values(CONTEXTS)}) AS v(page_number, table_index, title, unit, n_rows, width, facts)"

STUBS = [(1, "| 1Q25 | 2Q25 |\n| Revenue | 5 | 6 |\n| Cost | 1 | 2 |"), (2, "| a | b |\n| x | 1 | 2 |"), (3, "| Name | 2024 |\n| x | 1 |"), (4, "| 2024 |\n| 7 | 8 |")]


def stub_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that lack the cell over the labels get one."""
    rows = F.transform(F.split("text", "\n"), tables.cells)
    return fixture(spark, STUBS, "id int, text string").select("id", F.array_join(F.get(tables.with_stub_header(rows), 0), "|").alias("header"))


STUB_HEADERS = "SELECT id::INT AS id, header FROM (VALUES (1, '|1Q25|2Q25'), (2, 'a|b'), (3, 'Name|2024'), (4, '2024')) AS v(id, header)"

HTML = [(1, "<table><tr><th>A</th><th>B<br>C</th></tr><tr><td> 1 </td><td><b>2</b></td></tr></table>"), (2, "<p>none</p>"), (3, "<TABLE><TR><TD colspan=2>x</TD></TR></TABLE>")]


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML tables as markdown."""
    rows = tables.from_html(F.col("html"))
    return fixture(spark, HTML, "id int, html string").select("id", F.explode(rows).alias("r")).select("id", F.array_join("r", "|").alias("cells"))


HTML_TABLES = "SELECT id::INT AS id, cells FROM (VALUES (1, 'A|B C'), (1, '1|2'), (3, 'x')) AS v(id, cells)"


def packed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several values in one cell, zipped with the periods."""
    raw = fixture(spark, [(1, "| Revenue | 1<br>2<br/>3 | 4 |"), (2, "| Cost | 5 |")], "id int, line string")
    rows = raw.select("id", F.explode(tables.packed_rows(F.array(tables.cells(F.col("line"))))).alias("r"))
    return rows.select("id", "r.label", F.posexplode("r.values").alias("i", "value"))


PACKED_CELLS = "SELECT id::INT AS id, label, i::INT AS i, value FROM (VALUES (1, 'Revenue', 0, '1'), (1, 'Revenue', 1, '2'), (1, 'Revenue', 2, '3'), (1, 'Revenue', 3, '4'), (2, 'Cost', 0, '5')) AS v(id, label, i, value)"


def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """headings of the pages table."""
    return pages.sections(page_markdown(spark, sf_dir)).select("document_id", F.col("line_number").cast("long").alias("line_number"), F.col("level").cast("long").alias("level"), "title")


def rule_based_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-based chunks of the pages' markdown and of all documents."""
    found = chunks.chunk(page_markdown(spark, sf_dir)).unionByName(chunks.chunk(documents(spark, sf_dir).withColumn("document_id", F.col("document_id") + 1_000_000_000)))
    return found.select("document_id", "chunk_index", "char_count", "section_hint", F.sha2("text", 256).alias("text_sha256"))


def semantic_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic chunks of all documents."""
    return chunks.chunk(documents(spark, sf_dir), "semantic").select("document_id", "chunk_index", "char_count", F.sha2("text", 256).alias("text_sha256"))


def chunk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk metrics by strategy and what the semantic chunks differ by."""
    d = documents(spark, sf_dir)
    both = chunks.chunk(d).unionByName(chunks.chunk(d, "semantic"))
    # Written, so that documents are chunked once for both sides.
    found = written(chunks.metrics(both), "metrics")
    return found.join(chunks.compare_metrics(found), "document_id")


def stride_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of fixed windows of 900 characters, 150 into each other."""
    d = documents(spark, sf_dir).where("length(markdown) > 0")
    windows = F.explode(F.sequence(F.lit(0), F.length("markdown") - 1, F.lit(750)))
    rows = d.select("document_id", "markdown", windows.alias("at")).select("document_id", F.lit("stride").alias("strategy"), F.length(F.substring(F.col("markdown"), F.col("at") + 1, F.lit(900))).alias("char_count"))
    return chunks.metrics(rows).drop("strategy")


STRIDE_CHUNKS = """
WITH s AS (SELECT doc_id AS document_id, length(substr(text, "at" + 1, 900)) AS n FROM (SELECT doc_id, text, unnest(range(0, length(text), 750)) AS "at" FROM documents))
SELECT document_id, count(*) AS chunk_count, sum(n)::BIGINT AS total_characters, round(avg(n), 2) AS average_characters, min(n)::INT AS min_characters, max(n)::INT AS max_characters FROM s GROUP BY 1"""


def hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations' turns in two lanes under one numbering."""
    turns = conversation_pages(spark, sf_dir).withColumn("chunk_index", F.col("page_number") - 1)
    relation = turns.where("page_number % 2 = 0").withColumn("text", F.concat("text", F.lit("!")))
    return chunks.hybrid([("legacy", turns), ("relation", relation)]).select("document_id", "retrieval_lane", "chunk_index", "chunk_id", "char_count")


HYBRID_UNION = """
WITH u AS (SELECT conv_id, 0 AS lane, 'legacy' AS name, turn, trim(text) AS text FROM conversations UNION ALL SELECT conv_id, 1, 'relation', turn, trim(text || chr(33)) FROM conversations WHERE turn % 2 = 1)
SELECT conv_id AS document_id, name AS retrieval_lane, (row_number() OVER (PARTITION BY conv_id ORDER BY lane, turn, text) - 1)::INT AS chunk_index, 'hybrid_' || name || '_' || turn AS chunk_id, length(text)::INT AS char_count FROM u WHERE text <> ''"""

QUERIES = {
    "order_facts": order_facts,
    "order_fact_coverage": order_fact_coverage,
    "order_fact_lines": order_fact_lines,
    "table_contexts": table_contexts,
    "stub_headers": stub_headers,
    "html_tables": html_tables,
    "packed_cells": packed_cells,
    "section_titles": section_titles,
    "rule_based_chunks": rule_based_chunks,
    "semantic_chunks": semantic_chunk_rows,
    "chunk_metrics": chunk_metrics,
    "stride_chunks": stride_chunks,
    "hybrid_union": hybrid_union,
}
ORACLES = {
    "order_facts": ORDER_FACTS,
    "order_fact_coverage": ORDER_FACT_COVERAGE,
    "order_fact_lines": ORDER_FACT_LINES,
    "table_contexts": TABLE_CONTEXTS,
    "stub_headers": STUB_HEADERS,
    "html_tables": HTML_TABLES,
    "packed_cells": PACKED_CELLS,
    "section_titles": rf"""WITH {_MARKDOWN}, l AS (SELECT document_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS i FROM m)
SELECT document_id, i::BIGINT AS line_number, length(regexp_extract(line, '^(#{{1,6}})\s', 1))::BIGINT AS level, regexp_extract(line, '^#{{1,6}}\s+(.*\S)\s*$', 1) AS title FROM l WHERE regexp_matches(line, '^#{{1,6}}\s+(.*\S)\s*$')""",
    "stride_chunks": STRIDE_CHUNKS,
    "hybrid_union": HYBRID_UNION,
}
