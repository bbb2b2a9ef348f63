"""Queries over sources: paragraphs, decoded texts, and what follows from pages and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions import text as t
from parchment.sources import office, pdf
from parchment.plans.tables import conversation_pages, documents, fixture, table


def text_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one text each: paragraphs and their counts."""
    c = conversation_pages(spark, sf_dir).groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return office.element_summary(office.paragraph_elements(c))


TEXT_ELEMENTS = r"""
WITH c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY 1),
p AS (SELECT conv_id, unnest(regexp_split_to_array(t, '\n\s*\n+')) AS p FROM c), s AS (SELECT conv_id, regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '') AS p FROM p)
SELECT conv_id AS document_id, 1::BIGINT AS pages, count(*) AS elements, sum(length(p))::BIGINT AS characters FROM s WHERE p <> '' GROUP BY 1"""


def useful_text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of plain characters in documents that look like language."""
    d = documents(spark, sf_dir)
    return d.select("document_id", F.size(office.useful_runs(t.text("markdown"))).cast("long").alias("runs"))


USEFUL_TEXT_RUNS = r"""
WITH r AS (SELECT doc_id AS document_id, list_transform(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z가-힣 .,:;()%/\-''"\[\]]{11,}'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS r FROM documents)
SELECT document_id, len(list_distinct(list_filter(r, lambda x: length(x) >= 10 AND len(list_distinct(string_split(x, ''))) > 3 AND length(regexp_replace(x, '[^0-9A-Za-z가-힣]', '', 'g')) >= greatest(8, length(x) * 0.35))))::BIGINT AS runs FROM r"""


def pdf_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of documents by their pages; user turns stand for images."""
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text")).alias("text"), (F.col("role") == "user").cast("int").alias("n_images"))
    return pdf.document_kind(pages)


PDF_KINDS = """
WITH p AS (SELECT conv_id AS document_id, length(trim(CASE WHEN turn % 4 = 3 THEN '' ELSE coalesce(text, '') END)) >= 30 AS f, role = 'user' AS i FROM conversations),
g AS (SELECT document_id, count(*) AS pages, count(*) FILTER (f) AS with_text, count(*) FILTER (i) AS with_images FROM p GROUP BY 1)
SELECT *, CASE WHEN with_text = 0 AND with_images > 0 THEN 'scanned' WHEN with_text = pages THEN 'digital' ELSE 'mixed' END AS pdf_kind FROM g"""

MARKS = [(1, 1, "a\n==> picture [100 x 50] intentionally omitted <==\nb\n==> picture [30 x 30] intentionally omitted <=="), (1, 2, "==> picture [10 x 10] intentionally omitted <==")]
IMAGES = [(1, 1, 7, 0.0, 90.0, 30.0, 120.0), (1, 1, 8, 0.0, 10.0, 100.0, 62.0), (1, 1, 9, 0.0, 10.0, 90.0, 60.0)]


def omitted_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left-out pictures by rank on their page."""
    marks = pdf.placeholders(fixture(spark, MARKS, "document_id int, page_number int, text string"))
    images = fixture(spark, IMAGES, "document_id int, page_number int, image_id int, x0 double, y0 double, x1 double, y1 double")
    return pdf.match_images(marks, images).select("page_number", "ordinal", "width", "image_id", "status")


OMITTED_PICTURES = "SELECT p::INT AS page_number, o::INT AS ordinal, w::INT AS width, i::INT AS image_id, s AS status FROM (VALUES (1, 1, 100, 8, 'matched'), (1, 2, 30, 9, 'size_mismatch'), (2, 1, 10, NULL, 'unmatched')) AS v(p, o, w, i, s)"


def structure_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as structure runs, grouped by neighbours of one block."""
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    runs = i.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("block_id"), F.when(F.col("l_returnflag") == "R", "H2").when(F.col("l_returnflag") == "A", "LI").otherwise("P").alias("role"), F.concat(F.lit("x"), F.col("l_linenumber").cast("string")).alias("text"))
    return pdf.run_blocks(runs).groupBy("document_id").agg(F.count("*").alias("blocks"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "markdown"))), lambda x: x["markdown"]), "|").alias("markdown"))


STRUCTURE_BLOCKS = """
WITH i AS (SELECT l_orderkey AS d, l_linenumber AS p, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, coalesce((f <> lag(f) OVER (PARTITION BY d ORDER BY p))::INT, 0) AS n FROM i), b AS (SELECT *, sum(n) OVER (PARTITION BY d ORDER BY p) AS b FROM n),
g AS (SELECT d, b, CASE any_value(f) WHEN 'R' THEN '## ' WHEN 'A' THEN '- ' ELSE '' END || string_agg('x' || p, ' ' ORDER BY p) AS m FROM b GROUP BY 1, 2)
SELECT d AS document_id, count(*) AS blocks, string_agg(m, '|' ORDER BY b) AS markdown FROM g GROUP BY 1"""


def fragment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page fragments matched to runs with the same letters, first to first."""
    from parchment.operators import layout

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("page"), F.col("o_orderpriority").alias("key"))
    left, right = o.where("id % 2 = 0").withColumnRenamed("id", "fragment"), o.where("id % 2 = 1").withColumnRenamed("id", "run")
    return layout.fragment_matches(left, right, ["page", "key"], "fragment", "run").select("fragment", F.col("run"), F.coalesce("n", F.lit(0)).alias("candidates"))


FRAGMENT_PAIRS = """
WITH o AS (SELECT o_orderkey AS id, o_custkey AS page, o_orderpriority AS key, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderkey % 2 ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey, o_orderpriority, o_orderkey % 2) AS c FROM orders)
SELECT l.id AS fragment, r.id AS run, coalesce(r.c, 0) AS candidates FROM o l LEFT JOIN o r ON l.page = r.page AND l.key = r.key AND l.n = r.n AND r.id % 2 = 1 WHERE l.id % 2 = 0"""


QUERIES = {
    "text_elements": text_elements,
    "useful_text_runs": useful_text_runs,
    "pdf_kinds": pdf_kinds,
    "omitted_pictures": omitted_pictures,
    "structure_blocks": structure_blocks,
    "fragment_pairs": fragment_pairs,
}
ORACLES = {
    "text_elements": TEXT_ELEMENTS,
    "useful_text_runs": USEFUL_TEXT_RUNS,
    "pdf_kinds": PDF_KINDS,
    "omitted_pictures": OMITTED_PICTURES,
    "structure_blocks": STRUCTURE_BLOCKS,
    "fragment_pairs": FRAGMENT_PAIRS,
}
