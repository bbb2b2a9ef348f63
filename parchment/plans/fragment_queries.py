"""Queries over positioned fragments, viewer texts, contents pages, period tables and PDF checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.operators import fragments, restructure
from parchment.plans.tables import table
from parchment.sources import pdf


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", F.col("n_nationkey").cast("string").alias("k"))


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def joined_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fragments of a line joined, with spaces between words only."""
    n = _nations(spark, sf_dir)
    return n.select("n_nationkey", fragments.joined(F.array(F.col("n_name"), F.lit("land"), F.lit(","), F.col("k"), F.lit("("), F.lit("x"), F.lit(")"))).alias("line"))


JOINED_FRAGMENTS = "SELECT n_nationkey, n_name || ' land,' || n_nationkey || '(x)' AS line FROM nation"


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of tokens four apart: two are near the mean of one row, the third isn't."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    tokens = items.withColumns({"id": rank, "cy": 4.0 * rank, "cx": F.lit(0.0)})
    return fragments.mean_rows(tokens, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "row")


TOKEN_ROWS = "SELECT l_orderkey, l_linenumber, ((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) // 2)::INT AS row FROM lineitem"


def repeated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of one text within two points are one."""
    n = _nations(spark, sf_dir)
    at = F.floor(F.col("n_nationkey") / 5) * 10 + F.col("n_nationkey") % 5 * 0.1
    tokens = n.select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("id"), _text("t", (F.col("n_nationkey") % 2).cast("string")).alias("text"), F.lit(0.0).alias("x0"), F.col("n_nationkey").cast("double").alias("y0"), at.cast("double").alias("cx"), F.lit(0.0).alias("cy"))
    return fragments.distinct_tokens(tokens, ["page"]).select("page", "id", "text")


REPEATED_TOKENS = "SELECT n_regionkey AS page, min(n_nationkey) AS id, 't' || (n_nationkey % 2) AS text FROM nation GROUP BY n_regionkey, n_nationkey % 2, n_nationkey // 5"


def period_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digit and the quarter to its right, up to 28 points off, are one label."""
    n = _nations(spark, sf_dir)
    both = F.array(F.struct((F.col("n_nationkey") * 2).alias("id"), F.lit(" 1 ").alias("text"), F.lit(0.0).alias("cx")), F.struct((F.col("n_nationkey") * 2 + 1).alias("id"), _text("Q2", (F.col("n_nationkey") % 10).cast("string")).alias("text"), (F.col("n_nationkey") * 2.0).alias("cx")))
    tokens = n.select(F.col("n_nationkey").alias("page"), F.explode(both).alias("x")).select("page", "x.*", F.lit(3.0).alias("cy"))
    return fragments.period_labels(tokens, ["page"]).select("page", "id", "label")


PERIOD_NAMES = """
SELECT n_nationkey AS page, n_nationkey * 2 AS id, CASE WHEN n_nationkey <= 14 THEN '1Q2' || (n_nationkey % 10) ELSE '1' END AS label FROM nation
UNION ALL SELECT n_nationkey, n_nationkey * 2 + 1, CASE WHEN n_nationkey > 14 THEN 'Q2' || (n_nationkey % 10) END FROM nation"""


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a page's paragraphs without noise lines and short ones, packed."""
    text = _text("12\n\nshort\n\n", F.col("n_name"), " is a land of some words\n3.5%\nand more\n \n\n2024\nSecond paragraph of a page\n\n", F.repeat(F.lit("long word "), 70))
    found = fragments.clean_blocks(text)
    return _nations(spark, sf_dir).select("n_nationkey", F.posexplode(found).alias("block", "text"))


PAGE_BLOCKS = """
SELECT n_nationkey, 0 AS block, n_name || ' is a land of some words' || chr(10) || 'and more' || chr(10) || chr(10) || 'Second paragraph of a page' AS text FROM nation
UNION ALL SELECT n_nationkey, 1, rtrim(repeat('long word ', 70)) FROM nation"""


def heading_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with the headings since the table before."""
    n = _nations(spark, sf_dir)
    groups = n.select(F.col("n_regionkey").alias("document_id"), F.col("n_nationkey").alias("position"), F.when(F.col("n_nationkey") % 3 == 0, "table").otherwise("heading").alias("kind"), F.array("n_name", F.lit("same")).alias("texts"))
    found = fragments.waiting_headings(groups)
    return found.select("document_id", F.col("table_index").cast("long").alias("table_index"), "position", F.array_join("headings", ",").alias("headings"))


HEADING_GROUPS = """
WITH g AS (SELECT n_regionkey AS d, n_nationkey AS p, n_nationkey % 3 = 0 AS t, n_name, coalesce(sum((n_nationkey % 3 = 0)::INT) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM nation),
h AS (SELECT *, row_number() OVER (PARTITION BY d, part, t ORDER BY p) AS k FROM g)
SELECT d AS document_id, part::BIGINT AS table_index, max(p) FILTER (t) AS position, coalesce(string_agg(CASE WHEN k = 1 THEN n_name || ',same' ELSE n_name END, ',' ORDER BY p) FILTER (NOT t), '') AS headings FROM h GROUP BY 1, 2"""


def viewer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown for a viewer, a text without parentheses at its beginning, and the
    tables that another one lacks."""
    n = _nations(spark, sf_dir)
    text = _text("keep ", F.col("n_name"), "\n**[Financial Fact Table]** x\n(Unit: won)\n(Unit: other)\n| |\n\nEnd of document\n==> picture [3 x 4] intentionally omitted <== tail\n- [row_path] a: 1Q24=1")
    lacking = restructure.missing_tables(_text("has |", F.col("n_name"), " | b"), F.array(_text("| ", F.lower("n_name"), " |"), _text("|", F.col("k"), "x|")))
    return n.select("n_nationkey", restructure.viewer_text(text).alias("viewer"), restructure.leading_parentheses(_text(" (a (b)) (c) ", F.col("n_name"), " (d)")).alias("plain"), F.array_join(lacking, ";").alias("lacking"))


VIEWER_TEXTS = "SELECT n_nationkey, 'keep ' || n_name || chr(10) || '(Unit: other)' || chr(10) || 'tail' AS viewer, n_name || ' (d)' AS plain, '|' || n_nationkey || 'x|' AS lacking FROM nation"


def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents pages put in order, without the line that repeats on all pages."""
    n = _nations(spark, sf_dir)
    text = _text("Contents\nAppendix\nKey highlights\nOutlook 전망\nBusiness 사업\nAnnual report of ", F.col("n_name"), "\n03\n12\n25\n40")
    pages = n.select(F.col("n_nationkey").alias("document_id"), F.lit(1).alias("page_number"), text.alias("text"))
    return restructure.contents(pages, headers=["Annual report of"]).select("document_id", "text", "n_rows")


CONTENTS_PAGES = """
SELECT n_nationkey AS document_id, array_to_string(['Contents', '', '- Key highlights ..... 03', '- Business 사업 ..... 12', '- Outlook 전망 ..... 25', '- Appendix ..... 40'], chr(10)) AS text, 4 AS n_rows FROM nation"""


def period_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables under four periods as facts by row path."""
    n = _nations(spark, sf_dir)
    text = _text("| Plan | | | | |\n| item | 2021 | 2022 | 2023 | 2024 |\n| 매출<br>Europe<br>Compact | 1<br>2<br>", F.col("k"), " | 4<br>5<br>6 | 7<br>8<br>9 | 10<br>11<br>12 |\n| note | a | b | c | d |")
    pages = n.select(F.col("n_nationkey").alias("document_id"), F.lit(1).alias("page_number"), text.alias("text"))
    facts = restructure.rendered_facts(restructure.financial(pages).select("document_id", "page_number", "text"))
    return facts.select("document_id", F.array_join("row_path", " > ").alias("path"), "period", "value")


PERIOD_TABLES = """
WITH f AS (SELECT n_nationkey, unnest(['매출', '매출 > Europe', '매출 > Europe > Compact', '매출 > note']) AS path, unnest([['1', '4', '7', '10'], ['2', '5', '8', '11'], [n_nationkey::VARCHAR, '6', '9', '12'], ['a', 'b', 'c', 'd']]) AS v FROM nation)
SELECT n_nationkey AS document_id, path, unnest(['2021', '2022', '2023', '2024']) AS period, unnest(v) AS value FROM f"""


def pdf_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions, tables that count, the text that is used, and the strategy of a producer."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    caption = F.when(k % 3 == 0, _text("Figure ", k.cast("string"), "\nbelow")).when(k % 3 == 1, _text(" 그림 1 ", F.col("c_name"))).otherwise(F.col("c_name"))
    cells = F.transform(F.sequence(F.lit(1), (k % 6 + 1).cast("int")), lambda i: F.transform(F.sequence(F.lit(1), (k % 5 + 1).cast("int")), lambda j: F.when((i * j) % (k % 4 + 1) == 0, F.lit("x")).otherwise(" ")))
    first = F.when(k % 2 == 0, F.repeat(F.col("c_name"), 5)).otherwise(F.col("c_name"))
    return c.select("c_custkey", pdf.is_caption(caption).alias("caption"), pdf.keep_table((k % 10 / 10).cast("double"), cells).alias("counts"), pdf.first_usable(first, F.lit("last")).alias("used"), pdf.strategy(F.when(k % 2 == 0, "Microsoft PowerPoint")).alias("strategy"))


PDF_CHECKS = """
WITH t AS (SELECT *, c_custkey % 6 + 1 AS h, c_custkey % 5 + 1 AS w, (c_custkey % 10) / 10.0::DOUBLE AS share FROM customer),
f AS (SELECT t.*, (SELECT count(*) FROM range(1, h + 1) a(i), range(1, w + 1) b(j) WHERE (i * j) % (c_custkey % 4 + 1) = 0) AS filled FROM t)
SELECT c_custkey, c_custkey % 3 < 2 AS caption, h >= 2 AND w >= 2 AND NOT (share > 0.6 AND h * w > 20) AND filled >= 0.15 * h * w AS counts,
  CASE WHEN c_custkey % 2 = 0 AND length(c_name) * 5 >= 50 THEN repeat(c_name, 5) ELSE 'last' END AS used, CASE WHEN c_custkey % 2 = 0 THEN 'structtree' ELSE 'pymupdf4llm' END AS strategy FROM f"""


QUERIES = {
    "joined_fragments": joined_fragments,
    "token_rows": token_rows,
    "repeated_tokens": repeated_tokens,
    "period_names": period_names,
    "page_blocks": page_blocks,
    "heading_groups": heading_groups,
    "viewer_texts": viewer_texts,
    "contents_pages": contents_pages,
    "period_tables": period_tables,
    "pdf_checks": pdf_checks,
}
ORACLES = {
    "joined_fragments": JOINED_FRAGMENTS,
    "token_rows": TOKEN_ROWS,
    "repeated_tokens": REPEATED_TOKENS,
    "period_names": PERIOD_NAMES,
    "page_blocks": PAGE_BLOCKS,
    "heading_groups": HEADING_GROUPS,
    "viewer_texts": VIEWER_TEXTS,
    "contents_pages": CONTENTS_PAGES,
    "period_tables": PERIOD_TABLES,
    "pdf_checks": PDF_CHECKS,
}
