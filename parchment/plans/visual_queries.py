"""Queries over images, marked content, structure tables, drawings and viewer lookups.

Orders are pages, their line items what a reader finds on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.operators import structures, visual
from parchment.plans.tables import table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items; of those with equal keys the one that stands first in the table's files, as in SQL. Which of
    them dropDuplicates keeps would hang on the order in which tasks end."""
    rows = table(spark, sf_dir, "lineitem").select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("__file", "__row")
    first = rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__file", "__row")
    return first.withColumns({"document_id": F.col("l_orderkey"), "page_number": F.lit(1), "number": F.col("l_linenumber")})


def _box() -> Column:
    x, y = F.col("l_suppkey") % 50, F.col("l_partkey") % 90 - 5
    return F.struct(x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.col("l_quantity")).cast("double").alias("x1"), (y + F.col("l_linenumber")).cast("double").alias("y1"))


def _streams(items: DataFrame) -> DataFrame:
    """A content stream for each order: an image for each line item, in marked content of number mod 3, and
    one that isn't the page's."""
    n = F.col("number").cast("string")
    draw = F.concat(F.lit("/P <</MCID "), (F.col("number") % 3).cast("string"), F.lit(">> BDC /Span BMC q /Im"), n, F.lit(" Do Q EMC EMC /Other Do"))
    rows = F.array_sort(F.collect_list(F.struct("number", draw.alias("d"))))
    return items.groupBy("document_id", "page_number").agg(F.array_join(F.transform(rows, lambda x: x["d"]), "\n").alias("stream"), F.collect_set(F.concat(F.lit("Im"), n)).alias("image_names"))


def _runs(items: DataFrame) -> DataFrame:
    return items.select("document_id", "page_number", (F.col("number") % 3).cast("int").alias("mcid"), F.col("number").alias("position"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.lit("P").alias("block_role"), F.lit("Span").alias("leaf_role"))


_ITEMS = "i AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem)"


def image_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with the text of the marked content that they are drawn in."""
    items = _items(spark, sf_dir)
    images = items.select("document_id", "page_number", "number", _box().alias("box"))
    found = visual.image_elements(images, visual.image_draws(_streams(items)), _runs(items), 1)
    return found.select("document_id", "element_id", "image_name", "mcid", "text")


IMAGE_TEXTS = f"""
WITH {_ITEMS}, t AS (SELECT l_orderkey, l_linenumber % 3 AS m, l_returnflag || l_linestatus AS s, min(l_linenumber) AS p FROM i GROUP BY ALL),
j AS (SELECT l_orderkey, m, string_agg(s, ' ' ORDER BY p) AS text FROM t GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM i)
SELECT n.l_orderkey AS document_id, 'p1-e' || k AS element_id, 'Im' || l_linenumber AS image_name, (l_linenumber % 3)::INT AS mcid, j.text FROM n JOIN j ON j.l_orderkey = n.l_orderkey AND j.m = l_linenumber % 3"""


def run_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure runs with the box around the images of their marked content."""
    items = _items(spark, sf_dir)
    images = items.select("document_id", "page_number", "number", _box().alias("box"))
    runs = items.groupBy("document_id", "page_number").agg(F.lit(0).alias("run_id"), F.lit(" a  run ").alias("text"), F.array(F.lit(0), F.lit(1), F.lit(1), F.lit(7)).alias("mcids"))
    found = visual.run_tokens(runs, images, visual.image_draws(_streams(items)), 60)
    return found.select("document_id", "text", "box.x0", "box.y0", "box.x1", "box.y1")


RUN_BOXES = f"""
WITH {_ITEMS}, b AS (SELECT l_orderkey, l_suppkey % 50 AS x0, l_partkey % 90 - 5 AS y0, l_suppkey % 50 + l_quantity AS x1, l_partkey % 90 - 5 + l_linenumber AS y1, l_linenumber % 3 AS m FROM i)
SELECT l_orderkey AS document_id, 'a run' AS text, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1 FROM b WHERE m < 2 AND y0 BETWEEN 0 AND 60 GROUP BY 1"""


def structure_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each region, a table in it with a row of two cells for each nation."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    schema = "document_id bigint, node_id bigint, parent_id bigint, position int, role string, page_number bigint, text string"
    rows = [
        r.selectExpr("r_regionkey", "0", "NULL", "0", "'Document'", "7", "NULL"),
        r.selectExpr("r_regionkey", "1", "0", "0", "'Table'", "r_regionkey + 2", "NULL"),
        r.selectExpr("r_regionkey", "2", "1", "0", "'THead'", "NULL", "NULL"),
        r.selectExpr("r_regionkey", "3", "2", "0", "'TR'", "NULL", "NULL"),
        r.selectExpr("r_regionkey", "4", "3", "0", "'TH'", "NULL", "r_name"),
        n.selectExpr("n_regionkey", "100 + 10 * n_nationkey", "1", "n_nationkey + 1", "'TR'", "NULL", "NULL"),
        n.selectExpr("n_regionkey", "101 + 10 * n_nationkey", "100 + 10 * n_nationkey", "0", "'TD'", "NULL", "n_name"),
        n.selectExpr("n_regionkey", "102 + 10 * n_nationkey", "100 + 10 * n_nationkey", "1", "'TD'", "NULL", "'key'"),
        n.selectExpr("n_regionkey", "103 + 10 * n_nationkey", "102 + 10 * n_nationkey", "0", "'Span'", "NULL", "' ' || CAST(n_nationkey AS STRING)"),
    ]
    nodes = rows[0]
    for x in rows[1:]:
        nodes = nodes.union(x)
    names = [f.split() for f in schema.split(", ")]
    nodes = nodes.toDF(*(f[0] for f in names)).select(*(F.col(f[0]).cast(f[1]) for f in names))
    found = visual.struct_tables(nodes).withColumn("rows", visual.padded(F.col("rows")))
    return found.select("document_id", "table_id", "page_number", F.array_join(F.transform("rows", lambda x: F.array_join(x, "|")), ";").alias("cells"))


STRUCTURE_TABLES = """
SELECT r_regionkey::BIGINT AS document_id, 1::BIGINT AS table_id, (r_regionkey + 2)::BIGINT AS page_number,
  r_name || '|;' || (SELECT string_agg(n_name || '|key ' || n_nationkey, ';' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS cells FROM region"""


def citation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tables from citations of suppliers: periods, two series, one of them twice, and a short one."""
    s = table(spark, sf_dir, "supplier")
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = F.concat(F.lit("A | B | C | D\n- first:  1 | "), key, F.lit(" | 3 | 4\n**second: 5 | 6 | 7 | "), nation, F.lit("\n**second: 5 | 6 | 7 | "), nation, F.lit("\nshort: 1 | 2\nno row"))
    found = visual.citation_table(F.when(F.col("s_suppkey") % 3 == 0, F.lit(" ")).otherwise(text), F.when(F.col("s_suppkey") % 2 == 0, text))
    return s.select("s_suppkey", found.alias("x")).select("s_suppkey", "x.markdown", "x.n_rows", "x.n_columns")


CITATION_TABLES = """
SELECT s_suppkey, CASE WHEN ok THEN '| 항목 | A | B | C | D |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || '| - first | 1 | ' || s_suppkey || ' | 3 | 4 |' || chr(10) || '| second | 5 | 6 | 7 | ' || s_nationkey || ' |' ELSE '' END AS markdown,
  CASE WHEN ok THEN 2 ELSE 0 END AS n_rows, CASE WHEN ok THEN 5 ELSE 0 END AS n_columns
FROM (SELECT *, s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0 AS ok FROM supplier)"""


def drawing_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each drawing of a page is, and the page's largest fill."""
    d = _items(spark, sf_dir)
    part = lambda c, n: (F.col(c) % n / n).cast("double")
    colour = F.when(F.col("l_linenumber") != 4, F.array(part("l_partkey", 7) + F.lit(0.14), part("l_suppkey", 3), part("l_linenumber", 5)))
    flat = F.struct(F.lit(0.0).alias("x0"), F.lit(1.0).alias("y0"), F.col("l_quantity").cast("double").alias("x1"), F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(1.0 + F.col("l_linenumber")).alias("y1"))
    rows = d.select("document_id", "number", flat.alias("box"), colour.alias("fill"), F.lit(49.0).alias("page_width"), F.lit(3.5).alias("page_height"))
    rows = rows.withColumns({"line": visual.is_horizontal_line("box", F.col("fill"), 20), "orange": visual.is_orange(F.col("fill")), "white": visual.is_white(F.col("fill")), "gray": visual.is_key_gray(F.col("fill"))})
    largest = visual.largest_fill(rows, ["document_id"]).select("document_id", ((F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0"))).alias("fill_area"))
    counts = rows.groupBy("document_id").agg(*(F.count_if(c).alias(c) for c in ("line", "orange", "white", "gray")))
    return counts.join(largest, "document_id", "left")


DRAWING_KINDS = f"""
WITH {_ITEMS}, c AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS x1, CASE WHEN l_linenumber % 2 = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + l_linenumber END AS y1, l_linenumber <> 4 AS f,
  (l_partkey % 7) / 7.0::DOUBLE + 0.14::DOUBLE AS r, (l_suppkey % 3) / 3.0::DOUBLE AS g, (l_linenumber % 5) / 5.0::DOUBLE AS b FROM i),
d AS (SELECT *, f AND x1 >= 20 AND y1 - 1 <= 0.01 AS line, f AND r > 0.85 AND g BETWEEN 0.35 AND 0.65 AND b < 0.25 AS orange, f AND r > 0.96 AND g > 0.96 AND b > 0.96 AS white, f AND abs(r - g) < 0.03 AND abs(g - b) < 0.03 AND r BETWEEN 0.70 AND 0.97 AS gray FROM c)
SELECT l_orderkey AS document_id, count(*) FILTER (line) AS line, count(*) FILTER (orange) AS orange, count(*) FILTER (white) AS white, count(*) FILTER (gray) AS gray,
  max(x1 * (y1 - 1)) FILTER (f AND NOT white AND NOT (x1 > 49 * 0.95 AND y1 - 1 > 3.5 * 0.95)) AS fill_area
FROM d GROUP BY 1"""


def page_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with how many text blocks, image boxes and table boxes they have."""
    items = _items(spark, sf_dir).withColumn("box", _box())
    pages = items.select("document_id", "page_number", F.lit(50.0).alias("width"), F.lit(90.0).alias("height")).distinct()
    blocks = items.select("document_id", "page_number", F.col("number").alias("block_index"), F.when(F.col("number") == 2, F.lit(" \r ")).otherwise(F.concat("l_returnflag", "l_linestatus")).alias("text"), "box")
    found = visual.page_contexts(pages, blocks, items.where("number % 3 = 0").select("document_id", "page_number", "box"), items.where("number > 5").select("document_id", "page_number", "box"))
    return found.select("document_id", F.array_join(F.transform("text_blocks", lambda x: x["text"]), ",").alias("texts"), F.size("image_boxes").alias("n_images"), F.size("table_boxes").alias("n_tables"))


PAGE_LAYOUTS = f"""
WITH {_ITEMS} SELECT l_orderkey AS document_id, coalesce(string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_linenumber) FILTER (l_linenumber <> 2), '') AS texts, count(*) FILTER (l_linenumber % 3 = 0)::INT AS n_images, count(*) FILTER (l_linenumber > 5)::INT AS n_tables FROM i GROUP BY 1"""


def element_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of one element of each order, pages before asset pages, and a box from its text."""
    items = _items(spark, sf_dir).withColumn("box", _box())
    rows = items.select("document_id", F.when(F.col("number") % 2 == 0, "pages").otherwise("asset_pages").alias("collection"), F.lit(0).alias("page_index"), F.col("number").alias("page_number"), F.col("number").alias("element_order"), F.when(F.col("l_linenumber") > 1, F.lit(" p1-e1 ")).otherwise("other").alias("element_id"), F.when(F.col("number") != 4, F.col("box")).alias("box"))
    found = visual.element_box(rows, "p1-e1")
    text = F.concat_ws(", ", F.col("box.x0").cast("int"), F.col("box.y0").cast("int"), F.col("box.x1").cast("int"), F.when(F.col("page_number") != 3, F.col("box.y1").cast("int").cast("string")).otherwise("x"))
    return found.select("document_id", "page_number", F.col("box.x1").alias("x1"), F.element_at(visual.preview_box(text), 3).alias("preview_x1"))


ELEMENT_BOXES = f"""
WITH {_ITEMS}, e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber % 2 <> 0)::INT, l_linenumber) AS n, (l_suppkey % 50 + l_quantity)::DOUBLE AS x FROM i WHERE l_linenumber > 1)
SELECT l_orderkey AS document_id, l_linenumber AS page_number, CASE WHEN l_linenumber <> 4 THEN x END AS x1, CASE WHEN l_linenumber NOT IN (3, 4) THEN floor(x) END AS preview_x1 FROM e WHERE n = 1"""


def indexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that each customer's mode chooses, empty ones left out."""
    c = table(spark, sf_dir, "customer")
    kind = "array<struct<strategy:string,text:string,chunk_index:int,char_count:int>>"
    one = lambda name, text: F.struct(F.lit(name).alias("strategy"), F.col(text).alias("text"), F.lit(0).alias("chunk_index"), F.lit(0).alias("char_count"))
    chunks = lambda name: F.array(one(name, "c_name"), one(name, "c_mktsegment").withField("text", F.lit("  ")), one(None, "c_mktsegment")).cast(kind)
    k = F.col("c_custkey") % 4
    mode = F.when(k == 0, "llm_ready").when(k == 1, "").when(k == 2, "semantic").otherwise("hybrid")
    found = visual.chosen_chunks(mode, F.when(F.col("c_custkey") % 8 < 4, chunks("h")), chunks("l"), chunks("s"))
    return c.select("c_custkey", F.explode(found).alias("x")).select("c_custkey", "x.*")


INDEXED_CHUNKS = """
WITH m AS (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'l' WHEN 2 THEN 's' ELSE CASE WHEN c_custkey % 8 < 4 THEN 'h' ELSE 's' END END AS lane, CASE WHEN c_custkey % 4 IN (1, 3) THEN 'hybrid' ELSE 'semantic' END AS named FROM customer)
SELECT c_custkey, lane AS strategy, 0 AS chunk_index, c_name AS text, length(c_name)::INT AS char_count FROM m
UNION ALL SELECT c_custkey, named, 2, c_mktsegment, length(c_mktsegment)::INT FROM m"""


def shown_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary shown for each customer: the viewer's, else the pipeline's, else none."""
    c = table(spark, sf_dir, "customer")
    none = F.lit(None).cast("array<string>")
    made = lambda n, points: F.struct(((F.col("c_custkey") % n) == 0).alias("is_llm"), F.col("c_name").alias("summary_text"), points.alias("key_points"), F.array("c_mktsegment").alias("highlights"), none.alias("page_summaries"), F.lit("").alias("document_type"), F.lit(None).cast("string").alias("used_model"))
    found = visual.cached_summary(made(2, none), made(3, F.array("c_name")), F.lit("pdf"))
    return c.select("c_custkey", found.alias("x")).where("x IS NOT NULL").select("c_custkey", "x.summary_source", "x.used_model", "x.document_type", F.get("x.key_points", F.lit(0)).alias("point"))


SHOWN_SUMMARIES = """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'cached_ui_summary' ELSE 'pipeline_llm_summary' END AS summary_source, CASE WHEN c_custkey % 2 = 0 THEN 'cached_ui_summary' ELSE 'cached_llm_summary' END AS used_model, 'pdf' AS document_type,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS point FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"""


def region_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, cards and titles of a region for each nation."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    md = F.concat(F.lit("| name | key |\n|---|:---:|\n| "), F.col("n_name"), F.lit(" | "), key, F.lit(" |\nno row"))
    text = F.concat(F.lit("- a\n\n 1,000 \n"), F.col("n_name"), F.lit("\n* b "), key, F.lit("\nmore\nlast"))
    rows = n.select("n_nationkey", structures.table(md).alias("x"), structures.card(text).alias("c"), structures.title_candidates(text).alias("titles"))
    return rows.select("n_nationkey", F.array_join(F.get("x.rows", F.lit(0)), ",").alias("row"), "x.row_count", "x.column_count", F.array_join("c.headings", ",").alias("headings"), F.array_join("c.bullets", ",").alias("bullets"), F.size("c.lines").alias("n_lines"), F.array_join("titles", ",").alias("titles"))


REGION_STRUCTURES = """
SELECT n_nationkey, n_name || ',' || n_nationkey AS "row", 1 AS row_count, 2 AS column_count, '1,000,' || n_name AS headings, 'a,b ' || n_nationkey AS bullets, 6 AS n_lines, '- a,' || n_name || ',* b ' || n_nationkey AS titles FROM nation"""


def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plotted values of each order by period, with the callout."""
    items = _items(spark, sf_dir)
    rows = items.select("document_id", F.col("number").alias("position"), F.col("l_quantity").cast("int").cast("string").alias("text"), F.when(F.col("number") % 3 == 0, 2).otherwise(1).alias("band_index"), (F.col("l_suppkey") % 50).cast("double").alias("cx"), F.col("number").cast("double").alias("cy"), (F.lit(8.0) + 2 * F.col("number")).alias("height"))
    periods = items.select("document_id").distinct().select("document_id", F.posexplode(F.array(F.lit("1Q24"), F.lit("2Q24"))).alias("position", "label"))
    points = structures.line_points(rows, periods, ["document_id"])
    callout = structures.callouts(rows, periods, ["document_id"]).select("document_id", F.concat_ws("=", "period", "value").alias("callout"))
    listed = points.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("point", F.concat_ws("=", F.coalesce("period", F.lit("-")), "value").alias("x")))), lambda x: x["x"]), ",").alias("points"))
    return callout.join(listed, "document_id", "left")


CHART_POINTS = f"""
WITH {_ITEMS}, a AS (SELECT l_orderkey, l_linenumber AS n, l_quantity::INT::VARCHAR AS v, l_suppkey % 50 AS cx FROM i WHERE l_linenumber % 3 <> 0),
p AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_orderkey) AS c FROM a WHERE n <= 3 WINDOW w AS (PARTITION BY l_orderkey ORDER BY cx, n)),
q AS (SELECT l_orderkey, string_agg(CASE WHEN k = 1 THEN '1Q24' WHEN k = c THEN '2Q24' ELSE '-' END || '=' || v, ',' ORDER BY k) AS points FROM p GROUP BY 1)
SELECT l_orderkey AS document_id, '2Q24=' || arg_max(v, n) AS callout, any_value(points) AS points FROM a LEFT JOIN q USING (l_orderkey) GROUP BY 1"""


def found_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two words found among the words of each order's line items."""
    items = _items(spark, sf_dir)
    box = F.struct((F.col("number") * 10.0).alias("x0"), F.lit(5.0).alias("y0"), (F.col("number") * 10.0 + 8).alias("x1"), F.lit(9.0).alias("y1"))
    elements = items.select("document_id", "page_number", F.col("number").alias("element_order"), F.concat("l_returnflag", "l_linestatus").alias("text"), box.alias("box"))
    first = items.where("number IN (1, 3)").groupBy("document_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", F.concat("l_returnflag", "l_linestatus").alias("x")))), lambda x: x["x"]), " ").alias("text"))
    cells = first.select("document_id", "page_number", F.lit(0).alias("row_index"), F.lit(0).alias("cell_index"), "text")
    return structures.matched_cells(cells, elements).select("document_id", F.size("matched").alias("n_words"), "x0")


FOUND_CELLS = f"""
WITH {_ITEMS}, w AS (SELECT l_orderkey, l_linenumber AS n, l_returnflag || l_linestatus AS t FROM i),
c AS (SELECT l_orderkey, count(*) AS k, min(t) FILTER (n = 1) AS a, min(t) FILTER (n = 3) AS b FROM w WHERE n IN (1, 3) GROUP BY 1),
f AS (SELECT c.l_orderkey, c.k, min(s.n) AS n FROM c JOIN w s ON s.l_orderkey = c.l_orderkey AND s.t = coalesce(c.a, c.b) WHERE c.k = 1 OR EXISTS (SELECT 1 FROM w e WHERE e.l_orderkey = c.l_orderkey AND e.n > s.n AND e.t = c.b) GROUP BY 1, 2)
SELECT l_orderkey AS document_id, k::INT AS n_words, n * 10.0::DOUBLE AS x0 FROM f"""


QUERIES = {
    "region_structures": region_structures,
    "chart_points": chart_points,
    "found_cells": found_cells,
    "image_texts": image_texts,
    "run_boxes": run_boxes,
    "structure_tables": structure_tables,
    "citation_tables": citation_tables,
    "drawing_kinds": drawing_kinds,
    "page_layouts": page_layouts,
    "element_boxes": element_boxes,
    "indexed_chunks": indexed_chunks,
    "shown_summaries": shown_summaries,
}
ORACLES = {
    "region_structures": REGION_STRUCTURES,
    "chart_points": CHART_POINTS,
    "found_cells": FOUND_CELLS,
    "image_texts": IMAGE_TEXTS,
    "run_boxes": RUN_BOXES,
    "structure_tables": STRUCTURE_TABLES,
    "citation_tables": CITATION_TABLES,
    "drawing_kinds": DRAWING_KINDS,
    "page_layouts": PAGE_LAYOUTS,
    "element_boxes": ELEMENT_BOXES,
    "indexed_chunks": INDEXED_CHUNKS,
    "shown_summaries": SHOWN_SUMMARIES,
}
