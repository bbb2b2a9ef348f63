"""Queries over page layout. Line items are the tokens of a page, which is an order's supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions.storage import pieces
from parchment.operators import layout
from parchment.plans.tables import fixture, table, values


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, id, x0, y0, x1, y1, cx, cy): boxes 20 wide and 8 high."""
    i = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_quantity") * 12).cast("double"), (F.col("l_orderkey") % 97 * 7).cast("double")
    placed = i.select(F.col("l_partkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x.alias("x0"), y.alias("y0"))
    # Dealt by size before they are grouped, as the groups of a task are held in its memory.
    rows = placed.repartition(pieces(placed), "page").groupBy("page", "id").agg(F.max("x0").alias("x0"), F.max("y0").alias("y0"))
    return rows.select("page", "id", "x0", "y0", (F.col("x0") + 20).alias("x1"), (F.col("y0") + 8).alias("y1"), (F.col("x0") + 10).alias("cx"), (F.col("y0") + 4).alias("cy"))


_T = """t AS (SELECT l_partkey AS page, l_orderkey * 10 + l_linenumber AS id, max(l_quantity * 12)::DOUBLE AS x0, max(l_orderkey % 97 * 7)::DOUBLE AS y0 FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, x0 + 20 AS x1, y0 + 8 AS y1, x0 + 10 AS cx, y0 + 4 AS cy FROM t)"""


def y_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of tokens by vertical gaps over 18."""
    found = layout.clusters(_tokens(spark, sf_dir), ["page"], "cy", 18, ["id"])
    return layout.centres(found, ["page"], "cy").select("page", F.col("cluster").cast("long").alias("cluster"), F.round("centre", 6).alias("centre"), "low", "high", "n")


Y_CLUSTERS = f"""
WITH {_T}, g AS (SELECT *, coalesce((cy - lag(cy) OVER w > 18)::INT, 0) AS new FROM k WINDOW w AS (PARTITION BY page ORDER BY cy, id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY cy, id)::BIGINT AS cluster FROM g)
SELECT page, cluster, round(avg(cy), 6) AS centre, min(cy) AS low, max(cy) AS high, count(*) AS n FROM c GROUP BY 1, 2"""


def row_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in order as table rows, grouped by edges and gaps."""
    i = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), (F.col("o_totalprice") % 1000).alias("x0"), (F.col("o_totalprice") % 1000 + F.dayofmonth("o_orderdate") * 20).alias("x1"), F.unix_timestamp("o_orderdate").cast("double").alias("s"))
    rows = i.select("o_custkey", "k", "x0", "x1", (F.col("s") / 86400 * 2).alias("start"), (F.col("s") / 86400 * 2 + 1).alias("end"))
    found = layout.table_rows(rows, ["o_custkey"], "k")
    return found.groupBy("o_custkey").agg((F.max("table_index") + 1).cast("long").alias("tables"), F.count("*").alias("n"))


ROW_TABLES = """
WITH r AS (SELECT o_custkey, o_orderkey AS k, o_totalprice % 1000 AS x0, o_totalprice % 1000 + day(o_orderdate) * 20 AS x1, epoch(o_orderdate) / 86400 * 2 AS s FROM orders),
g AS (SELECT o_custkey, k, x0, x1, lag(x0) OVER w AS p0, lag(x1) OVER w AS p1, s - (lag(s) OVER w + 1) AS d FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY k)),
n AS (SELECT o_custkey, CASE WHEN d IS NULL THEN 0 WHEN (abs(x0 - p0) <= 160 AND abs(x1 - p1) <= 320 AND d <= 120) OR d <= 8 THEN 0 ELSE 1 END AS new FROM g)
SELECT o_custkey, (sum(new) + 1)::BIGINT AS tables, count(*) AS n FROM n GROUP BY 1"""

_BOX = "b AS (SELECT page, g AS box, g * 150.0 AS x0, g * 100.0 AS y0, g * 150.0 + 200 AS x1, g * 100.0 + 180 AS y1 FROM (SELECT DISTINCT page FROM k), range(4) r(g))"


def _boxes(tokens: DataFrame) -> DataFrame:
    g = tokens.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("box"))
    return g.select("page", "box", (F.col("box") * 150.0).alias("x0"), (F.col("box") * 100.0).alias("y0"), (F.col("box") * 150.0 + 200).alias("x1"), (F.col("box") * 100.0 + 180).alias("y1"))


def tokens_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens each box holds."""
    tokens = _tokens(spark, sf_dir)
    found = layout.texts_in_boxes(tokens.select("page", "id", "cx", "cy"), _boxes(tokens), ["page"])
    return found.groupBy("page", "box").agg(F.count("*").alias("n"), F.min("id").alias("first"))


TOKENS_IN_BOXES = f"""WITH {_T}, {_BOX}
SELECT page, box::INT AS box, count(*) AS n, min(id) AS first FROM (SELECT page, id, cx, cy FROM k) JOIN b USING (page) WHERE cx BETWEEN x0 - 1.5 AND x1 + 1.5 AND cy BETWEEN y0 - 1.5 AND y1 + 1.5 GROUP BY 1, 2"""


def anchor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by nearest anchor and by the columns between anchors."""
    tokens = _tokens(spark, sf_dir)
    anchors = tokens.select("page").distinct().select("page", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("anchor")).withColumn("ax", F.col("anchor") * 140.0)
    near = layout.nearest_anchor(tokens, anchors, ["page"], "id").groupBy("page", "anchor").agg(F.count("*").alias("near"))
    between = layout.anchor_columns(tokens, anchors, ["page"]).groupBy("page", "anchor").agg(F.count("*").alias("between"))
    return near.join(between, ["page", "anchor"], "full").select("page", "anchor", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("between", F.lit(0)).alias("between"))


ANCHOR_TOKENS = f"""
WITH {_T}, a AS (SELECT page, g::INT AS anchor, g * 140.0 AS ax FROM (SELECT DISTINCT page FROM k), range(1, 4) r(g)),
p AS (SELECT page, id, anchor, row_number() OVER (PARTITION BY page, id ORDER BY abs(cx - ax), ax) AS n FROM k JOIN a USING (page) WHERE abs(cx - ax) <= 62),
n AS (SELECT page, anchor, count(*) AS near FROM p WHERE n = 1 GROUP BY 1, 2),
b AS (SELECT page, anchor, count(*) AS between_ FROM k JOIN a USING (page) WHERE cx >= CASE anchor WHEN 1 THEN ax - 80 ELSE ax - 70 END AND cx < CASE anchor WHEN 3 THEN ax + 80 ELSE ax + 70 END GROUP BY 1, 2)
SELECT page, anchor, coalesce(near, 0) AS near, coalesce(between_, 0) AS between FROM n FULL JOIN b USING (page, anchor)"""


def box_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes but those that hold two smaller ones, by size of the order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") % 300).alias("x0"), (F.col("o_orderkey") % 200).cast("double").alias("y0"), (F.col("o_totalprice") % 300 + F.col("o_orderkey") % 500).alias("x1"), (F.col("o_orderkey") % 200 + F.dayofmonth("o_orderdate") * 12).cast("double").alias("y1"))
    left = layout.without_containers(o, ["page"], "id")
    return left.groupBy("page").agg(F.count("*").alias("n"), F.min("id").alias("first"))


BOX_CONTAINERS = """
WITH b AS (SELECT o_custkey AS page, o_orderkey AS id, o_totalprice % 300 AS x0, (o_orderkey % 200)::DOUBLE AS y0, o_totalprice % 300 + o_orderkey % 500 AS x1, (o_orderkey % 200 + day(o_orderdate) * 12)::DOUBLE AS y1 FROM orders),
f AS (SELECT a.page, a.id FROM b a JOIN b c ON a.page = c.page AND a.id <> c.id AND c.x0 >= a.x0 AND c.x1 <= a.x1 AND c.y0 >= a.y0 AND c.y1 <= a.y1 AND (c.x1 - c.x0) * (c.y1 - c.y0) < (a.x1 - a.x0) * (a.y1 - a.y0) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT page, count(*) AS n, min(id) AS first FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.page = b.page AND f.id = b.id) GROUP BY 1"""


def master_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master column that each line item's cell overlaps first."""
    tokens = _tokens(spark, sf_dir)
    masters = tokens.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("column")).withColumns({"from": F.col("column") * 64.0, "to": F.col("column") * 64.0 + 64})
    found = layout.master_columns(tokens.select("page", "id", "x0", "x1"), masters, ["page"], "id")
    return found.groupBy("column").agg(F.count("*").alias("cells"))


MASTER_GRID = f"""WITH {_T}, m AS (SELECT page, id, min(g)::INT AS c FROM k, range(10) r(g) WHERE x0 < g * 64 + 64 AND x1 > g * 64 GROUP BY 1, 2)
SELECT c AS column, count(*) AS cells FROM m GROUP BY 1"""


def kpi_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with the nearest label above and the unit to the right."""
    tokens = _tokens(spark, sf_dir).withColumns({"is_number": F.col("id") % 3 == 0, "text": F.concat(F.lit("t"), F.col("id").cast("string"))})
    found = layout.kpis(tokens, ["page"])
    return found.groupBy("page").agg(F.count("*").alias("n"), F.count("label").alias("labels"), F.count("unit").alias("units"), F.min("label").alias("first_label"))


KPI_LABELS = f"""
WITH {_T}, n AS (SELECT * FROM k WHERE id % 3 = 0), o AS (SELECT * FROM k WHERE id % 3 <> 0),
l AS (SELECT n.page, n.id, o.id AS oid, row_number() OVER (PARTITION BY n.page, n.id ORDER BY n.cy - o.cy, abs(n.cx - o.cx), o.id) AS r FROM n JOIN o USING (page) WHERE n.cy - o.cy > 0 AND n.cy - o.cy <= 48),
u AS (SELECT DISTINCT n.page, n.id FROM n JOIN o USING (page) WHERE o.x0 - n.x1 BETWEEN 0 AND 10 AND abs(n.cy - o.cy) <= 4)
SELECT n.page, count(*) AS n, count(l.oid) AS labels, count(u.id) AS units, min('t' || l.oid) AS first_label FROM n LEFT JOIN (SELECT * FROM l WHERE r = 1) l ON l.page = n.page AND l.id = n.id LEFT JOIN u ON u.page = n.page AND u.id = n.id GROUP BY 1"""


def reading_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tokens of each page in reading order."""
    found = layout.reading_order(_tokens(spark, sf_dir).select("page", "id", "cx", "cy"), ["page"])
    return found.groupBy("page").agg(F.min_by("id", "position").alias("first"), F.max("position").cast("long").alias("n"), F.sum(F.col("position") * (F.col("id") % 101)).alias("mark"))


READING_POSITIONS = f"""
WITH {_T}, g AS (SELECT *, coalesce((cx - lag(cx) OVER (PARTITION BY page ORDER BY cx) > 24)::INT, 0) AS nc, coalesce((cy - lag(cy) OVER (PARTITION BY page ORDER BY cy) > 6)::INT, 0) AS nr FROM k),
c AS (SELECT *, sum(nc) OVER (PARTITION BY page ORDER BY cx) AS c, sum(nr) OVER (PARTITION BY page ORDER BY cy) AS r FROM g),
m AS (SELECT *, max(c) OVER (PARTITION BY page) >= max(r) OVER (PARTITION BY page) + 2 AS col FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN col THEN c ELSE r END, CASE WHEN col THEN cy ELSE cx END, CASE WHEN col THEN cx ELSE cy END, id) AS p FROM m)
SELECT page, arg_min(id, p) AS first, max(p)::BIGINT AS n, sum(p * (id % 101))::BIGINT AS mark FROM o GROUP BY 1"""

REGIONS = [
    ("chart", "Trading 12% 15% 20% 2021 2022 2023 3Q25", 40.0, 60.0, 400.0, 260.0, 0, 5, 0, 1),
    ("table", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", 40.0, 60.0, 500.0, 200.0, 12, 0, 0, 2),
    ("highlight_card", "- this is one long highlighted line of text\n- and this is another long line of text", 30.0, 320.0, 400.0, 420.0, 0, 0, 2, 0),
    ("notes", "1. first note\n2. second note\n3) third note", 30.0, 450.0, 500.0, 490.0, 0, 0, 0, 0),
    ("kpi_pair_panel", "1,234억 56.7%", 30.0, 100.0, 200.0, 160.0, 0, 0, 0, 0),
]


def region_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of small regions, as worked out by hand."""
    rows = fixture(spark, REGIONS, "expected string, markdown string, x0 double, y0 double, x1 double, y1 double, cell_fill_count int, bar_fill_count int, matching_fill_count int, orange_line_count int")
    rows = rows.withColumn("bbox", F.struct("x0", "y0", "x1", "y1"))
    found = layout.classify_regions(layout.region_features(rows))
    return found.select("expected", "predicted_type", F.col("confidence").between(0.45, 0.99).alias("sure"))


REGION_TYPES = f"SELECT expected, expected AS predicted_type, true AS sure FROM (VALUES {values([(r[0],) for r in REGIONS])}) AS v(expected)"


def box_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected groups of boxes on each page."""
    found = layout.components(_tokens(spark, sf_dir).select("page", "id", "x0", "y0", "x1", "y1"), ["page"])
    return found.groupBy("page").agg(F.countDistinct("component").alias("components"), F.count("*").alias("boxes"), F.sum("component").alias("mark"))


BOX_COMPONENTS = f"""
WITH RECURSIVE {_T}, e AS (SELECT a.page, a.id AS a, b.id AS b FROM k a JOIN k b ON a.page = b.page AND a.x0 <= b.x1 + 16 AND b.x0 <= a.x1 + 16 AND a.y0 <= b.y1 + 12 AND b.y0 <= a.y1 + 12),
r(page, id, c) AS (SELECT page, id, id FROM k UNION SELECT r.page, e.b, r.c FROM r JOIN e ON e.page = r.page AND e.a = r.id AND e.b > r.c),
m AS (SELECT page, id, min(c) AS c FROM r GROUP BY 1, 2)
SELECT page, count(DISTINCT c) AS components, count(*) AS boxes, sum(c)::BIGINT AS mark FROM m GROUP BY 1"""


def xy_cut_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each page by recursive cuts."""
    found = layout.split_regions(_tokens(spark, sf_dir).select("page", "id", "x0", "y0", "x1", "y1"), ["page"])
    return found.groupBy("page").agg(F.countDistinct("region").alias("regions"), F.count("*").alias("boxes"))


def grown_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region that grows around each page's first token."""
    tokens = _tokens(spark, sf_dir).select("page", "id", "x0", "y0", "x1", "y1")
    return layout.grown_region(tokens, tokens.groupBy("page").agg(F.min("id").alias("id")), ["page"], 12, 9)


_NEAR = "k.page = {0}.page AND k.x0 <= {0}.x1 + 12 AND k.x1 >= {0}.x0 - 12 AND k.y0 <= {0}.y1 + 9 AND k.y1 >= {0}.y0 - 9"
GROWN_REGIONS = f"""
WITH RECURSIVE {_T}, g(page, x0, y0, x1, y1) AS (SELECT page, x0, y0, x1, y1 FROM k WHERE (page, id) IN (SELECT page, min(id) FROM k GROUP BY 1)
  UNION SELECT g.page, min(k.x0), min(k.y0), max(k.x1), max(k.y1) FROM g JOIN k ON {_NEAR.format("g")} GROUP BY g.page, g.x0, g.y0, g.x1, g.y1),
f AS (SELECT DISTINCT ON (page) * FROM g ORDER BY page, (x1 - x0) + (y1 - y0) DESC)
SELECT f.page, f.x0, f.y0, f.x1, f.y1, count(*) AS n FROM f JOIN k ON {_NEAR.format("f")} GROUP BY ALL"""


QUERIES = {
    "y_clusters": y_clusters,
    "row_tables": row_tables,
    "tokens_in_boxes": tokens_in_boxes,
    "anchor_tokens": anchor_tokens,
    "box_containers": box_containers,
    "master_grid": master_grid,
    "kpi_labels": kpi_labels,
    "reading_positions": reading_positions,
    "region_types": region_types,
    "box_components": box_components,
    "xy_cut_regions": xy_cut_regions,
    "grown_regions": grown_regions,
}
ORACLES = {
    "y_clusters": Y_CLUSTERS,
    "row_tables": ROW_TABLES,
    "tokens_in_boxes": TOKENS_IN_BOXES,
    "grown_regions": GROWN_REGIONS,
    "anchor_tokens": ANCHOR_TOKENS,
    "box_containers": BOX_CONTAINERS,
    "master_grid": MASTER_GRID,
    "kpi_labels": KPI_LABELS,
    "reading_positions": READING_POSITIONS,
    "region_types": REGION_TYPES,
    "box_components": BOX_COMPONENTS,
}
