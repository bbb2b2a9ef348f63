"""Markdown tables: finding them, reading rows, and turning them into facts. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import text as t

BEFORE, AFTER = 4, 13
#: Words of titles, strong titles, and period labels of table headers.
TITLE = "(?i)요약|손익계산서|재무|성과|실적|현황|내역|KPI|지표|Table|표"
STRONG_TITLE = "(?i)손익계산서|재무상태표|현금흐름표|재무제표|KPI|주요 지표"
UNIT_LINE = r"(?i)^\(?\s*(단위|Unit)\s*[:：]"
PERIOD_LABEL = (
    r"(?i)^(?:(?:['’]?\d{2,4})?(?:[1-4]Q|Q[1-4]|FY|YTD|상반기|하반기)|[1-4]Q['’]?\d{2,4}|['’]?\d{2,4}(?:YTD|FY)|\d{4})$"
)
NUMBER = r"^[+\-]?\d+(?:\.\d+)?$"
SEPARATOR = "^:?-{2,}:?$"


def cells(row: Column) -> Column:
    """The cells of a table row, escaped bars put back, white space collapsed."""
    inner = F.regexp_replace(t.strip(row), r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|", -1), lambda x: t.collapse(F.regexp_replace(x, r"\\\|", "|")))


def is_separator(row: Column) -> Column:
    return F.forall(row, lambda x: x.rlike(SEPARATOR))


def period_label(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t.collapse(c), "[‘’]", "'"), r"\s+", "")


def is_period_label(c: Column) -> Column:
    return period_label(c).rlike(PERIOD_LABEL)


def is_number(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t.collapse(c), r"[,%\s]", ""), "−", "-").rlike(NUMBER)


def context_line(c: Column) -> Column:
    """A line as context of a table; '' for rows, page headings, source notes and rules."""
    line = t.collapse(c)
    out = line.startswith("|") | line.rlike(r"(?i)^#{1,6}\s+Page\s+\d+\b") | (line == "Source:") | line.rlike(r"(?i)^-\s+(Page|Region|Type|BBox):") | line.rlike("^[-: ]+$")
    return F.when(out, "").otherwise(t.strip(F.regexp_replace(line, "^#+", "")))


def islands(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """(document_id, page_number, table_index, rows, title, unit): runs of two or more table rows.

    Title: the first strong title after the table, else the nearest title before or the first after
    it, else the nearest line; within four lines before and 13 after. Unit: the first unit line.
    """
    lines = t.lines(t.text(text_col))
    rows = pages.select("document_id", "page_number", lines.alias("l")).withColumn("p", F.transform("l", lambda x: t.strip(x).startswith("|")))
    first = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.get("p", i) & ~F.coalesce(F.get("p", i - 1), F.lit(False)))
    last = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.get("p", i) & ~F.coalesce(F.get("p", i + 1), F.lit(False)))
    rows = rows.withColumn("r", F.filter(F.arrays_zip(first.alias("a"), last.alias("b")), lambda x: x["b"] > x["a"]))
    rows = rows.select("document_id", "page_number", "l", F.posexplode("r").alias("k", "r")).select("document_id", "page_number", "l", (F.col("k") + 1).alias("table_index"), F.col("r.a").alias("a"), F.col("r.b").alias("b"))
    start = F.greatest(F.lit(0), F.col("a") - BEFORE)
    before = F.filter(F.transform(F.slice("l", start + 1, F.col("a") - start), context_line), lambda x: x != "")
    after = F.filter(F.transform(F.slice("l", F.col("b") + 2, F.lit(AFTER)), context_line), lambda x: x != "")
    rows = rows.withColumn("before", F.reverse(before)).withColumn("after", after).withColumn("near", F.concat("before", "after"))
    strong = F.filter("after", lambda x: (F.length(x) <= 80) & x.rlike(STRONG_TITLE))
    titled = F.filter("near", lambda x: (F.length(x) <= 80) & x.rlike(TITLE))
    title = F.coalesce(F.get(strong, 0), F.get(titled, 0), F.get("near", 0), F.lit(""))
    units = F.filter(F.concat(F.reverse("before"), "after"), lambda x: x.rlike(UNIT_LINE))
    unit = F.regexp_replace(F.coalesce(F.get(units, 0), F.lit("")), r"^[() ]+|[() ]+$", "")
    body = F.transform(F.slice("l", F.col("a") + 1, F.col("b") - F.col("a") + 1), cells)
    return rows.select("document_id", "page_number", "table_index", body.alias("rows"), title.alias("title"), unit.alias("unit"))


def facts(tables: DataFrame) -> DataFrame:
    """(document_id, page_number, table_index, title, unit, row, metric, period, value): one row for
    each number under a period label, unpivoted. The first row is the header."""
    base = tables.withColumn("header", F.get("rows", 0)).withColumn("body", F.filter(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), lambda r: ~is_separator(r)))
    columns = F.filter(F.transform("header", lambda x, i: F.struct(i.alias("i"), period_label(x).alias("period"))), lambda x: (x["i"] > 0) & x["period"].rlike(PERIOD_LABEL))
    rows = base.withColumn("columns", columns).select("document_id", "page_number", "table_index", "title", "unit", "columns", F.posexplode("body").alias("row", "cells"))
    rows = rows.withColumn("metric", F.get("cells", 0)).where((F.col("metric") != "") & ~is_period_label(F.col("metric")))
    long = rows.select("document_id", "page_number", "table_index", "title", "unit", "row", "metric", "cells", F.explode("columns").alias("c"))
    long = long.withColumn("value", F.get("cells", F.col("c.i"))).where(F.col("value").isNotNull() & is_number(F.col("value")))
    return long.select("document_id", "page_number", "table_index", "title", "unit", "row", "metric", F.col("c.period").alias("period"), "value")


def fact_text(df: DataFrame) -> Column:
    """- Page p Table k: title / metric / period = value (unit)."""
    unit = F.when(F.col("unit") != "", F.concat(F.lit(" ("), F.col("unit"), F.lit(")"))).otherwise("")
    return F.concat(F.format_string("- Page %d Table %d: ", "page_number", "table_index"), F.concat_ws(" / ", "title", "metric", "period"), F.lit(" = "), F.col("value"), unit)


def coverage(found: DataFrame, periods: int) -> DataFrame:
    """Tables with enough facts: three rows, of which 60 % have max(4, 60 % of the periods)."""
    need = max(4, -(-6 * periods // 10))
    rows = found.groupBy("document_id", "page_number", "table_index", "row").agg(F.count("*").alias("n"), F.first("title").alias("title"))
    least = F.when(F.first("title").contains("실적"), 6).otherwise(3)
    return rows.groupBy("document_id", "page_number", "table_index").agg(F.count("*").alias("n_rows"), F.count_if(F.col("n") >= need).alias("n_full"), least.alias("least")).where((F.col("n_rows") >= F.col("least")) & (F.col("n_full") >= 0.6 * F.col("n_rows"))).drop("least")


def packed_rows(rows: Column) -> Column:
    """Rows whose cells hold several values between <br>: (label, values)."""
    values = lambda r: F.filter(F.transform(F.flatten(F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), lambda c: F.split(c, r"(?i)<br\s*/?>", -1))), lambda v: t.strip(v)), lambda v: v != "")
    return F.transform(rows, lambda r: F.struct(F.get(r, F.lit(0)).alias("label"), values(r).alias("values")))


def modal_width(rows: Column) -> Column:
    """The commonest number of cells, the larger of equals."""
    sizes = F.transform(rows, lambda r: F.size(r))
    counted = F.transform(F.array_distinct(sizes), lambda n: F.struct(F.size(F.filter(sizes, lambda m: m == n)).alias("c"), n.alias("n")))
    return F.array_max(counted)["n"]


def is_value_header(c: Column) -> Column:
    """Headers over values: numbers, quarters, halves, fiscal years and years to date."""
    label = F.upper(period_label(c))
    return (label != "") & (is_number(c) | label.rlike(r"^\dQ\d{2,4}$") | label.rlike(r"^'?\d{2,4}(YTD|Q\d|H\d|FY)$") | label.endswith("YTD"))


def with_stub_header(rows: Column) -> Column:
    """Rows whose header lacks the cell over the labels get an empty one: the header is one short,
    names a value, and the first full row has a label and a number."""
    width, header = modal_width(rows), F.get(rows, F.lit(0))
    full = F.get(F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.size(r) == width), F.lit(0))
    label = F.get(full, F.lit(0))
    numbers = F.exists(F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0))), is_number)
    lacks = (width > 1) & (F.size(header) == width - 1) & (label != "") & ~is_number(label) & F.exists(header, is_value_header) & numbers
    return F.when(F.coalesce(lacks, F.lit(False)), F.concat(F.array(F.concat(F.array(F.lit("")), header)), F.slice(rows, F.lit(2), F.size(rows)))).otherwise(rows)


def render(header: Column, rows: Column) -> Column:
    """A markdown table of an array of cells and an array of such rows."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.transform(header, lambda _: F.lit("---")))
    return F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, line)), "\n")


def from_html(c: Column) -> Column:
    """The rows of an HTML table as arrays of plain cells."""
    rows = F.regexp_extract_all(c, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    found = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda x: t.collapse(F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", " "), "<[^>]*>", ""))))
    return F.filter(found, lambda r: F.size(r) > 0)
