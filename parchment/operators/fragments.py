"""Positioned fragments of text: joining, rows by their running mean, distinct tokens, period labels,
headings that wait for their table, and blocks of clean text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import text as t

#: Characters that take no space before or after them.
NO_SPACE_BEFORE, NO_SPACE_AFTER = ",.:;!?)]}%", "([{%"
#: Rows, tokens and periods, in points; blocks of clean text, in characters.
ROW_REACH = 5.5
SAME_PLACE = 2.0
PERIOD_RIGHT, PERIOD_UP = 28.0, 6.0
LEAST_BLOCK, BLOCK = 12, 700


def joined(parts: Column) -> Column:
    """Fragments in order, with a space where a word meets a word."""

    def step(done: Column, x: Column) -> Column:
        last, first = F.right(F.rtrim(done), F.lit(1)), F.left(F.ltrim(x), F.lit(1))
        word = r"(?U)^\w$"
        space = (last != "") & (first != "") & ~F.lit(NO_SPACE_BEFORE).contains(first) & ~F.lit(NO_SPACE_AFTER).contains(last) & last.rlike(word) & first.rlike(word)
        return F.concat(done, F.when(F.coalesce(space, F.lit(False)), " ").otherwise(""), x)

    return F.aggregate(parts, F.lit(""), step)


def mean_rows(tokens: DataFrame, page_cols: list[str], reach: float = ROW_REACH) -> DataFrame:
    """tokens (id, cx, cy, …) with row: from top to bottom, a token is in the last row if it is within
    `reach` of the mean of that row's tokens so far. A fold over one page's tokens in the JVM."""
    kind = tokens.schema["id"].dataType.simpleString()
    listed = tokens.groupBy(*page_cols).agg(F.sort_array(F.collect_list(F.struct(F.col("cy").cast("double").alias("cy"), F.col("cx").cast("double").alias("cx"), "id"))).alias("a"))
    start = F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.array().cast(f"array<struct<id:{kind},row:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        here = (s["n"] == 0) | (F.abs(x["cy"] - s["total"] / F.greatest(s["n"], F.lit(1))) <= reach)
        row = s["row"] + (~here).cast("int")
        return F.struct(
            row.alias("row"), (F.when(here, s["total"]).otherwise(0.0) + x["cy"]).alias("total"), (F.when(here, s["n"]).otherwise(0) + 1).alias("n"),
            F.concat(s["out"], F.array(F.struct(x["id"].alias("id"), row.alias("row")))).alias("out"),
        )

    rows = listed.select(*page_cols, F.explode(F.aggregate("a", start, step)["out"]).alias("x")).select(*page_cols, "x.id", "x.row")
    return tokens.join(rows, [*page_cols, "id"])


def distinct_tokens(tokens: DataFrame, page_cols: list[str], reach: float = SAME_PLACE) -> DataFrame:
    """Tokens (id, text, x0, y0, cx, cy) without those that repeat a kept one of the same text within
    `reach`, from top left on. Only tokens of one text on one page are compared."""
    import pandas as pd

    fields = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in (*page_cols, "id"))

    def run(same: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[float, float]] = []
        rows = []
        for i, x, y in same.sort_values(["y0", "x0", "id"])[["id", "cx", "cy"]].itertuples(index=False):
            if not any(abs(x - a) <= reach and abs(y - b) <= reach for a, b in kept):
                kept.append((x, y))
                rows.append(i)
        return same[same.id.isin(rows)][[*page_cols, "id"]]

    found = tokens.groupBy(*page_cols, "text").applyInPandas(run, fields)
    return tokens.join(found, [*page_cols, "id"], "left_semi")


def period_labels(tokens: DataFrame, page_cols: list[str]) -> DataFrame:
    """Tokens (id, text, cx, cy) with label: a single digit takes the nearest Qnn to its right on its
    line, which then has no label of its own."""
    text = F.regexp_replace(F.col("text"), r"(?U)\s+", "")
    rows = tokens.withColumn("__t", text)
    digits = rows.where(F.col("__t").rlike(r"^\d$")).select(*page_cols, F.col("id").alias("d_id"), F.col("__t").alias("d"), F.col("cx").alias("d_cx"), F.col("cy").alias("d_cy"))
    quarters = rows.where(F.col("__t").rlike(r"(?i)^Q\d{2}$")).select(*page_cols, F.col("id").alias("q_id"), F.col("__t").alias("q"), F.col("cx").alias("q_cx"), F.col("cy").alias("q_cy"))
    gap = F.col("q_cx") - F.col("d_cx")
    pairs = digits.join(quarters, page_cols).where(gap.between(0, PERIOD_RIGHT) & (F.abs(F.col("q_cy") - F.col("d_cy")) <= PERIOD_UP))
    best = pairs.withColumn("__n", F.row_number().over(Window.partitionBy(*page_cols, "d_id").orderBy(gap, "q_id"))).where("__n = 1")
    best = best.withColumn("__n", F.row_number().over(Window.partitionBy(*page_cols, "q_id").orderBy(gap, "d_id"))).where("__n = 1")
    best = best.select(*page_cols, "d_id", "q_id", F.concat("d", "q").alias("label"))
    rows = rows.join(best.select(*page_cols, F.col("d_id").alias("id"), "label"), [*page_cols, "id"], "left").join(best.select(*page_cols, F.col("q_id").alias("id"), F.lit(True).alias("__used")), [*page_cols, "id"], "left")
    return rows.withColumn("label", F.when(F.col("__used"), None).otherwise(F.coalesce("label", "__t"))).drop("__t", "__used")


def waiting_headings(groups: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Groups (position, kind heading or table, texts) as tables with the distinct texts of the
    headings since the table before; headings behind the last table are a row without a table."""
    w = Window.partitionBy(id_col).orderBy("position")
    tables_before = F.coalesce(F.sum(F.when(F.col("kind") == "table", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = groups.withColumn("__part", tables_before)
    heads = F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "heading", F.struct("position", "texts")))), lambda x: x["texts"])
    out = rows.groupBy(id_col, "__part").agg(F.array_distinct(F.flatten(heads)).alias("headings"), F.max(F.when(F.col("kind") == "table", F.col("position"))).alias("position"))
    return out.select(id_col, F.col("__part").alias("table_index"), "position", "headings")


def is_noise_line(c: Column) -> Column:
    """Page numbers, lone numbers and periods, tags, image paths, and a character or two without letters."""
    flat = F.regexp_replace(c, r"(?U)\s+", "")
    patterns = (r"^$", r"^\d{1,3}$", r"^-?\(?\d+(?:\.\d+)?%?\)?$", r"(?i)^(?:20\d{2}|[1-4]?Q\d{2}|YTD|QoQ)$", r"^[^가-힣A-Za-z]{1,2}$", r"^</?[A-Za-z][^>]*>$")
    out = c.rlike(r"(?:/Users/|[A-Za-z]:\\).+\.(?:png|jpg|jpeg)$")
    for p in patterns:
        out = out | flat.rlike(p)
    return out


def clean_blocks(c: Column, size: int = BLOCK) -> Column:
    """A page's paragraphs without noise lines, those of 12 characters with letters, packed up to 700."""
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), lambda x: t.strip(x)), lambda x: ~is_noise_line(x))
    parts = F.transform(F.split(t.unix_lines(c), r"\n\s*\n", -1), lambda p: F.array_join(lines(p), "\n"))
    useful = F.filter(parts, lambda p: (F.length(F.regexp_replace(p, r"(?U)\s+", "")) >= LEAST_BLOCK) & p.rlike("[가-힣A-Za-z]"))

    def step(done: Column, x: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        fits = (F.size(done) > 0) & (F.length(last) + 2 + F.length(x) <= size)
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit("\n\n"), x)))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(useful, F.array().cast("array<string>"), step)
