"""Typed structures of page regions: tables, cards and charts, and cells found again among a page's images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import text as t

#: Numbers of a plot, labels of an axis, bullets, limits of titles and of plotted values.
NUMBER = r"^-?\d{1,3}(?:,\d{3})*(?:\.\d+)?%?$|^\d+(?:\.\d+)?%$|^\(\d+%\)$"
AXIS_LABEL = r"(?i)^(?:20\d{2}|Q\d{2}|3Q\d{2}|YTD|QoQ)$"
BULLET = r"^\s*[-*•]\s+"
TITLE_CHARS, TITLES, PLOT_HEIGHT = 60, 3, 15.0
#: How far the words of a cell may be from its first one, and from each other.
BAND_UP, BAND_DOWN, BACK, WRAP = -2.0, 28.0, 12.0, 80.0


def tight(c: Column) -> Column:
    return F.regexp_replace(t.text(c), r"(?U)\s+", "")


def clean_lines(c: Column) -> Column:
    return F.filter(F.transform(t.lines(t.text(c)), t.strip), lambda x: x != "")


def markdown_rows(c: Column) -> Column:
    """The rows of a region's markdown table, without separators."""
    rows = F.filter(clean_lines(c), lambda x: x.startswith("|"))
    cells = F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), t.strip))
    return F.filter(cells, lambda r: ~F.forall(r, lambda x: x.rlike("^:?-{3,}:?$")))


def table(c: Column) -> Column:
    """struct<header, rows, row_count, column_count>; null if the region has no markdown table."""
    rows = markdown_rows(c)
    head = F.get(rows, F.lit(0))
    made = F.struct(head.alias("header"), F.slice(rows, F.lit(2), F.size(rows)).alias("rows"), (F.size(rows) - 1).alias("row_count"), F.size(head).alias("column_count"))
    return F.when(F.size(rows) > 0, made)


def card(c: Column) -> Column:
    """struct<headings, bullets, lines>: the first two lines that are no bullets, and the bullets."""
    lines = clean_lines(c)
    plain = F.filter(lines, lambda x: ~x.rlike(BULLET))
    bullets = F.transform(F.filter(lines, lambda x: x.rlike(BULLET)), lambda x: t.strip(F.regexp_replace(x, BULLET, "")))
    return F.struct(F.slice(plain, 1, 2).alias("headings"), bullets.alias("bullets"), lines.alias("lines"))


def title_candidates(c: Column) -> Column:
    return F.slice(F.filter(clean_lines(c), lambda x: (F.length(x) <= TITLE_CHARS) & ~tight(x).rlike(NUMBER)), 1, TITLES)


def _periods(periods: DataFrame, page_cols: list[str]) -> DataFrame:
    return periods.groupBy(*page_cols).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "label"))), lambda x: x["label"]).alias("__periods"))


def line_points(items: DataFrame, periods: DataFrame, page_cols: list[str]) -> DataFrame:
    """(…, point, period, value, cx, cy): the small numbers of a region's plot band (band_index 1) from left to
    right. As many periods (position, label) as points name them all, else the first and the last one."""
    shown = items.where((F.col("band_index") == 1) & tight(F.col("text")).rlike(NUMBER) & (F.col("height") < PLOT_HEIGHT))
    order = Window.partitionBy(*page_cols).orderBy("cx", "cy", "text")
    rows = shown.withColumns({"point": F.row_number().over(order) - 1, "__n": F.count("*").over(Window.partitionBy(*page_cols))})
    rows = rows.join(_periods(periods, page_cols), page_cols, "left")
    last = F.try_element_at("__periods", F.lit(-1))
    named = F.when(F.size("__periods") == F.col("__n"), F.get("__periods", F.col("point"))).when(F.col("point") == 0, F.get("__periods", F.lit(0))).when(F.col("point") == F.col("__n") - 1, last)
    return rows.select(*page_cols, "point", named.alias("period"), F.col("text").alias("value"), "cx", "cy")


def callouts(items: DataFrame, periods: DataFrame, page_cols: list[str]) -> DataFrame:
    """(…, value, period): the tallest number of each plot band, which is that of the last period; the first in
    order (position) of equals."""
    shown = items.where((F.col("band_index") == 1) & tight(F.col("text")).rlike(NUMBER))
    best = shown.groupBy(*page_cols).agg(F.max_by("text", F.struct("height", -F.col("position"))).alias("value"))
    return best.join(_periods(periods, page_cols), page_cols, "left").select(*page_cols, "value", F.try_element_at("__periods", F.lit(-1)).alias("period"))


def series_columns(columns: DataFrame, page_cols: list[str]) -> DataFrame:
    """(…, column_index, label, values): the columns (anchor, texts) under axis labels, all of them if none is;
    values are the texts with a digit."""
    axis = tight(F.col("anchor")).rlike(AXIS_LABEL)
    rows = columns.withColumn("__axis", F.coalesce(axis, F.lit(False)))
    rows = rows.withColumn("__any", F.max("__axis").over(Window.partitionBy(*page_cols)))
    return rows.where(F.col("__axis") | ~F.col("__any")).select(*page_cols, "column_index", F.col("anchor").alias("label"), F.filter("texts", lambda x: x.rlike(r"\d")).alias("values"))


def _following(tokens: list[str], boxes: list, start: int, wanted: list[str]) -> list[int] | None:
    """The elements that hold the wanted words from `start` on, within a band below its top and each further
    on its line or on the next one; null if the band ends before they do."""
    taken = [start]
    for k in range(start + 1, len(tokens)):
        if len(taken) == len(wanted) or not BAND_UP <= boxes[k]["y0"] - boxes[start]["y0"] <= BAND_DOWN:
            break
        last = boxes[taken[-1]]
        onward = boxes[k]["x0"] >= last["x0"] - BACK or (boxes[k]["y0"] > last["y0"] and boxes[k]["x0"] <= last["x0"] + WRAP)
        if onward and tokens[k] == wanted[len(taken)]:
            taken.append(k)
    return taken if len(taken) == len(wanted) else None


def matched_cells(cells: DataFrame, elements: DataFrame) -> DataFrame:
    """(document_id, page_number, row_index, cell_index, matched, x0, y0, x1, y1): where a table's cells stand
    among a page's elements (element_order, text, box): their words in order, in the flattest place; without
    words or a place, matched is empty and the box null. A page's cells and elements are matched together."""
    key = ["document_id", "page_number"]
    normal = F.regexp_replace(F.regexp_replace(t.text("text"), "[‘’]", "'"), "﻿", "")
    left = cells.select(*key, "row_index", "cell_index", F.filter(F.split(t.collapse(normal), " "), lambda x: x != "").alias("words"))
    right = elements.select(*key, "element_order", t.collapse(normal).alias("token"), "box")

    cell = F.struct("row_index", "cell_index", "words")
    element = F.struct("element_order", "token", *(F.col(f"box.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")))
    pages = left.groupBy(*key).agg(F.collect_list(cell).alias("cells")).join(right.groupBy(*key).agg(F.sort_array(F.collect_list(element)).alias("elements")), key, "left")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for cells, elements in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                boxes = elements or []
                tokens = [x["token"] for x in boxes]
                places: dict[str, list[int]] = {}
                for i, token in enumerate(tokens):
                    places.setdefault(token, []).append(i)
                rows = []
                for c in cells:
                    words = c["words"]
                    found = [x for s in places.get(words[0], []) if (x := _following(tokens, boxes, s, words))] if words else []
                    best = min(found, key=lambda x: (boxes[x[-1]]["y0"] - boxes[x[0]]["y0"], boxes[x[0]]["y0"], boxes[x[0]]["x0"]), default=[])
                    edges = {k: f(boxes[i][k] for i in best) if best else None for f, k in ((min, "x0"), (min, "y0"), (max, "x1"), (max, "y1"))}
                    rows.append({"row_index": c["row_index"], "cell_index": c["cell_index"], "matched": [boxes[i]["element_order"] for i in best], **edges})
                made.append(rows)
            edge = [(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")]
            kind = pa.list_(pa.struct([("row_index", pa.int32()), ("cell_index", pa.int32()), ("matched", pa.list_(pa.int32())), *edge]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, kind)], names=[*key, "found"])

    ids = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in key)
    out = pages.select(*key, "cells", "elements").mapInArrow(run, f"{ids}, found array<struct<row_index:int,cell_index:int,matched:array<int>,x0:double,y0:double,x1:double,y1:double>>")
    return out.select(*key, F.explode("found").alias("x")).select(*key, "x.*")
