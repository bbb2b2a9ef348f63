"""What a document's pages show beside text: images and their marked content, tables of the structure
tree, drawings, page contexts, and what the viewer asks for by element.

Inputs are rows of a reader (images, content streams, structure nodes, drawings); nothing here opens files.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import text as t

#: Texts of marked content that an image shows, rows of a table from a citation.
MOST_TEXTS, MOST_ROWS = 8, 10
#: Limits of colour parts.
WHITE, GRAY_APART = 0.96, 0.03
SHEET = 0.95
_OPERATOR = re.compile(r"/MCID\s+(\d+)|\b(BDC|BMC|EMC)\b|/([A-Za-z0-9_.+-]+)\s+Do")


def _shown(stream: str, names: set[str]) -> list[tuple[str, int | None]]:
    """(image, marked-content id) of each drawing of a named image in a content stream."""
    marks: list[int | None] = []
    announced: int | None = None
    shown = []
    for number, marker, image in _OPERATOR.findall(stream):
        if number:
            announced = int(number)
        elif marker == "EMC":
            del marks[-1:]
            announced = None
        elif marker:
            # The innermost id holds for marks that have none themselves.
            marks.append(announced if announced is not None else marks[-1] if marks else None)
            announced = None
        elif image in names:
            shown.append((image, marks[-1] if marks else None))
    return shown


def image_draws(streams: DataFrame) -> DataFrame:
    """(document_id, page_number, draw_index, image_name, mcid) of pages (stream, image_names): the
    drawings of the page's images in order. A stream is read as a whole, as its marks nest."""
    kind = "array<struct<draw_index:int,image_name:string,mcid:int>>"

    def run(batches):
        import pyarrow as pa

        of = pa.list_(pa.struct([("draw_index", pa.int32()), ("image_name", pa.string()), ("mcid", pa.int32())]))
        for batch in batches:
            made = [[{"draw_index": i, "image_name": n, "mcid": m} for i, (n, m) in enumerate(_shown(s or "", set(names or [])))] for s, names in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, of)], names=["document_id", "page_number", "draws"])

    pages = streams.select("document_id", "page_number", "stream", "image_names")
    ids = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("document_id", "page_number"))
    rows = pages.mapInArrow(run, f"{ids}, draws {kind}")
    return rows.select("document_id", "page_number", F.explode("draws").alias("d")).select("document_id", "page_number", "d.*")


def marked_texts(runs: DataFrame) -> DataFrame:
    """(document_id, page_number, mcid, mcid_text, roles): the first eight distinct texts of each marked
    content in order, joined, and its distinct roles as block/leaf."""
    rows = runs.groupBy("document_id", "page_number", "mcid").agg(F.sort_array(F.collect_list(F.struct("position", t.strip(t.text("text")).alias("text"), F.concat_ws("/", "block_role", "leaf_role").alias("role")))).alias("r"))
    texts = F.filter(F.array_distinct(F.transform("r", lambda x: x["text"])), lambda x: x != "")
    return rows.select("document_id", "page_number", "mcid", F.array_join(F.slice(texts, 1, MOST_TEXTS), " ").alias("mcid_text"), F.array_distinct(F.transform("r", lambda x: x["role"])).alias("roles"))


def image_elements(images: DataFrame, draws: DataFrame, runs: DataFrame, first_order: int = 0) -> DataFrame:
    """Images (document_id, page_number, number, box) as elements: element_id, element_order, mcid, and
    text of the marked content that the drawing of the same rank stands in."""
    order = Window.partitionBy("document_id", "page_number").orderBy("number")
    placed = images.withColumn("draw_index", F.row_number().over(order) - 1)
    rows = placed.join(draws.select("document_id", "page_number", "draw_index", "image_name", "mcid"), ["document_id", "page_number", "draw_index"], "left")
    rows = rows.join(marked_texts(runs), ["document_id", "page_number", "mcid"], "left")
    rank = F.col("draw_index") + first_order
    return rows.select("document_id", "page_number", F.format_string("p%d-e%d", F.col("page_number").cast("int"), rank.cast("int")).alias("element_id"), rank.alias("element_order"), "box", "image_name", "mcid", F.when(F.col("mcid_text") != "", F.col("mcid_text")).alias("text"), F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))


def union_box(box: str) -> Column:
    """The box around a group's boxes."""
    return F.struct(*(f(f"{box}.{k}").alias(k) for f, k in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))


def run_tokens(runs: DataFrame, images: DataFrame, draws: DataFrame, top_limit: float) -> DataFrame:
    """Structure runs (document_id, page_number, run_id, text, mcids) with the box around the images drawn
    in their marked content. Images above the page or below top_limit don't count, and runs without
    text or images are left out."""
    order = Window.partitionBy("document_id", "page_number").orderBy("number")
    inside = F.col("box.y0").between(0, top_limit)
    boxes = images.withColumn("draw_index", F.row_number().over(order) - 1).join(draws, ["document_id", "page_number", "draw_index"]).where(inside & F.col("mcid").isNotNull())
    boxes = boxes.groupBy("document_id", "page_number", "mcid").agg(union_box("box").alias("box"))
    text = t.collapse(t.text("text"))
    own = runs.select("document_id", "page_number", "run_id", text.alias("text"), F.explode(F.array_distinct("mcids")).alias("mcid")).where("text <> ''")
    rows = own.join(boxes, ["document_id", "page_number", "mcid"]).groupBy("document_id", "page_number", "run_id", "text").agg(union_box("box").alias("box"))
    return rows.where(F.col("box.y0").between(0, top_limit))


def struct_tables(nodes: DataFrame) -> DataFrame:
    """(document_id, table_id, page_number, rows) of a structure tree's tables.

    nodes: document_id, node_id, parent_id (null at the top), position, role, page_number (null: the
    parent's), text. Rows are the TR below a table, or below its THead, TBody or TFoot; cells their TH and TD
    with all text below them in order. Tables within tables are text of their cells. A document's
    tree is read in one task.
    """
    schema = nodes.schema["document_id"].dataType.simpleString()

    def read(x):
        import pandas as pd

        known = {n.node_id: n for n in x.itertuples()}
        below: dict = {}
        for n in x.sort_values(["position", "node_id"]).itertuples():
            below.setdefault(None if pd.isna(n.parent_id) else n.parent_id, []).append(n.node_id)

        def children(i, *roles):
            return [k for k in below.get(i, []) if known[k].role in roles]

        def text(i) -> str:
            parts, todo = [], [i]
            while todo:
                k = todo.pop()
                if isinstance(known[k].text, str):
                    parts.append(known[k].text.replace("﻿", "").strip())
                todo += reversed(below.get(k, []))
            return " ".join(p for p in parts if p)

        found, todo = [], [(i, None) for i in reversed(below.get(None, []))]
        while todo:
            i, page = todo.pop()
            page = page if pd.isna(known[i].page_number) else int(known[i].page_number)
            if known[i].role != "Table":
                todo += [(k, page) for k in reversed(below.get(i, []))]
                continue
            lines = [r for k in children(i, "TR", "THead", "TBody", "TFoot") for r in ([k] if known[k].role == "TR" else children(k, "TR"))]
            rows = [cells for r in lines if (cells := [text(c) for c in children(r, "TD", "TH")])]
            if rows:
                found.append((x.document_id.iloc[0], i, page, rows))
        return pd.DataFrame(found, columns=["document_id", "table_id", "page_number", "rows"]).astype({"page_number": "Int64"})

    rows = nodes.select("document_id", "node_id", "parent_id", "position", "role", "page_number", "text")
    return rows.groupBy("document_id").applyInPandas(read, f"document_id {schema}, table_id {nodes.schema['node_id'].dataType.simpleString()}, page_number bigint, rows array<array<string>>")


def padded(rows: Column) -> Column:
    """Rows of equal width: cells stripped, line ends as <br>, missing ones empty."""
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    clean = lambda c: t.strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit("<br>")))
    return F.transform(rows, lambda r: F.concat(F.transform(r, clean), F.array_repeat(F.lit(""), width - F.size(r))))


def table_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(document_id, page_number, table_id, other_id): each structure table with the found table of its
    page that it is most like: least difference in rows, then in width, most cells in common, then
    the higher and the one further left. Tables choose in the order of their ids, and a found table that is
    taken only goes to one for which no other is left.

    left: document_id, page_number, table_id, rows; right: document_id, page_number, other_id, box, rows.
    """
    high, wide = F.size("rows"), F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0))
    a = left.select("document_id", "page_number", "table_id", high.alias("n"), wide.alias("w"))
    b = right.select("document_id", "page_number", "other_id", "box", high.alias("m"), wide.alias("v"))
    met = a.join(b, ["document_id", "page_number"])
    rank = F.struct(F.abs(F.col("n") - F.col("m")), F.abs(F.col("w") - F.col("v")), -F.least("n", "m") * F.least("w", "v"), F.col("box.y0"), F.col("box.x0"), F.col("other_id"))
    wishes = met.groupBy("document_id", "page_number", "table_id").agg(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["other_id"]).alias("wish"))
    page = wishes.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("table_id", "wish"))).alias("tables"))
    other = right.schema["other_id"].dataType.simpleString()

    def choose(taken: Column, x: Column) -> Column:
        free = F.filter(x["wish"], lambda k: ~F.array_contains(taken, k))
        return F.concat(taken, F.array(F.coalesce(F.get(free, 0), F.get(x["wish"], 0))))

    # Tables of one page; the choices are kept in the order of the tables.
    page = page.withColumn("chosen", F.aggregate("tables", F.array().cast(f"array<{other}>"), choose))
    pairs = F.transform("tables", lambda x, i: F.struct(x["table_id"].alias("table_id"), F.get("chosen", i).alias("other_id")))
    return page.select("document_id", "page_number", F.explode(pairs).alias("x")).select("document_id", "page_number", "x.*")


def filled(rows: Column, other: Column) -> Column:
    """Padded rows whose empty cells are filled with those at the same place of another table."""
    return F.transform(padded(rows), lambda r, i: F.transform(r, lambda c, k: F.when(c != "", c).otherwise(t.strip(F.coalesce(F.get(F.get(other, i), k), F.lit(""))))))


def _cell(c: Column) -> Column:
    return t.collapse(F.replace(c, F.lit("|"), F.lit(" ")))


def _filled_cells(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, r"\|"), lambda x: t.strip(x) != ""), _cell)


def citation_table(*texts: Column) -> Column:
    """struct<markdown, n_rows, n_columns>: the table of a citation, from the first of its texts that
    isn't empty. Periods are in the line that names a series table, or in the first one of four cells; rows are
    `label: value | value`, distinct, with a value for each period. Two rows make a table, ten are shown."""
    named = lambda x: x.contains("|") & F.lower(x).contains("series table")
    plain = lambda x: (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 3) & ~x.contains(":")
    title = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)\*+\[series table\]\*+", ""), r"^[ :\-]+|[ :\-]+$", "")
    label = lambda x: _cell(F.regexp_replace(F.substring_index(x, ":", 1), r"^[* ]+|[* ]+$", ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

    def first_head(lines: Column) -> Column:
        heads = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.when(named(x), _filled_cells(title(x))).when(plain(x), _filled_cells(x)).otherwise(F.array().cast("array<string>")).alias("cells")))
        return F.get(F.filter(heads, lambda x: F.size(x["cells"]) > 0), 0)

    def rows_below(lines: Column, head: Column) -> Column:
        after = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda x: (x["i"] > head["i"]) & x["x"].contains(":") & x["x"].contains("|"))
        made = F.transform(after, lambda x: F.concat(F.array(label(x["x"])), _filled_cells(F.substring(x["x"], F.length(F.substring_index(x["x"], ":", 1)) + 2, F.length(x["x"])))))
        return F.array_distinct(F.filter(made, lambda r: (F.size(r) == F.size(head["cells"]) + 1) & (F.get(r, 0) != "")))

    def shown(whole: Column, head: Column, rows: Column) -> Column:
        columns = F.concat(F.array(F.lit("항목")), head["cells"])
        text = F.concat_ws("\n", line(columns), line(F.transform(columns, lambda _: F.lit("---"))), F.array_join(F.transform(F.slice(rows, 1, MOST_ROWS), line), "\n"))
        ok = head.isNotNull() & (F.size(rows) >= 2) & whole.contains("|")
        none = lambda x, y: F.when(F.coalesce(ok, F.lit(False)), x).otherwise(y)
        return F.struct(none(text, "").alias("markdown"), none(F.size(rows), 0).alias("n_rows"), none(F.size(columns), 0).alias("n_columns"))

    def read(whole: Column) -> Column:
        lines = F.filter(F.transform(F.split(whole, "\n"), lambda x: F.regexp_replace(t.strip(x), r"^\*+\s*", "")), lambda x: t.strip(x) != "")
        return t.let(lines, lambda own: t.let(first_head(own), lambda head: t.let(rows_below(own, head), lambda rows: shown(whole, head, rows))))

    # Each step is computed once: later ones name it for every line and cell.
    quotes = [t.let(t.quoted(x), lambda q: F.when(q != "", q)) for x in map(t.text, texts)]
    return t.let(F.coalesce(*quotes, F.lit("")), read)


def _parts(colour: Column) -> tuple[Column, Column, Column]:
    return colour[0], colour[1], colour[2]


def _coloured(colour: Column, test: Column) -> Column:
    return F.coalesce((F.size(colour) >= 3) & test, F.lit(False))


def is_horizontal_line(box: str, colour: Column, least: float) -> Column:
    return (F.col(f"{box}.x1") - F.col(f"{box}.x0") >= least) & (F.col(f"{box}.y1") - F.col(f"{box}.y0") <= 0.01) & colour.isNotNull()


def is_orange(colour: Column) -> Column:
    r, g, b = _parts(colour)
    return _coloured(colour, (r > 0.85) & g.between(0.35, 0.65) & (b < 0.25))


def is_white(colour: Column) -> Column:
    return _coloured(colour, reduce(lambda a, x: a & (x > WHITE), _parts(colour), F.lit(True)))


def is_key_gray(colour: Column) -> Column:
    r, g, b = _parts(colour)
    return _coloured(colour, (F.abs(r - g) < GRAY_APART) & (F.abs(g - b) < GRAY_APART) & r.between(0.70, 0.97))


def largest_fill(drawings: DataFrame, page_cols: list[str]) -> DataFrame:
    """The largest filled box of each page that is neither white nor nearly the whole sheet (page_width,
    page_height)."""
    wide, high = F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")
    sheet = (wide > F.col("page_width") * SHEET) & (high > F.col("page_height") * SHEET)
    rows = drawings.where(F.col("fill").isNotNull() & ~is_white(F.col("fill")) & ~sheet)
    return rows.groupBy(*page_cols).agg(F.max_by("box", F.struct(wide * high, -F.col("box.y0"), -F.col("box.x0"))).alias("box"))


def page_contexts(pages: DataFrame, blocks: DataFrame, images: DataFrame, tables: DataFrame) -> DataFrame:
    """Pages (document_id, page_number, width, height) with their text blocks (text, box), image boxes and
    table boxes; blocks without text don't count."""
    key = ["document_id", "page_number"]
    text = t.strip(F.replace(t.text("text"), F.lit("\r"), F.lit("\n")))
    shown = blocks.select(*key, "block_index", text.alias("text"), "box").where("text <> ''")
    shown = shown.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text", "box"))), lambda x: F.struct(x["text"].alias("text"), x["box"].alias("box"))).alias("text_blocks"))
    out = pages.join(shown, key, "left")
    for name, df in (("image_boxes", images), ("table_boxes", tables)):
        out = out.join(df.groupBy(*key).agg(F.array_sort(F.collect_list("box")).alias(name)), key, "left")
    empty = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("text_blocks", "image_boxes", "table_boxes")}
    return out.withColumns(empty)


def with_picture_texts(lines: DataFrame, results: DataFrame) -> DataFrame:
    """(document_id, markdown) of lines (document_id, line_index, page_number, ordinal, line; ordinal: of the
    left-out pictures of a page, else null). A mark of a left-out picture becomes the text of its marked
    content, else what was recognised (results: document_id, page_number, ordinal, mcid_text, ocr_text,
    box), once for each page, place and text; without text it goes."""
    own = t.strip(t.text("mcid_text"))
    text = F.when(own != "", own).otherwise(t.strip(t.text("ocr_text")))
    kind = F.when(own != "", "picture mcid").otherwise("picture ocr")
    place = F.when(F.col("box").isNotNull(), F.concat_ws(",", *(F.rint(F.col(f"box.{k}")).cast("long").cast("string") for k in ("x0", "y0", "x1", "y1"))))
    found = results.select("document_id", "page_number", "ordinal", text.alias("__text"), kind.alias("__kind"), F.coalesce(place, F.lit("")).alias("__place"))
    rows = lines.join(found, ["document_id", "page_number", "ordinal"], "left")
    same = Window.partitionBy("document_id", "page_number", "__place", t.collapse(t.text("__text"))).orderBy("line_index")
    rows = rows.withColumn("__n", F.when(F.col("ordinal").isNotNull(), F.row_number().over(same)))
    inner = F.filter(F.transform(F.split("__text", "\n"), t.strip), lambda x: x != "")
    frame = lambda end: F.concat(F.lit(f"**----- {end} of "), F.col("__kind"), F.lit(" -----**<br>"))
    block = F.concat_ws("\n", F.lit(""), frame("Start"), F.transform(inner, lambda x: F.concat(x, F.lit("<br>"))), frame("End"))
    shown = F.when(F.col("ordinal").isNull(), F.col("line")).when((F.col("__n") == 1) & (F.coalesce("__text", F.lit("")) != ""), block)
    rows = rows.withColumn("__shown", shown).where("__shown IS NOT NULL")
    listed = F.array_sort(F.collect_list(F.struct("line_index", "__shown")))
    return rows.groupBy("document_id").agg(F.array_join(F.transform(listed, lambda x: x["__shown"]), "\n").alias("markdown"))


def element_box(elements: DataFrame, element_id: str) -> DataFrame:
    """(document_id, page_number, box): the element of that id, of a document's pages before its asset
    pages (collection: pages or asset_pages), the first in order; box null if it has none."""
    rows = elements.where(t.strip(t.text("element_id")) == element_id)
    first = F.struct((F.col("collection") != "pages").alias("later"), F.col("page_index"), F.col("element_order"))
    return rows.groupBy("document_id").agg(F.min_by(F.struct("page_number", "box"), first).alias("x")).select("document_id", F.coalesce("x.page_number", F.lit(0)).alias("page_number"), "x.box")


def preview_box(c: Column) -> Column:
    """Four numbers between commas as an array, else null."""
    parts = F.filter(F.transform(F.split(t.text(c), ","), t.strip), lambda x: x != "")
    made = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when((F.size(parts) == 4) & ~F.exists(made, lambda x: x.isNull()), made)


def chosen_chunks(qa_mode: Column, hybrid: Column, ready: Column, semantic: Column) -> Column:
    """The chunk array that a document is indexed by: the hybrid one (the default mode), the one for models,
    or the semantic one, also where that of the mode is missing. Chunks without text go; the strategy and
    missing numbers are filled in."""
    mode = F.coalesce(F.when(qa_mode != "", qa_mode), F.lit("hybrid"))
    raw = F.when((mode == "hybrid") & hybrid.isNotNull(), hybrid).when((mode == "llm_ready") & ready.isNotNull(), ready).otherwise(semantic)
    named = F.when(mode == "hybrid", "hybrid").otherwise("semantic")

    def one(x: Column, i: Column) -> Column:
        body = t.strip(t.text(x["text"]))
        number = F.coalesce(F.when(x["chunk_index"] != 0, x["chunk_index"]), i).cast("int")
        size = F.coalesce(F.when(x["char_count"] != 0, x["char_count"]), F.length(body)).cast("int")
        return F.struct(F.coalesce(F.when(x["strategy"] != "", x["strategy"]), named).alias("strategy"), number.alias("chunk_index"), body.alias("text"), size.alias("char_count"))

    return F.filter(F.transform(raw, one), lambda x: x["text"] != "")


def cached_summary(ui: Column, llm: Column, document_type: Column) -> Column:
    """The summary that is shown: that of the viewer if a model wrote it (is_llm), else that of the
    pipeline, else null; key points give way to highlights."""

    def shown(x: Column, model: str, source: str, pages: Column) -> Column:
        points = F.when(F.size(x["key_points"]) > 0, x["key_points"]).otherwise(F.coalesce(x["highlights"], F.array().cast("array<string>")))
        return F.struct(
            F.coalesce(x["summary_text"], F.lit("")).alias("summary_text"),
            points.alias("key_points"),
            F.coalesce(pages, F.array().cast("array<string>")).alias("page_summaries"),
            F.coalesce(F.when(x["document_type"] != "", x["document_type"]), document_type, F.lit("")).alias("document_type"),
            F.coalesce(F.when(x["used_model"] != "", x["used_model"]), F.lit(model)).alias("used_model"),
            F.lit(source).alias("summary_source"),
        )

    first = shown(ui, "cached_ui_summary", "cached_ui_summary", ui["page_summaries"])
    second = shown(llm, "cached_llm_summary", "pipeline_llm_summary", ui["page_summaries"])
    return F.when(F.coalesce(ui["is_llm"], F.lit(False)), first).when(F.coalesce(llm["is_llm"], F.lit(False)), second)
