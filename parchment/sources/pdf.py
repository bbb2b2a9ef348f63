"""What is computed from the pages, runs and images that a PDF reader delivers. No reader is part of
the library: one is injected as a function of bytes (see parchment.sources.adapters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import text as t

#: The mark of a left-out picture, and limits of tables and texts.
OMITTED = r"==>\s*picture\s*\[(\d+)\s*x\s*(\d+)\]\s*intentionally omitted\s*<=="
LEAST_PAGE_CHARS, LEAST_TEXT = 30, 50
LEAST_FIT = 0.45


def document_kind(pages: DataFrame, id_col: str = "document_id") -> DataFrame:
    """scanned: no page with text and some with images; digital: every page has 30 characters;
    else mixed. Pages: text, n_images."""
    full = F.length(t.strip(t.text("text"))) >= LEAST_PAGE_CHARS
    rows = pages.groupBy(id_col).agg(F.count("*").alias("pages"), F.count_if(full).alias("with_text"), F.count_if(F.col("n_images") > 0).alias("with_images"))
    kind = F.when((F.col("with_text") == 0) & (F.col("with_images") > 0), "scanned").when(F.col("with_text") == F.col("pages"), "digital").otherwise("mixed")
    return rows.withColumn("pdf_kind", kind)


def strategy(producer: Column) -> Column:
    """The markdown strategy that a producer string asks for."""
    p = F.lower(t.text(producer))
    return F.when(p.contains("powerpoint") | p.contains("ppt"), "structtree").otherwise("pymupdf4llm")


def first_usable(*candidates: Column) -> Column:
    """The first text of at least 50 characters, else the last one."""
    return F.coalesce(*[F.when(F.length(t.strip(t.text(c))) >= LEAST_TEXT, c) for c in candidates[:-1]], candidates[-1])


def keep_table(area_share: Column, cells: Column) -> Column:
    """Whether a detected table counts: two rows and columns, not most of a page with many cells,
    and 15 % of its cells filled."""
    flat = F.flatten(cells)
    filled = F.size(F.filter(flat, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
    wide = F.array_max(F.transform(cells, lambda r: F.size(r)))
    return (F.size(cells) >= 2) & (wide >= 2) & ~((area_share > 0.6) & (F.size(flat) > 20)) & (filled >= 0.15 * F.size(flat))


def is_caption(c: Column) -> Column:
    return F.element_at(F.split(t.strip(c), "\n"), 1).rlike(r"(?i)^(그림|Figure|Table)\s*\d*")


def placeholders(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, ordinal, line_index, width, height) of left-out pictures."""
    rows = pages.select("document_id", "page_number", F.posexplode(t.lines(t.text("text"))).alias("line_index", "line"))
    rows = rows.withColumn("w", F.regexp_extract("line", OMITTED, 1)).where("w <> ''")
    order = Window.partitionBy("document_id", "page_number").orderBy("line_index")
    return rows.select("document_id", "page_number", F.row_number().over(order).alias("ordinal"), "line_index", F.col("w").cast("int").alias("width"), F.regexp_extract("line", OMITTED, 2).cast("int").alias("height"))


def match_images(marks: DataFrame, images: DataFrame) -> DataFrame:
    """Placeholders with the image of the same rank on their page (by top, left, larger area), and
    whether it fits: neither side under 45 % of the other's."""
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    order = Window.partitionBy("document_id", "page_number").orderBy("y0", "x0", -(wide * high), "image_id")
    ranked = images.withColumn("ordinal", F.row_number().over(order)).select("document_id", "page_number", "ordinal", "image_id", wide.alias("iw"), high.alias("ih"))
    share = lambda a, b: F.least(a, b) / F.greatest(a, b)
    fits = (share(F.col("width"), F.col("iw")) >= LEAST_FIT) & (share(F.col("height"), F.col("ih")) >= LEAST_FIT)
    joined = marks.join(ranked, ["document_id", "page_number", "ordinal"], "left")
    return joined.withColumn("status", F.when(F.col("image_id").isNull(), "unmatched").when(fits, "matched").otherwise("size_mismatch")).drop("iw", "ih")


def run_blocks(runs: DataFrame) -> DataFrame:
    """Neighbouring structure runs of one block (position, block_id, role, text) as markdown blocks."""
    w = Window.partitionBy("document_id").orderBy("position")
    new = F.coalesce((F.col("block_id") != F.lag("block_id").over(w)).cast("int"), F.lit(0))
    rows = runs.withColumn("__n", new).withColumn("block", F.sum("__n").over(w))
    out = rows.groupBy("document_id", "block").agg(F.first("role").alias("role"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ").alias("text"))
    level = F.regexp_extract("role", r"^H([1-6])$", 1)
    mark = F.when(level != "", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "))).when(F.col("role").isin("LI", "LBody"), "- ").otherwise("")
    return out.select("document_id", "block", "role", F.concat(mark, F.col("text")).alias("markdown"))


def mcid_lookup(runs: DataFrame) -> DataFrame:
    """(document_id, page_number, mcid, texts): at most eight distinct texts of each marked content."""
    rows = runs.groupBy("document_id", "page_number", "mcid").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("r"))
    return rows.select("document_id", "page_number", "mcid", F.slice(F.array_distinct(F.transform("r", lambda x: x["text"])), 1, 8).alias("texts"))
