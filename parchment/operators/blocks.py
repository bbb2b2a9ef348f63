"""Lines to blocks: normalised lines, their roles, and titles, lists, key-value and row tables.

Roles are Catalyst expressions. Only the greedy reading of a document's line sequence, which looks
ahead, is an Arrow-batched Python stage; it gets the roles as booleans and tests no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import text as t

#: Limits of titles, labels, tables and chunks, and titles that are always allowed.
MAX_TITLE = 32
MAX_LABEL = 24
MAX_LABELS, MIN_LABELS = 6, 2
MIN_ITEMS = 2
MIN_ROW_LABELS, MIN_ROW_VALUES = 6, 5
CHUNK_PARAGRAPHS, CHUNK_CHARS = 3, 700
SHORT_PARAGRAPH = 40
TITLES = ("목차", "개요", "현황", "실적", "개최일자", "참석인원", "주요 의결사항")
SINGLE_MARKS = ("-", "*", "•", "·", "※")
#: Patterns of line roles.
NUMBERED_TITLE = r"^(?:\d+|[가-하])[.)](?:\s*\D.*)?$"
CHAPTER = r"^제\s*\d+\s*[장절조항목](?:\s|$)"
BULLET = r"^(?:[-*•·※]\s*|[①-⑳]\s*|[ㄱ-ㅎ][.)]\s*|[가-하][.)]\s*|(?:\d+|[A-Za-z])[.)](?=\s*\D)\s*)"
DATE_VALUE = r"^\d{4}[./-]\d{1,2}[./-]\d{1,2}$"
NUMERIC_VALUE = r"^[\d,]+(?:\.\d+)?%?$"
DAY_VALUE = r"^\d{1,2}\.\d{1,2}$"
TERMINAL = "[.!?。！？:]$"
KOREAN_ENDING = r"(?:다|니다|함|됨|음)\.?$"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(document_id, lines): line_index, text, indent and page of the lines that count."""
    lines = F.split(t.unix_lines(t.text(text_col)), "\n", -1)
    rows = docs.select(F.col(id_col).alias("document_id"), lines.alias("l"))
    feeds = F.transform("l", lambda x: F.length(x) - F.length(F.translate(x, "\f", "")))
    counted = F.aggregate(feeds, F.array(F.lit(1)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    # Few texts have form feeds; only they pay for the fold.
    pages = F.when(F.exists("l", lambda x: x.contains("\f")), F.slice(counted, F.lit(2), F.size("l")))
    rows = rows.withColumn("p", pages)
    raw = F.transform("l", lambda x, i: F.struct((i + 1).alias("line_index"), F.regexp_replace(x, "\f", " ").alias("raw"), F.coalesce(F.get("p", i), F.lit(1)).alias("page")))
    text = lambda x: t.strip(F.regexp_replace(F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), r"[ \t]{2,}", " "))
    indent = lambda x: F.length(F.regexp_extract(x, r"^[ \t]*", 0))
    made = F.transform(raw, lambda x: F.struct(x["line_index"].alias("line_index"), text(x["raw"]).alias("text"), indent(x["raw"]).alias("indent"), x["page"].alias("page")))
    return rows.select("document_id", F.filter(made, lambda x: (x["text"] != "") & ~is_noise(x["text"])).alias("lines"))


def normalised_lines(docs: DataFrame, id_col: str = "document_id", text_col: str = "markdown") -> DataFrame:
    """(document_id, line_index, text, indent, page): lines without control characters, blank lines
    and noise. Lines count from 1; a form feed begins a page."""
    return _lines(docs, id_col, text_col).select("document_id", F.explode("lines").alias("x")).select("document_id", "x.*")


def classified_documents(docs: DataFrame, id_col: str = "document_id", text_col: str = "markdown") -> DataFrame:
    """(document_id, lines): the classified lines of each document in its own row, so that nothing is
    shuffled to read them together."""
    rows = _lines(docs, id_col, text_col)
    named = F.transform("lines", lambda x: F.struct(x["line_index"].alias("line_index"), x["text"].alias("text"), x["indent"].alias("indent"), x["page"].alias("page"), label(x["text"]).alias("label")))
    rows = rows.withColumn("lines", named)
    plain = ("line_index", "text", "indent", "page")

    def one(x: Column) -> Column:
        return F.struct(*(x[k].alias(k) for k in plain), *(v.alias(k) for k, v in roles(x["text"], x["label"]).items()))

    return rows.withColumn("lines", F.transform("lines", one))


def is_noise(c: Column) -> Column:
    """Single characters that are no bullet, digit or allowed title."""
    return (F.length(c) < 2) & ~c.isin(*SINGLE_MARKS, *TITLES) & ~c.rlike(r"^\d+$")


def is_list_item(c: Column) -> Column:
    return c.rlike(BULLET)


def is_value(c: Column) -> Column:
    return c.rlike(DATE_VALUE) | c.rlike(NUMERIC_VALUE) | (c.rlike(r"\d") & (F.length(c) <= 24))


def words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0)))


def is_title(c: Column) -> Column:
    short = (F.length(c) <= MAX_TITLE) & ~is_list_item(c) & ~is_value(c) & ~c.rlike(TERMINAL) & ~c.rlike(KOREAN_ENDING) & (words(c) <= 4)
    return c.isin(*TITLES) | c.rlike(NUMBERED_TITLE) | c.rlike(CHAPTER) | short


def label(c: Column) -> Column:
    """A label as it counts: single characters written apart are put together."""
    return F.when(t.strip(c).rlike(r"(?U)^\S(\s+\S)+$"), F.regexp_replace(c, r"(?U)\s+", "")).otherwise(t.strip(c))


def is_label(c: Column) -> Column:
    return _labels(label(c))


def _labels(n: Column) -> Column:
    return ~is_list_item(n) & ~is_value(n) & ~n.rlike(KOREAN_ENDING) & (F.length(n) <= MAX_LABEL) & (words(n) <= 3)


def roles(c: Column, n: Column) -> dict[str, Column]:
    """What a line can be; n: the line as a label."""
    kind = F.when(is_title(c), "title").when(is_list_item(c), "list").when(c.rlike("(?U)^[^\\w가-힣]+$"), "unknown").otherwise("paragraph")
    tabular = ~n.startswith("(") & ~is_list_item(n) & ~n.rlike(KOREAN_ENDING) & ~(is_value(n) & ~n.endswith("년")) & (F.length(n) <= MAX_LABEL)
    return {
        "block_type": kind,
        "label": n,
        "is_label": _labels(n),
        "is_value": is_value(c),
        "is_scalar": is_value(c) | ((F.length(c) <= MAX_TITLE) & ~_labels(n)),
        "is_tabular": tabular,
        "is_cell": c.rlike(DATE_VALUE) | c.rlike(NUMERIC_VALUE) | c.rlike(DAY_VALUE),
        "ends": c.rlike(TERMINAL),
        "plain": t.strip(F.regexp_replace(t.strip(F.regexp_replace(c, BULLET, "")), r"^\.", "")),
    }


def classified(lines: DataFrame) -> DataFrame:
    """Lines with block_type (title, list, unknown, paragraph), role flags and reasons."""
    return lines.withColumns(roles(F.col("text"), label(F.col("text")))).withColumn(
        "reasons",
        F.when(F.col("block_type") == "title", F.array(F.lit("title_rule")))
        .when(F.col("block_type") == "list", F.array(F.lit("list_rule")))
        .otherwise(F.array_compact(F.array(F.when(F.col("is_label"), F.lit("kv_label_rule")), F.when(F.col("is_value"), F.lit("kv_value_rule"))))),
    )


class Reader:
    """Reads one document's classified lines into blocks, the first reading that fits: row table,
    key-value table, title, list, paragraph. The last title is the section of what follows."""

    def __init__(self, lines: list[dict]) -> None:
        self.lines = lines
        self.section: str | None = None

    def run(self, start: int, test) -> int:
        """The end of the lines from `start` on that pass a test."""
        end = start
        while end < len(self.lines) and test(self.lines[end]):
            end += 1
        return end

    def row_table(self, i: int) -> tuple[dict, int] | None:
        split = self.run(i, lambda x: x["block_type"] != "list" and x["is_tabular"])
        names = [x["label"] for x in self.lines[i:split]]
        if len(names) < MIN_ROW_LABELS or len(set(names)) == len(names):
            return None
        end = self.run(split, lambda x: x["block_type"] not in ("title", "list") and x["is_cell"])
        if end - split < MIN_ROW_VALUES:
            return None
        cut = len(names) - 6 if len(set(names[-6:])) <= 2 else next(k for k in range(len(names)) if names[k] in names[:k])
        return {"type": "row_table", "header_rows": [names[:cut], names[cut:]], "rows": [[x["text"] for x in self.lines[split:end]]]}, end

    def kv_table(self, i: int) -> tuple[dict, int] | None:
        split = min(self.run(i, lambda x: x["block_type"] != "list" and x["is_label"]), i + MAX_LABELS)
        names = [x["label"] for x in self.lines[i:split]]
        if len(names) < MIN_LABELS or split == len(self.lines):
            return None
        middle = self.run(split, lambda x: x["block_type"] not in ("title", "list") and not (x["is_label"] and not x["is_value"]) and x["is_scalar"])
        end = self.run(middle, lambda x: x["block_type"] == "list")
        if end == split:
            return None
        scalars = [x["text"] for x in self.lines[split:middle]]
        items = [x["plain"] for x in self.lines[middle:end]]
        # Values go to the labels in order; list items, and values before them that are left, to the last one.
        lead = min(len(scalars), len(names) - 1) if items else len(scalars)
        fields = dict(zip(names, ([x] for x in scalars[:lead]), strict=False))
        if items:
            fields[names[-1]] = scalars[lead:] + items
        else:
            fields |= {name: [""] for name in names[lead:]}
        return {"type": "kv_table", "fields": fields}, end

    def list_block(self, i: int) -> tuple[dict, int]:
        end = self.run(i, lambda x: x["block_type"] == "list" and abs(x["indent"] - self.lines[i]["indent"]) <= 4)
        items = [x["plain"] for x in self.lines[i:end]]
        if len(items) >= MIN_ITEMS:
            return {"type": "list", "items": items}, end
        return {"type": "paragraph", "content": " ".join(filter(None, items))}, end

    def paragraph(self, i: int) -> tuple[dict, int]:
        end = i + 1
        while end < len(self.lines) and self.goes_on(self.lines[end - 1], self.lines[end]) and self.lines[end]["block_type"] not in ("title", "list") and not self.kv_table(end):
            end += 1
        part = self.lines[i:end]
        unknown = all(x["block_type"] == "unknown" for x in part)
        return {"type": "unknown" if unknown else "paragraph", "content": " ".join(x["text"] for x in part)}, end

    @staticmethod
    def goes_on(a: dict, b: dict) -> bool:
        return len(a["text"]) <= SHORT_PARAGRAPH or not a["ends"] or len(b["text"]) <= SHORT_PARAGRAPH

    def blocks(self) -> list[dict]:
        out, i = [], 0
        while i < len(self.lines):
            line = self.lines[i]
            found = self.row_table(i) or self.kv_table(i)
            if found is None and line["block_type"] == "title":
                self.section = self.section if line["text"].startswith("(") else line["text"]
                found = {"type": "title", "content": line["text"]}, i + 1
            found = found or (self.list_block(i) if line["block_type"] == "list" else self.paragraph(i))
            block, end = found
            out.append({"section": self.section, "page": line["page"], "line_start": line["line_index"], "line_end": self.lines[end - 1]["line_index"], **block})
            i = end
        return out


def serialized(block: dict) -> str:
    """A block as text for embedding, under its section."""
    head = f"[{block['section']}]\n" if block.get("section") else ""
    kind = block["type"]
    if kind == "title":
        return f"[{block['content']}]"
    if kind == "list":
        body = "\n".join(f"* {x}" for x in block["items"])
    elif kind == "kv_table":
        body = "\n".join(f"{k}: {v[0] if v else ''}" if len(v) < 2 else "\n".join([f"{k}:", *(f"* {x}" for x in v)]) for k, v in block["fields"].items())
    elif kind == "row_table":
        named = [(f"header_row_{i}", r) for i, r in enumerate(block["header_rows"], 1)] + [(f"row_{i}", r) for i, r in enumerate(block["rows"], 1)]
        body = "\n".join(f"{n}: {' | '.join(r)}" for n, r in named)
    else:
        body = block["content"]
    return f"{head}{body}".strip()


def grouped(blocks: list[dict]) -> list[list[dict]]:
    """Blocks by chunk: a title with what follows it, up to three paragraphs of one section and 700
    characters together, anything else alone."""
    out: list[list[dict]] = []
    i = 0
    while i < len(blocks):
        group = [blocks[i]]
        i += 1
        if group[0]["type"] == "title" and i < len(blocks):
            group.append(blocks[i])
            i += 1
        last = group[-1]
        if last["type"] == "paragraph":
            size, n = len(last["content"]), 1
            while i < len(blocks) and n < CHUNK_PARAGRAPHS and blocks[i]["type"] == "paragraph" and blocks[i]["section"] == last["section"] and size + len(blocks[i]["content"]) <= CHUNK_CHARS:
                size += len(blocks[i]["content"])
                n += 1
                group.append(blocks[i])
                i += 1
        out.append(group)
    return out


_BLOCK = "struct<type:string,section:string,page:int,line_start:int,line_end:int,content:string,items:array<string>,fields:map<string,array<string>>,header_rows:array<array<string>>,rows:array<array<string>>,text:string,chunk:int>"


def blocks(lines: DataFrame) -> DataFrame:
    """(document_id, block_index, block): the blocks of classified lines, with the number of the
    chunk that each is in. One document's lines are read together: rows of classified_documents as they
    are, single lines after a shuffle."""
    names = ["line_index", "text", "indent", "page", "block_type", "label", "is_label", "is_value", "is_scalar", "is_tabular", "is_cell", "ends", "plain"]
    if "lines" in lines.columns:
        docs = lines.select("document_id", F.transform("lines", lambda x: F.struct(*(x[k].alias(k) for k in names))).alias("lines"))
    else:
        docs = lines.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("lines"))
    kind = docs.schema["document_id"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for frame in batches:
            ids, found = [], []
            for doc, own in zip(frame.document_id, frame.lines, strict=True):
                made = Reader([dict(x) if not hasattr(x, "asDict") else x.asDict() for x in own]).blocks()
                for number, group in enumerate(grouped(made)):
                    for block in group:
                        block |= {"chunk": number, "text": serialized(block)}
                ids.append(doc)
                found.append([{k: b.get(k) for k in ("type", "section", "page", "line_start", "line_end", "content", "items", "fields", "header_rows", "rows", "text", "chunk")} for b in made])
            yield pd.DataFrame({"document_id": pd.Series(ids, dtype=frame.document_id.dtype), "blocks": found})

    out = docs.mapInPandas(run, f"document_id {kind}, blocks array<{_BLOCK}>")
    return out.select("document_id", F.posexplode("blocks").alias("block_index", "block"))


def chunks(found: DataFrame) -> DataFrame:
    """(document_id, chunk_index, section, page, line_start, line_end, text) of blocks."""
    rows = F.sort_array(F.collect_list(F.struct("block_index", "block.text", "block.section", "block.page")))
    out = found.groupBy("document_id", F.col("block.chunk").alias("chunk_index")).agg(rows.alias("r"), F.min("block.line_start").alias("line_start"), F.max("block.line_end").alias("line_end"))
    first = lambda name: F.get(F.filter(F.transform("r", lambda x: x[name]), lambda x: x.isNotNull()), 0)
    return out.select("document_id", "chunk_index", first("section").alias("section"), first("page").alias("page"), "line_start", "line_end", F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"))
