"""Office files as text: DOCX by its XML, HWP section records, and text runs of old binary files.

Each decoder is a plain function of bytes, applied to Arrow batches of `binaryFile` rows; a file
that can't be read becomes a row with an error, never a failed job.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Fixed value: the record tag of a paragraph's text.
PARAGRAPH = 67
#: What a useful run of an old binary file is.
RUN = r"[0-9A-Za-z가-힣 .,:;()%/\-'\"\[\]]{11,}"
LEAST_CHARS, LEAST_DISTINCT, LEAST_LETTERS, SHARE = 10, 3, 8, 0.35


def docx_text(content: bytes) -> str:
    """Paragraphs, headings as #, then tables as markdown under a size mark."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                named = style.find(f"{_W}name")
                names[style.get(f"{_W}styleId")] = named.get(f"{_W}val", "") if named is not None else ""
    text = lambda node: "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in node.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")).strip()
    parts = []
    for p in body.findall(f"{_W}p"):
        if own := text(p):
            mark = p.find(f"{_W}pPr/{_W}pStyle")
            style = names.get(mark.get(f"{_W}val"), mark.get(f"{_W}val")) if mark is not None else ""
            level = re.sub(r"\D", "", style)
            head = f"{'#' * min(max(int(level or 1), 1), 6)} " if style.lower().startswith("heading") else ""
            parts.append(head + own)
    for table in body.findall(f"{_W}tbl"):
        rows = [["\n".join(filter(None, map(text, cell.findall(f"{_W}p")))) for cell in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")]
        if rows:
            parts.append(sized_table(rows))
    return "\n\n".join(parts)


def sized_table(rows: list[list[str]]) -> str:
    wide = max(map(len, rows))
    full = [r + [""] * (wide - len(r)) for r in rows]
    lines = [full[0], ["---"] * wide, *(full[1:] or [[""] * wide])]
    return "\n".join([f"[표: {len(full)}행 × {wide}열]", *("| " + " | ".join(r) + " |" for r in lines)])


def hwp_records(section: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, payload) of the records of an uncompressed section; a cut-off record ends it."""
    at = 0
    while at + 4 <= len(section):
        (head,) = struct.unpack_from("<I", section, at)
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > len(section):
                return
            (size,) = struct.unpack_from("<I", section, at)
            at += 4
        if at + size > len(section):
            return
        yield head & 0x3FF, section[at : at + size]
        at += size


def hwp_paragraph(payload: bytes) -> str:
    """Text of UTF-16 units; control characters take eight units, but for tabs and line ends."""
    units = struct.unpack(f"<{len(payload) // 2}H", payload[: len(payload) // 2 * 2])
    out, i = [], 0
    while i < len(units):
        u = units[i]
        if u in (9, 10, 13):
            out.append("\t" if u == 9 else "\n")
        elif u >= 32:
            out.append(chr(u))
        elif u and i + 7 < len(units):
            i += 7
        i += 1
    text = "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", re.sub(r"\n[ \t]+", "\n", text))).strip()


def hwp_text(section: bytes) -> str:
    """Paragraphs of one section, which may be raw-deflated."""
    try:
        section = zlib.decompress(section, -15)
    except zlib.error:
        pass
    return "\n".join(filter(None, (hwp_paragraph(p) for tag, p in hwp_records(section) if tag == PARAGRAPH)))


def decoded(files: DataFrame, decode: Callable[[bytes], str], content_col: str = "content") -> DataFrame:
    """files without content, with text and error: what a decoder makes of the bytes."""
    @F.pandas_udf("struct<text:string,error:string>")
    def run(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in contents:
            try:
                rows.append((decode(bytes(raw)), None) if raw is not None else (None, "no content"))
            except Exception as e:  # noqa: BLE001 - any broken file is a row with its error
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    return files.withColumn("__d", run(content_col)).withColumns({"text": F.col("__d.text"), "error": F.col("__d.error")}).drop("__d", content_col)


def useful_runs(text: Column) -> Column:
    """Runs of text in decoded bytes that look like language: at least ten characters, four of them
    different, and a third of letters and digits."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    letters = lambda x: F.length(F.regexp_replace(x, "[^0-9A-Za-z가-힣]", ""))
    different = lambda x: F.size(F.array_distinct(F.split(x, "")))
    good = lambda x: (F.length(x) >= LEAST_CHARS) & (different(x) > LEAST_DISTINCT) & (letters(x) >= F.greatest(F.lit(float(LEAST_LETTERS)), F.length(x) * SHARE))
    return F.array_distinct(F.filter(runs, good))


def paragraph_elements(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(…, page_number, element_order, element_id, text): paragraphs between blank lines on one page."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n\s*\n+", -1), lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")), lambda x: x != "")
    rows = docs.select(*[c for c in docs.columns if c != text_col], F.posexplode(parts).alias("i", "text"))
    order = F.col("i") + 1
    return rows.withColumns({"page_number": F.lit(1), "element_order": order, "element_id": F.concat(F.lit("p1-e"), order.cast("string"))}).drop("i")


def element_summary(elements: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Counts per document: pages, elements, characters."""
    return elements.groupBy(id_col).agg(F.countDistinct("page_number").alias("pages"), F.count("*").alias("elements"), F.sum(F.length("text")).alias("characters"))
