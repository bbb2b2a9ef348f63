"""Decoders on bytes made here, and what follows from them."""

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from parchment.sources import adapters, binary_tables, files, office, pdf

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="h2"><w:name w:val="heading 2"/></w:style></w:styles>')
    return out.getvalue()


def para(text: str, style: str = "") -> str:
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"


def record(tag: int, payload: bytes, extended: bool = False) -> bytes:
    size = 0xFFF if extended else len(payload)
    return struct.pack("<I", tag | size << 20) + (struct.pack("<I", len(payload)) if extended else b"") + payload


def test_docx():
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in (["a", "b"], ["1"])) + "</w:tbl>"
    got = office.docx_text(docx(para("Title", "h2") + table + para("  ") + para("Body")))
    assert got == "## Title\n\nBody\n\n[표: 2행 × 2열]\n| a | b |\n| --- | --- |\n| 1 |  |"


def test_hwp():
    control = struct.pack("<8H", 2, 1, 1, 1, 1, 1, 1, 2)
    text = "첫 줄".encode("utf-16-le") + control + "\t끝\n".encode("utf-16-le") + b"\0\0"
    section = record(66, b"skip") + record(office.PARAGRAPH, text) + record(office.PARAGRAPH, "둘째".encode("utf-16-le"), extended=True) + b"\x43\x00"
    packed = zlib.compressobj(wbits=-15)
    assert office.hwp_text(packed.compress(section) + packed.flush()) == "첫 줄\t끝\n둘째"
    assert office.hwp_text(section) == "첫 줄\t끝\n둘째"
    assert list(office.hwp_records(record(1, b"abc")[:-1])) == []


def test_broken_files_are_rows(spark):
    rows = [("a.docx", docx(para("fine"))), ("b.docx", b"no zip"), ("c.docx", None)]
    got = {r.path: (r.text, r.error) for r in office.decoded(spark.createDataFrame(rows, "path string, content binary"), office.docx_text).collect()}
    assert got["a.docx"] == ("fine", None) and got["b.docx"][0] is None and "BadZipFile" in got["b.docx"][1] and got["c.docx"][1] == "no content"


def test_files(spark, tmp_path):
    texts = {"a.txt": "plain é".encode(), "b.TXT": "﻿marked".encode(), "c.txt": "한글 문서".encode("cp949"), "README.md": b"x", "d.log": b"x", "sub/e.txt": "caf\xe9\x81".encode("latin-1")}
    for name, raw in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    found = files.discover(spark, f"file://{tmp_path}")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.encoding) for r in files.decode_texts(found).collect()}
    assert got == {"a.txt": ("plain é", "utf-8"), "b.TXT": ("marked", "utf-8-sig"), "c.txt": ("한글 문서", "cp949"), "e.txt": ("caf\xe9\x81", "latin-1")}
    assert {r.route.document_type for r in found.collect()} == {"txt"}


def test_useful_runs(spark):
    text = "\x01\x02This is a useful sentence\x00aaaaaaaaaaaaaaa\x03.,.,.,.,.,.,.,\x04Another run of text 42"
    got = spark.createDataFrame([(text,)], "t string").select(office.useful_runs(F.col("t"))).first()[0]
    assert got == ["This is a useful sentence", "Another run of text 42"]


def test_pdf_choices(spark):
    long = "x" * 60
    row = spark.createDataFrame([("short", long, "last", "Microsoft PowerPoint", "Figure 3 of it\nmore")], "a string, b string, c string, p string, cap string").select(
        pdf.first_usable(F.col("a"), F.col("b"), F.col("c")).alias("t"), pdf.first_usable(F.col("a"), F.col("c")).alias("u"), pdf.strategy(F.col("p")).alias("s"), pdf.is_caption(F.col("cap")).alias("cap")
    ).first()
    assert tuple(row) == (long, "last", "structtree", True)
    cells = [([["a", "b"], ["1", "2"]], True), ([["a", "b"]], False), ([["a"], ["b"]], False), ([["a"] + [""] * 9, [""] * 10], False)]
    got = [r[0] for r in spark.createDataFrame(cells, "cells array<array<string>>, want boolean").select(pdf.keep_table(F.lit(0.1), F.col("cells"))).collect()]
    assert got == [w for _, w in cells]


def test_binary_tables(spark):
    text = "before\rName\x07Total\x07\x07\rA\x071\x07\x07\rafter"
    cells = [c for r in ([f"항목{i}" for i in range(6)], list("123456"), list("abcdef")) for c in r]
    row = spark.createDataFrame([(text, cells)], "t string, long array<string>").select(
        binary_tables.cell_mark_rows(F.col("t")).alias("rows"), binary_tables.reshaped(F.col("long")).alias("r"), binary_tables.header_rows(binary_tables.cell_mark_rows(F.col("t"))).alias("h")
    ).first()
    assert row.rows == [["Name", "Total", ""], ["A", "1", ""]] and row.h == 1 and [len(r) for r in row.r] == [6, 6, 6]
    raw = b"zz" + struct.pack("<HHB3h", binary_tables.TABLE_DEFINITION, 9, 2, 0, 100, 250) + struct.pack("<HHB", binary_tables.TABLE_DEFINITION, 9, 9)
    assert list(binary_tables.table_definitions(raw)) == [[0, 100, 250]]


def test_definitions_and_edges(spark):
    rows = spark.createDataFrame([(1, p, n) for p, n in enumerate([2, 2, 3, 2, 2, 2])], "document_id int, position int, n_columns int")
    defs = spark.createDataFrame([(1, 0, 2, [0, 100, 200]), (1, 1, 3, [0, 50, 100, 200]), (1, 2, 2, [0, 120, 210])], "document_id int, number int, n_columns int, edges array<int>")
    got = binary_tables.attach_definitions(rows, defs)
    assert [r.edges[1] for r in got.orderBy("position").collect()] == [100, 100, 50, 120, 120, 120]
    edges = binary_tables.master_edges(got, ["document_id"], 30).orderBy("column").collect()
    assert [(r.column, r["from"], r.to) for r in edges] == [(0, 0, 50), (1, 50, 100), (2, 100, 200)]


@pytest.mark.parametrize(("error", "calls"), [(TimeoutError(), 4), (ConnectionError(), 4), (ValueError(), 1)])
def test_retries(error, calls):
    made, waits = [], []

    def call():
        made.append(1)
        raise error

    with pytest.raises(type(error)):
        adapters.with_retries(call, sleep=waits.append)
    assert len(made) == calls and len(waits) == calls - 1 and all(0 <= w <= 30 for w in waits)


def test_retry_after_and_answers():
    class Busy(Exception):
        code = 429
        headers = {"Retry-After": "7"}

    waits = []
    with pytest.raises(Busy):
        adapters.with_retries(lambda: (_ for _ in ()).throw(Busy()), retries=1, sleep=waits.append)
    assert waits == [7.0]
    assert adapters.json_answer('{"a": 1}') == {"a": 1}
    assert adapters.json_answer('Sure: {"a": 2} done') == {"a": 2}
    assert adapters.json_answer(" plain ") == {"summary_text": "plain"}
    assert adapters.citation_marks("Yes [1]. And [3] no [2].", {1: 2, 2: 1}) == "Yes [2]. And no [1]."
    vector = adapters.HashEmbedder().embed(["two words", ""])
    assert abs(sum(x * x for x in vector[0]) - 1) < 1e-9 and not any(vector[1])
