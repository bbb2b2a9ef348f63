"""Images, structure tables, table pairs and picture texts on small inputs, by hand and by brute force."""

import random

from pyspark.sql import functions as F

from parchment.operators import structures
from parchment.operators import visual as v

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_draws_in_nested_marks(spark):
    stream = "/A Do /P <</MCID 3>> BDC /A Do /Span BMC /B Do EMC /X Do EMC /B Do /P <</MCID 4>> BDC /Q <</MCID 5>> BDC /A Do EMC /A Do EMC EMC /A Do"
    df = spark.createDataFrame([(1, 1, stream, ["A", "B"]), (1, 2, None, None), (2, 1, "", ["A"])], "document_id int, page_number int, stream string, image_names array<string>")
    got = [(r.draw_index, r.image_name, r.mcid) for r in v.image_draws(df).orderBy("draw_index").collect()]
    assert got == [(0, "A", None), (1, "A", 3), (2, "B", 3), (3, "B", None), (4, "A", 5), (5, "A", 4), (6, "A", None)]


def test_marked_texts_are_distinct_and_eight(spark):
    rows = [(1, 1, 0, i, t, "P", "Span" if i % 2 else "Link") for i, t in enumerate([" a ", "a", None, "b", *"cdefghijk"])]
    got = v.marked_texts(spark.createDataFrame(rows, "document_id int, page_number int, mcid int, position int, text string, block_role string, leaf_role string")).first()
    assert got.mcid_text == "a b c d e f g h" and got.roles == ["P/Link", "P/Span"]


def test_structure_tables(spark):
    nodes = [
        (1, 1, None, 0, "Document", 4, None), (1, 2, 1, 0, "Sect", None, None), (1, 3, 2, 0, "Table", None, "caption"),
        (1, 4, 3, 1, "TR", None, None), (1, 5, 4, 0, "TH", None, "a"), (1, 6, 4, 1, "Span", None, "no cell"),
        (1, 7, 3, 0, "THead", None, None), (1, 8, 7, 0, "TR", None, None), (1, 9, 8, 0, "TD", None, " head﻿ "), (1, 10, 9, 0, "Span", None, "more"), (1, 11, 8, 1, "TD", None, "x\ny"),
        (1, 12, 11, 0, "Table", 9, None), (1, 13, 12, 0, "TR", None, None), (1, 14, 13, 0, "TD", None, "inner"),
        (1, 15, 3, 2, "TR", None, None), (1, 16, 1, 1, "Table", 6, None), (2, 1, None, 0, "Table", None, None),
    ]
    df = spark.createDataFrame(nodes, "document_id int, node_id int, parent_id int, position int, role string, page_number int, text string")
    got = v.struct_tables(df).withColumn("p", v.padded(F.col("rows"))).collect()
    assert [(r.document_id, r.table_id, r.page_number, r.p) for r in got] == [(1, 3, 4, [["head more", "x<br>y inner"], ["a", ""]])]


def brute_pairs(left, right):
    """Each table in turn takes the best found table that is free, else the best."""
    def size(rows):
        return len(rows), max((len(r) for r in rows), default=0)

    out, taken = {}, set()
    for t, rows in sorted(left):
        (n, w) = size(rows)
        order = sorted(right, key=lambda o: (abs(n - size(o[2])[0]), abs(w - size(o[2])[1]), -min(n, size(o[2])[0]) * min(w, size(o[2])[1]), o[1][1], o[1][0], o[0]))
        if order:
            free = [o for o in order if o[0] not in taken]
            out[t] = (free or order)[0][0]
            taken.add(out[t])
    return out


def test_table_pairs_against_brute_force(spark):
    rng = random.Random(3)
    left, right = [], []
    for page in range(30):
        for i in range(rng.randint(0, 5)):
            left.append((1, page, i, [["x"] * rng.randint(1, 4) for _ in range(rng.randint(1, 4))]))
        for i in range(rng.randint(0, 4)):
            right.append((1, page, i, (float(rng.randint(0, 2)), float(rng.randint(0, 2)), 9.0, 9.0), [["y"] * rng.randint(1, 4) for _ in range(rng.randint(1, 4))]))
    a = spark.createDataFrame(left, "document_id int, page_number int, table_id int, rows array<array<string>>")
    b = spark.createDataFrame(right, f"document_id int, page_number int, other_id int, box {BOX}, rows array<array<string>>")
    got = {(r.page_number, r.table_id): r.other_id for r in v.table_pairs(a, b).collect()}
    want = {}
    for page in range(30):
        found = brute_pairs([(x[2], x[3]) for x in left if x[1] == page], [(x[2], x[3], x[4]) for x in right if x[1] == page])
        want |= {(page, t): o for t, o in found.items()}
    assert got == want


def test_empty_cells_are_filled(spark):
    df = spark.createDataFrame([([["a", None], ["", "d", "e"]], [["1", "2", "3", "4"], [" 5 "]])], "r array<array<string>>, o array<array<string>>")
    assert df.select(v.filled(F.col("r"), F.col("o"))).first()[0] == [["a", "2", "3"], ["5", "d", "e"]]


def test_tables_of_citations(spark):
    series = "**[Series Table]** 1Q24 | 2Q24\n- Revenue: 10 | 20\n- **Cost**: 1 | 2\n- Cost: 1 | 2 | 3\n* Cost: 1 | 2"
    df = spark.createDataFrame([(series, None), (None, "a | b | c | d\nx: 1 | 2 | 3 | 4"), ("", "plain"), ("<br>", "a|b|c|d\nx: 1|2|3|4\nx: 1|2|3|4\ny: 5|6|7|8")], "a string, b string")
    got = [r.x for r in df.select(v.citation_table(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0].markdown.split("\n")[2:] == ["| - Revenue | 10 | 20 |", "| - **Cost | 1 | 2 |", "| Cost | 1 | 2 |"] and got[0].n_columns == 3
    assert [tuple(g) for g in got[1:3]] == [("", 0, 0)] * 2
    assert (got[3].n_rows, got[3].markdown.split("\n")[0]) == (2, "| 항목 | a | b | c | d |")


def test_picture_texts(spark):
    mark = "**==> picture [1 x 2] intentionally omitted <==**"
    lines = spark.createDataFrame([(1, 0, 1, None, "# Page 1"), (1, 1, 1, 1, mark), (1, 2, 1, 2, mark), (1, 3, 1, 3, mark), (1, 4, 1, 4, mark), (1, 5, 1, None, "end")], "document_id int, line_index int, page_number int, ordinal int, line string")
    results = spark.createDataFrame([(1, 1, 1, " one\n\ntwo ", "x", (1.2, 2.0, 3.0, 4.0)), (1, 1, 2, None, "one two", (1.0, 2.4, 3.0, 4.0)), (1, 1, 3, "", " seen ", None)], f"document_id int, page_number int, ordinal int, mcid_text string, ocr_text string, box {BOX}")
    got = v.with_picture_texts(lines, results).first().markdown
    assert got.split("\n") == [
        "# Page 1", "", "**----- Start of picture mcid -----**<br>", "one<br>", "two<br>", "**----- End of picture mcid -----**<br>",
        "", "**----- Start of picture ocr -----**<br>", "seen<br>", "**----- End of picture ocr -----**<br>", "end",
    ]


def test_cells_are_found_in_the_flattest_place(spark):
    box = lambda x, y: (float(x), float(y), float(x + 8), float(y + 4))
    words = [("net", 0, 0), ("sales", 10, 0), ("net", 0, 50), ("x", 12, 50), ("sales", 4, 60), ("it’s", 0, 90), ("net", 0, 120), ("sales", 0, 149)]
    elements = spark.createDataFrame([(1, 1, i, w, box(x, y)) for i, (w, x, y) in enumerate(words)], f"document_id int, page_number int, element_order int, text string, box {BOX}")
    cells = spark.createDataFrame([(1, 1, 0, 0, " net  sales "), (1, 1, 0, 1, "it's"), (1, 1, 1, 0, "x sales"), (1, 1, 1, 1, ""), (1, 1, 2, 0, "sales x"), (1, 2, 0, 0, "net")], "document_id int, page_number int, row_index int, cell_index int, text string")
    got = {(r.page_number, r.row_index, r.cell_index): (r.matched, r.x0, r.y1) for r in structures.matched_cells(cells, elements).collect()}
    assert got == {(1, 0, 0): ([0, 1], 0.0, 4.0), (1, 0, 1): ([5], 0.0, 94.0), (1, 1, 0): ([3, 4], 4.0, 64.0), (1, 1, 1): ([], None, None), (1, 2, 0): ([], None, None), (2, 0, 0): ([], None, None)}


def test_series_columns_prefer_axis_labels(spark):
    rows = [(1, 0, "2 0 24", ["a", "12", "3%"]), (1, 1, "plain", ["7"]), (2, 0, "plain", ["7", "x"]), (2, 1, None, [])]
    got = structures.series_columns(spark.createDataFrame(rows, "page int, column_index int, anchor string, texts array<string>"), ["page"]).collect()
    assert sorted((r.page, r.column_index, tuple(r.values)) for r in got) == [(1, 0, ("12", "3%")), (2, 0, ("7",)), (2, 1, ())]


def test_of_items_with_equal_keys_the_first_in_the_files_stays(spark, tmp_path):
    """Equal keys in several row groups of several files, read by as many tasks."""
    import duckdb

    from parchment.plans import visual_queries

    (tmp_path / "lineitem.parquet").mkdir()
    for i in range(6):
        rows = f"SELECT k % 500 AS l_orderkey, (k % 3 + 1)::INT AS l_linenumber, {i} * 10000 + k AS l_partkey FROM range(3000) r(k)"
        duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet/part-{5 - i}.parquet' (ROW_GROUP_SIZE 2048)")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = visual_queries._items(spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "l_partkey").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want: dict = {}
    for k in range(3000):
        want.setdefault((k % 500, k % 3 + 1), 50000 + k)
    assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want)


def test_citation_tables_take_time_in_proportion_to_their_lines(spark):
    """The head of a table isn't looked for again for each of its lines."""
    import time

    def seconds(n: int) -> float:
        text = "A | B | C | D\n" + "\n".join(f"row {i}: 1 | 2 | 3 | {i}" for i in range(n))
        df = spark.createDataFrame([(text,)] * 4, "text string").select(v.citation_table(F.col("text")).alias("x"))
        began = time.perf_counter()
        assert {r.x.n_rows for r in df.collect()} == {n}
        return time.perf_counter() - began

    seconds(20)
    assert seconds(1600) < 16 * max(seconds(200), 0.5)
