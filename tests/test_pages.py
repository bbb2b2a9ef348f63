"""The page cleaner with blocks of a layout, worked out by hand."""

from parchment.operators import pages as p
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def box(y0, y1, x0=0.0, x1=100.0):
    return (float(x0), float(y0), float(x1), float(y1))


def test_blocks_of_a_layout(spark):
    body = [f"Body line {w} of this page says something of its own" for w in "abcdefghij"]
    rows = [(1, n, "\n".join([f"Report {n}", *(f"{x} {'xyzuvw'[n]}" for x in body), "Figure 1. A caption", "Near an image", f"{n}"])) for n in (1, 2, 3)]
    pages = spark.createDataFrame(rows, "document_id int, page_number int, text string")
    blocks = []
    for n in (1, 2, 3):
        blocks += [(1, n, 0, f"Report {n}", box(10, 20), 1000.0), (1, n, 1, "Figure 1. A caption", box(910, 920), 1000.0), (1, n, 2, "Near an image", box(940, 950), 1000.0), (1, n, 3, str(n), box(960, 970), 1000.0), (1, n, 4, f"{body[4]} {'xyzuvw'[n]}", box(500, 510), 1000.0)]
    blocks = spark.createDataFrame(blocks, f"document_id int, page_number int, block_index int, text string, box {BOX}, height double")
    image = spark.createDataFrame([(1, n, box(880, 925, 90, 200)) for n in (1, 2, 3)], f"document_id int, page_number int, box {BOX}")
    found = p.edge_blocks(blocks, image)
    assert {(r.block_index, r.edge, r.protected) for r in found.collect()} == {(0, "top", False), (1, "bottom", True), (2, "bottom", True), (3, "bottom", False), (4, None, False)}
    got = {(r.page_number, r.line): r for r in p.evaluate_lines(pages, found).collect()}
    head = got[2, "Report 2"]
    assert (head.edge, head.repeated, head.remove, head.removed_as) == ("top", True, True, "repeated_header") and head.score == 0.9
    # Without blocks the same line has 0.2 for its place.
    plain = {(r.page_number, r.line): r for r in p.evaluate_lines(pages).collect()}
    assert plain[2, "Report 2"].score == 0.75
    near = got[1, "Near an image"]
    assert near.protected and not near.remove and plain[1, "Near an image"].remove
    assert got[3, "3"].removed_as == "page_number"
    assert not any(got[1, f"{x} x"].remove for x in body if (1, f"{x} x") in got)
    assert {r.canonical_text for r in p.repeated_lines(pages, found).collect()} >= {"Report 1", "1"}


def test_page_numbers_of_contents_stay(spark):
    rows = [(1, 1, "Contents\nWind\n12\nSun\n40"), (2, 1, "Results\nWind\n12\nSun\n40")]
    got = {(r.document_id, r.line): r.remove for r in p.evaluate_lines(spark.createDataFrame(rows, "document_id int, page_number int, text string")).collect()}
    assert not got[1, "40"] and got[2, "40"]


def test_words_end_where_sql_ends_them(spark):
    """Letters beyond ASCII are no part of a word: a version after one is a version."""
    import duckdb

    from parchment.functions import text as t
    from parchment.plans.text_queries import COMPARE_KEYS

    lines = ["äver. 3 für", "über 2024-05-06ö x", "ö12 v 1.2.3", "é7é", "v2 b3 page 4x 10,5", "Kver 3", "no digit  here", "a <num> b", "version 2 and 2024/1/2"]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents AS SELECT unnest($1) AS text", [lines])
    want = sorted(r[0] for r in db.execute(COMPARE_KEYS).fetchall())
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(t.compare_key(F.col("line")).alias("k"))
    assert sorted(r.k for r in got.collect()) == want
    classes = spark.createDataFrame([("äver. 3",), ("é2024-05-06",), ("aver 3",)], "line string").select(F.array_join(t.noise_classes(F.col("line")), ",").alias("k"))
    assert [r.k for r in classes.collect()] == ["version", "date", ""]


def test_scores_are_summed_in_the_order_of_lines(spark, tmp_path):
    """A sum that is half of the last digit rounds as in SQL."""
    import duckdb

    from parchment.plans import page_queries

    rng = __import__("random").Random(3)
    docs = [(d, "\n".join(rng.choice(["Copyright notice", "draft", "12", "2024-05-06", "some words", f"line {i} of text"]) for i in range(10 * rng.choice((6, 7, 12, 13)) - 3))) for d in range(400)]
    spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'s' AS source").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.execute(f"SELECT document_id, page_number, score FROM ({page_queries.PAGE_LINE_DECISIONS})").fetchall())
    got = sorted(tuple(r) for r in page_queries.page_line_decisions(spark, str(tmp_path)).select("document_id", "page_number", "score").collect())
    assert got == want
