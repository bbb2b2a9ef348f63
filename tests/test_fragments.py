"""Fragments against plain Python."""

import random
import re

from pyspark.sql import functions as F

from parchment.operators import fragments


def test_joined(spark):
    rows = [(["The", "cat", ",", "sat", "(", "down", ")", "."], "The cat, sat( down)."), (["5", "%", "of"], "5%of"), ([], ""), (["가", "나"], "가 나")]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<string>, w string").select(fragments.joined(F.col("p"))).collect()]
    word = re.compile(r"\w")
    for (parts, _), value in zip(rows, got, strict=True):
        want = parts[0] if parts else ""
        for x in parts[1:]:
            if x[0] not in fragments.NO_SPACE_BEFORE and want[-1] not in fragments.NO_SPACE_AFTER and word.match(want[-1]) and word.match(x[0]):
                want += " "
            want += x
        assert value == want


def test_mean_rows(spark):
    rng = random.Random(1)
    rows = [(p, i, float(rng.randint(0, 300)), float(rng.randint(0, 120))) for p in range(3) for i in range(40)]
    got = {(r.page, r.id): r.row for r in fragments.mean_rows(spark.createDataFrame(rows, "page int, id int, cx double, cy double"), ["page"]).collect()}
    for page in range(3):
        made: list[list] = []
        for _, _, i, y in sorted((y, x, i, y) for p, i, x, y in rows if p == page):
            if made and abs(y - sum(v for _, v in made[-1]) / len(made[-1])) <= 5.5:
                made[-1].append((i, y))
            else:
                made.append([(i, y)])
        for n, row in enumerate(made):
            assert all(got[page, i] == n for i, _ in row)


def test_tokens_periods_and_headings(spark):
    tokens = [(1, 1, "a", 0.0, 0.0, 5.0, 5.0), (1, 2, "a", 1.0, 1.0, 6.0, 6.0), (1, 3, "a", 3.0, 3.0, 8.5, 8.5), (1, 4, "b", 0.0, 0.0, 5.0, 5.0), (2, 5, "a", 0.0, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(tokens, "page int, id int, text string, x0 double, y0 double, cx double, cy double")
    assert sorted(r.id for r in fragments.distinct_tokens(df, ["page"]).collect()) == [1, 3, 4, 5]
    marks = [(1, 1, "3", 10.0, 0.0), (1, 2, "Q25", 30.0, 2.0), (1, 3, "Q24", 90.0, 0.0), (1, 4, "2024", 0.0, 0.0)]
    got = {r.id: r.label for r in fragments.period_labels(spark.createDataFrame(marks, "page int, id int, text string, cx double, cy double"), ["page"]).collect()}
    assert got == {1: "3Q25", 2: None, 3: "Q24", 4: "2024"}
    groups = [(1, 0, "heading", ["A", "B"]), (1, 1, "heading", ["A"]), (1, 2, "table", ["x"]), (1, 3, "table", ["y"]), (1, 4, "heading", ["C"])]
    out = fragments.waiting_headings(spark.createDataFrame(groups, "document_id int, position int, kind string, texts array<string>")).orderBy("table_index").collect()
    assert [(r.position, r.headings) for r in out] == [(2, ["A", "B"]), (3, []), (None, ["C"])]


def test_clean_blocks(spark):
    text = "12\nA first paragraph of text\n45%\n\n3Q25\n\nshort\n\nA second paragraph\nof two lines\n\n" + "x" * 690 + "\n\n<br>\n1234567890123"
    got = spark.createDataFrame([(text,)], "t string").select(fragments.clean_blocks(F.col("t"))).first()[0]
    assert got == ["A first paragraph of text\n\nA second paragraph\nof two lines", "x" * 690]


def test_focus_text(spark):
    from parchment.operators import assets

    text = "x" * 300 + " wind power grew " + "y" * 300 + " wind again " + "z" * 10
    assert [w[:4] + "|" + str("wind" in w) for w in assets.windows(text, ["power", "wind"])] == ["xxxx|True", "yyyy|True"]
    rows = [(1, "wind power in 2023", "Energy", "grew by 12%", "a quote", "Solar fell.\nWind power grew by 12% in 2023.\nNothing else"), (2, "q", None, None, None, None)]
    got = {r.id: r.focus for r in assets.focus_text(spark.createDataFrame(rows, "id int, query string, section_hint string, highlight string, quote string, chunk_text string")).collect()}
    lines = got[1].split("\n")
    assert lines[:2] == ["Energy", "grew by 12%"] and "Wind power grew by 12% in 2023." in lines and got[2] == ""
