"""Line dedup against brute force with exact site counts."""

from collections import defaultdict

from parchment.llm import line_dedup

SPACES = " \t\n\x0b\f\r"


def brute(rows, min_sites):
    sites, first = defaultdict(set), {}
    for doc, text, site in rows:
        for pos, raw in enumerate((text or "").split("\n")):
            if line := raw.strip(SPACES):
                sites[line].add(site)
                key = (doc is None, doc if doc is not None else 0, pos)
                first[line] = min(first.get(line, key), key)
    out = []
    for doc, text, site in rows:
        left, n, gone = [], 0, 0
        for pos, raw in enumerate((text or "").split("\n")):
            line = raw.strip(SPACES)
            n += bool(line)
            if line and len(sites[line]) >= min_sites and first[line] != (doc is None, doc if doc is not None else 0, pos):
                gone += 1
            else:
                left.append(raw)
        out.append((doc, n, gone, None if text is None else "\n".join(left), site))
    return sorted(out, key=repr)


def check(spark, rows, min_sites):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "7 AS pos", "8 AS n_lines", "'k' AS h")
    out = line_dedup.remove_boilerplate(df, min_sites=min_sites)
    assert out.columns == ["doc_id", "text", "source", "pos", "h", "n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text, r.source) for r in out.collect()), key=repr)
    assert got == brute(rows, min_sites)


def test_boilerplate_ties_nulls_and_repeats(spark):
    common = "  Home | About\nhello"
    rows = [(i, f"{common}\nown line {i}\n\n", f"s{i % 7}") for i in range(20)]
    rows += [(None, common, None), (None, None, "s1"), (5, common, None), (5, common, None), (40, "", "s2"), (41, "hello\nhello", "s2"), (42, "x" * 100_000, "s9")]
    for min_sites in (2, 7, 8, 9):
        check(spark, rows, min_sites)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert line_dedup.remove_boilerplate(df).count() == 0


def test_estimates_far_from_the_threshold_and_near(spark):
    rows = [(i, "many\n" + ("few\n" if i < 90 else "") + ("edge" if i < 100 else ""), f"site{i}") for i in range(400)]
    check(spark, rows, 100)
    check(spark, rows, 101)
