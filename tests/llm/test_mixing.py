"""Mixing: targets against the iterative definition, budgets and determinism."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from parchment.llm import mixing

DATA = "/root/testdata/sf0.01"


def brute_targets(sizes):
    """{source: target}: excess over twice a source's size is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    sizes = Counter()
    for r in docs:
        sizes[r.source] += words(r.text)
    want = brute_targets(sizes)
    got = mixing.op8_mixing(spark, DATA).collect()
    assert {(r.doc_id, r.size) for r in got} == {(r.doc_id, words(r.text)) for r in docs}
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in want)
    again = mixing.op8_mixing(spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_keeps_columns_and_agrees_with_the_plan(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"h": F.lit(1), "size": F.lit("x"), "target": F.lit(2)})
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    copies = Counter(r.doc_id for r in out.select("doc_id").collect())
    plan = {r.doc_id: r.taken // r.size for r in mixing.op8_mixing(spark, DATA).where("size > 0").collect()}
    assert {d: n for d, n in plan.items() if n} == {d: copies[d] for d in plan if plan[d]}


def test_nulls_ties_empty_texts_and_sources(spark):
    rows = [(i, "a b c", None) for i in range(50)] + [(None, f"word {i}", "s") for i in range(50)] + [(7, "same text", "t")] * 9
    rows += [(100, None, "u"), (101, "", "u"), (102, " \n", None), (103, "w " * 20_000, "é")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan_rows, plan = mixing.mix_plan(df)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    want = brute_targets(sizes)
    got = {r["__s"]: r.target for r in plan.collect()}
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert mixing.mix(df).count() >= 50


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(df).count() == 0
