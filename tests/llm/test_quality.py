"""Quality rules against brute force."""

import re
from collections import Counter

from parchment.llm import quality

DATA = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = quality.op10_quality_rules(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_labelled_documents(spark):
    """Documents labelled good that pass the base rules stay; hardly any bad one does."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.op10_quality_rules(spark, DATA).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.05 * len(bad)


def test_awkward_texts_and_columns(spark):
    texts = [None, "", " \n\t\n", "a a a a", "a b a b a b", "x y z\nx y z\n\nx y z ", "one\x0btwo\x0cthree\x85four", "é# *$%&|<> word", "the cat sat on the mat " * 5000, "w w w", "a" * 100_000]
    rows = [(None if i % 4 == 0 else i, t) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_words", "2 AS __t", "3 AS kept")
    got = quality.verdicts(df, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.text
        assert ("too_short" in r.failed_rules) == (r.n_words < 50) and r.kept == (not r.failed_rules)
    assert quality.verdicts(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = quality.op10_quality_rules(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Generate" not in plan
