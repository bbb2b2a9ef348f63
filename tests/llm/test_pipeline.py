"""The pipeline's stages on a small table with planted cases."""

import corpus_pipeline
from parchment.llm import bpe, toxicity

DATA = "/root/testdata/sf0.01"


def test_stages_on_the_corpus(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, DATA)
        rows, old = after.collect(), before.collect()
        if name != "bpe":
            assert after.columns == docs.columns
            assert {r.doc_id for r in rows} <= {r.doc_id for r in old}
        if name == "toxicity":
            clean = {r.doc_id for r in old if labels.get(r.doc_id) == 0}
            gone = {r.doc_id for r in old} - {r.doc_id for r in rows}
            assert len(gone & clean) < 0.05 * len(clean) and gone
        if name == "line_dedup":
            assert len(rows) == len(old) and all(r.n_chars == len(r.text) for r in rows)
        if name == "near_dedup":
            texts = {}
            for r in old:
                texts[r.text] = min(r.doc_id, texts.get(r.text, r.doc_id))
            assert len({r.text for r in rows}) == len(rows) and all(texts[r.text] == r.doc_id for r in rows)
        if name == "mixing":
            assert 1.3 * sum(len(r.text.split()) for r in old) < sum(len(r.text.split()) for r in rows) < 1.7 * sum(len(r.text.split()) for r in old)
        if name == "bpe":
            assert len(rows) == len(old) and sum(r.n_tokens for r in rows) > 0
        before = spark.createDataFrame(rows, after.schema)
    assert toxicity.THRESHOLD == 0.3 and bpe.vocabulary().endswith(".json")


def test_planted_near_copies_of_the_corpus(spark):
    """Copies with a word in thirty changed: of each group with a similarity of 0.8 one stays, whatever
    passages and stop words it shares with others; all else stays."""
    import random

    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    rows, keep = [], set()
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(150 + i)] + (passage if i % 2 else [])
        rows.append((1000 * i, " ".join(words)))
        keep.add(1000 * i)
        for k in range(1, 1 + i % 4):
            copy = list(words)
            for at in rng.sample(range(len(copy)), len(copy) // 60):
                copy[at] = "changed"
            a, b = ({tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (words, copy))
            if len(a & b) >= 0.8 * len(a | b):
                rows.append((1000 * i + k, " ".join(copy)))
    assert len(rows) > 100
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r.doc_id for r in stage(spark, docs, DATA).collect()} == keep


def test_run_and_odd_tables(spark, tmp_path):
    rows = [(i, f"plain text number {i} of the corpus\nshared line", "en", f"s{i % 3}", 30) for i in range(40)]
    rows += [(40, None, None, None, None), (None, "", "en", "s1", 0), (None, "plain text number 3 of the corpus\nshared line", "en", "s2", 1), (3, "x " * 30_000, "en", "s1", 60_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 AS score", "2 AS ids", "3 AS size", "'p' AS passages", "5 AS h")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    for name, table in (("full", df), ("empty", df.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(out) > 0) == (name == "full")
