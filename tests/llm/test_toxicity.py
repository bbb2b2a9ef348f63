"""Toxic passages: segments against brute force, held-out accuracy, edge cases."""

import random

from parchment.llm import toxicity

DATA = "/root/testdata/sf0.01"


def brute_segments(v):
    """All maximal scoring segments: the best one, then those on either side of it."""
    best = None
    for a in range(len(v)):
        total = 0
        for b in range(a, len(v)):
            total += v[b]
            if total > 0 and (best is None or total > best[2]):
                best = (a, b, total)
    if best is None:
        return []
    a, b, s = best
    left = brute_segments(v[:a])
    right = [(x + b + 1, y + b + 1, z) for x, y, z in brute_segments(v[b + 1 :])]
    return [*left, (a, b, s), *right]


def test_segments():
    rng = random.Random(1)
    for _ in range(400):
        v = [rng.randint(-9, 9) + rng.random() for _ in range(rng.randint(0, 25))]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(v)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(v)]


def test_held_out_accuracy(spark):
    out = toxicity.op4_toxicity(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9


def test_planted_words_nulls_repeats_and_extra_columns(spark):
    rng = random.Random(2)
    plain = [f"w{i}ord" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=60)
        bad = i % 5 == 0
        if bad:
            for k in rng.sample(range(60), 4):
                words[k] = rng.choice(["vileone", "viletwo", "Nasty!"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    extra = [(None, None, "x"), (None, "", "x"), (9000, "vilethree said the vileone", "x"), (9001, "w1ord", "x"), (9001, "w1ord", "x"), (9002, "w2ord " * 50_000, None)]
    df = spark.createDataFrame(rows + extra, "doc_id bigint, text string, score string").selectExpr("*", "1 AS y", "2 AS t")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (0, 0), (0, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, marks)
    got = toxicity.passages(df, model).collect()
    assert len(got) == len(rows) + len(extra)
    truth = dict(labels)
    assert all((r.score >= 0.3) == truth[r.doc_id] for r in got if r.doc_id in truth)
    by = {r.doc_id: r for r in got if r.doc_id in (9000, 9001, 9002)}
    assert by[9000].score >= 0.3 > max(by[9001].score, by[9002].score) and by[9000].passages
    assert all(r.score < 0.3 and not r.passages for r in got if r.doc_id is None)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    marks = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(df, marks)
    assert toxicity.passages(df, model).count() == 0
    some = spark.createDataFrame([(1, "a text")], "doc_id bigint, text string")
    assert toxicity.passages(some, toxicity.fit(some, marks)).first().score < 0.3


def test_kept_columns_that_clash_give_way(spark):
    """Each operator that keeps columns: a kept one named like a made one is replaced, not doubled."""
    from parchment.llm import bpe, licenses, quality, wrappers

    df = spark.createDataFrame([(1, "some text"), (None, None)], "doc_id bigint, text string")
    df = df.selectExpr("*", *(f"7 AS {c}" for c in ("labels", "score", "ids", "n_words", "Passages", "kept")))
    keep = ("doc_id", "labels", "score", "ids", "n_words", "Passages", "kept", "doc_id")
    made = {
        "licenses": licenses.scan(df, keep=keep),
        "toxicity": toxicity.passages(df, toxicity.Model(), keep=keep),
        "bpe": bpe.encode(df, bpe.vocabulary(), keep=keep),
        "quality": quality.verdicts(df, keep=keep),
        "wrappers": wrappers.main_text(df.selectExpr("*", "'http://h/' AS url", "text AS html"), keep=(*keep, "text")),
    }
    for name, found in made.items():
        assert len({c.lower() for c in found.columns}) == len(found.columns), name
        assert found.count() == 2 and len(found.collect()) == 2, name
    row = made["quality"].where("doc_id = 1").first()
    assert (row.n_words, row.labels, row.kept) == (2, 7, False)


def recursive_segments(v, at=0):
    """Scores of all maximal segments: the best one by prefix sums, then those on either side of it."""
    best, low, where, total = 0.0, 0.0, 0, 0.0
    span = None
    for i, x in enumerate(v):
        total += x
        if total - low > best + 1e-12:
            best, span = total - low, (where, i)
        if total < low:
            low, where = total, i + 1
    if span is None:
        return []
    return [best, *recursive_segments(v[: span[0]]), *recursive_segments(v[span[1] + 1 :])]


def test_query_against_brute_force(spark):
    """The query's scores from its model, by recursive search and the sum statistic written out."""
    import math

    data = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    model = toxicity.fit(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    got = toxicity.op4_toxicity(spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        tokens = toxicity.TOKEN.findall((docs[r.doc_id] or "").lower())
        found = sorted(recursive_segments([model.token(x) for x in tokens]), reverse=True)
        best = 0.0
        for n in range(1, len(found) + 1):
            total = sum(model.rate * s - math.log(max(model.size * max(len(tokens), 1), 1e-9)) for s in found[:n])
            if total <= 0:
                break
            p = -total + (n - 1) * math.log(max(total, 1.0)) - math.log(math.factorial(n)) - math.log(math.factorial(n - 1)) + n * math.log(2)
            best = max(best, -p / math.log(10))
        score = 1 / (1 + math.exp(-max(-30, min(30, model.intercept + model.slope * math.log1p(best)))))
        assert abs(r.score - score) < 1e-6 and r.predicted == (r.score >= 0.3)


def test_held_out_documents(spark):
    """Of the documents that nothing was learnt from, the toxic ones are found and the others left alone."""
    data = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.predicted) for r in toxicity.op4_toxicity(spark, data).collect() if r.held_out and labels.get(r.doc_id) is not None]
    toxic, clean = ([p for y, p in rows if y == k] for k in (1, 0))
    assert sum(toxic) > 0.9 * len(toxic) and sum(clean) < 0.05 * len(clean)
