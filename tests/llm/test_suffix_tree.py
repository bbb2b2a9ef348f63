"""Suffix-tree scores against a dictionary-based brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from parchment.llm import suffix_tree as st

DATA = "/root/testdata/sf0.01"


def words(text):
    return (text or "").encode().lower().split()


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


class Brute:
    """The same model over tuples of symbols, built context by context."""

    def __init__(self, texts, depth):
        self.c = Counter(w for t in texts for w in [*words(t), b""])
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.unit = self.n + self.v + 1
        follow = [defaultdict(Counter) for _ in range(depth + 1)]
        for t in texts:
            x = ["^", *words(t), b""]
            for i in range(1, len(x)):
                for k in range(1, min(depth, i) + 1):
                    follow[k][tuple(x[i - k : i])][x[i]] += 1
        self.model, candidates = {}, set(follow[1])
        for k in range(1, depth + 1):
            for s in candidates:
                f = follow[k][s]
                total, kept = sum(f.values()), {w: n for w, n in f.items() if n >= 2}
                back = 1 - sum(n - st.DISCOUNT for n in kept.values()) / total
                mixed = {w: (n - st.DISCOUNT) / total + back * self.p(s[1:], w) for w, n in kept.items()}
                gain = {w: n * math.log(mixed[w] / self.p(s[1:], w)) for w, n in kept.items()}
                saved = sum(gain.values()) + sum(n for n in f.values() if n < 2) * math.log(back) if kept else 0
                if saved > st.DIVERGENCE and total >= st.FREQUENT:
                    shares = {w: (n - st.DISCOUNT) / total for w, n in kept.items() if gain[w] > 0.1}
                    self.model[s] = (mixed, shares, 1 - sum(shares.values()))
            if k < depth:
                candidates = {(*s, w) for s in candidates for w, n in follow[k][s].items() if n >= st.FREQUENT and w != b""}

    def p(self, s, w):
        """During the fit a context that stays has its full distribution."""
        if not s:
            return (self.c[w] + 1) / self.unit
        return self.model[s][0].get(w) if s in self.model and w in self.model[s][0] else self.p(s[1:], w)

    def score(self, text):
        x, out = ["^", *words(text), b""], 0.0
        for i in range(1, len(x)):
            p = (self.c[x[i]] + 1) / self.unit
            for k in range(1, min(3, i) + 1):
                if (s := tuple(x[i - k : i])) in self.model:
                    p = self.model[s][1].get(x[i], 0) + self.model[s][2] * p
            out += math.log10(p)
        return out


def test_small_vocabulary_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        text = []
        for _ in range(rng.randint(0, 30)):
            text += rng.choice([["the", "cat", "sat"], ["the", "dog", "ran", "off"], ["A"], ["of", "the"], ["Dog"]])
        rows.append((i, " ".join(text)))
    rows += [(None, None), (None, ""), (7, "the cat\tsat"), (7, "the cat\tsat"), (1000, "unknown words the cat ran"), (1001, "the dog ran off " * 3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS w", "2 AS row", "3 AS c")
    brute = Brute([t for d, t in rows if not held(d)], 3)
    assert any(len(s) == 3 for s in brute.model) and any(len(s) == 2 for s in brute.model)
    want = sorted((repr(d), held(d), len(words(t)) + 1, sum(w in brute.c for w in [*words(t), b""]), round(brute.score(t), 6)) for d, t in rows)
    got = st.score(df).collect()
    assert {r.train_tokens for r in got} == {brute.n}
    rows_ = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.score) for r in got)
    assert [r[:4] for r in rows_] == [r[:4] for r in want]
    assert [r[4] for r in rows_] == pytest.approx([r[4] for r in want], abs=1e-5)


def test_query_base_scores_and_held_out_gain(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    counts = Counter(w for d, t in docs.items() if not held(d) for w in [*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    got = st.op3_lm_scores(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        own = [*words(docs[r.doc_id]), b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(w in counts for w in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    test = [r for r in got if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_query_scores_against_brute_force(spark):
    """The tree of the query on the smallest tables, context by context."""
    data = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    brute = Brute([t for d, t in docs.items() if not held(d)], 3)
    assert len(brute.model) > 100
    got = {r.doc_id: r.score for r in st.op3_lm_scores(spark, data).collect()}
    assert {d: got[d] for d in docs} == pytest.approx({d: brute.score(t) for d, t in docs.items()}, abs=1e-4)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert st.score(df).count() == 0
    only = next(i for i in range(100) if held(i))
    row = st.score(spark.createDataFrame([(only, "some text")], "doc_id bigint, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0)


def test_places():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 1000, 50_000):
        keys = np.unique(rng.integers(0, max(1, 3 * n), n))
        wanted = np.concatenate([keys, rng.integers(0, 10 * n + 5, 500)])
        place = {k: i for i, k in enumerate(keys.tolist())}
        assert st.Places(keys).find(wanted).tolist() == [place.get(k, -1) for k in wanted.tolist()]


def test_small_bounds_stay_exact_for_words_that_are_no_symbols(spark, monkeypatch):
    """With few words held and many parts, hot words in pieces, all scores are the same."""
    docs = [(i, f"a b c{i % 7} d{i % 50} a b e{i}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = {r.doc_id: r for r in st.score(df).collect()}
    monkeypatch.setattr(st, "WORDS", 12)
    monkeypatch.setattr(st, "PART", 100)
    got = st.score(df).collect()
    for r in got:
        assert r.base_score == pytest.approx(want[r.doc_id].base_score) and r.n_known == want[r.doc_id].n_known
        assert r.score < 0 and r.score == pytest.approx(want[r.doc_id].score, abs=1e-9)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_all_frequent_words_are_symbols_against_brute_force(spark):
    """More frequent words and contexts than any fixed number of symbols held: none is a class."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"x{k} y{k} z{k}" for k in (rng.randrange(2500) for _ in range(60)))) for i in range(2200)]
    brute = Brute([t for d, t in rows if not held(d)], 3)
    got = {r.doc_id: r.score for r in st.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(brute.c) > 7000
    assert [got[d] for d, _ in rows[:300]] == pytest.approx([brute.score(t) for _, t in rows[:300]], abs=1e-5)


def test_a_worker_needs_few_bytes_a_token():
    """What a worker allocates beside a chunk while it counts a level, and how the next chunk starts without it."""
    import gc
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    rng = np.random.default_rng(6)
    at = np.minimum(rng.zipf(1.3, 300_000), 40_000).astype(np.uint64) - 1
    words = rng.integers(1 << 40, 1 << 62, 40_000)
    text = st.pack(np.full(300, 1000, np.uint64), words, at)
    rows = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([text] * 3, pa.binary()), pa.array([[False] * 300] * 3)], names=["chunk", "text", "held"])
    known = st.Known(words[:0], words[:0], np.full(1 << 10, -1), words[:0], words[:0], 20, 10**6)
    run = st._cells(Frame(), 1, SimpleNamespace(value=known), SimpleNamespace(value=np.full(1 << 10, -1)))
    gc.collect()
    tracemalloc.start()
    try:
        assert len([len(x) for x in run(iter([rows]))]) == 3
        assert tracemalloc.get_traced_memory()[1] < 90 * 300_000
    finally:
        tracemalloc.stop()
