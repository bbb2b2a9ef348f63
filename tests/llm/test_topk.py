"""Exact top-k against brute force."""

import numpy as np

from parchment.llm import topk


def brute(ids, vectors, k, every=50):
    out = []
    for i, q in zip(ids, vectors, strict=True):
        if i % every == 0:
            scored = sorted((-int(v @ q), j) for j, v in zip(ids, vectors, strict=True) if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def test_blocks_against_brute_force():
    rng = np.random.default_rng(0)
    for scale, n, d in ((60, 400, 16), (3, 300, 4), (100_000, 300, 8), (0, 60, 3), (1, 3, 2)):
        ids = np.sort(rng.choice(10 * n, n, replace=False)) - n
        vectors = rng.normal(0, scale, (n, d)).round().astype(np.int64)
        vectors[: n // 3] = vectors[0]
        queries = ids % 50 == 0
        got = topk.block_top(ids, vectors, ids[queries], vectors[queries], 5)
        ranked = {}
        rows = []
        for q, j, s in zip(*map(np.ndarray.tolist, got), strict=True):
            ranked[q] = ranked.get(q, 0) + 1
            rows.append((q, ranked[q], j, s))
        assert sorted(rows) == brute(ids.tolist(), vectors, 5), (scale, n, d)


def test_query_blocks_nulls_ties_and_extra_columns(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.2, (700, 12)).astype(np.float32)
    vectors[100:350] = vectors[50]
    rows = [(i, v.tolist(), i % 3, "x") for i, v in enumerate(vectors)]
    odd = [(None, [0.5] * 12, 1, "x"), (1000, None, 1, "x"), (1050, [None] * 12, 1, "x"), (1100, [float("nan")] * 12, 1, "x"), (1150, [float("-inf")] * 12, 1, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, score int, rank string")
    found = topk.integers(df)
    want = brute(range(700), np.floor(256 * vectors.astype(np.float64)).astype(np.int64), 5)
    for rows_, per in ((16_384, 4_096), (90, 5)):
        got = topk.top_k(found, found.where("id % 50 = 0"), rows=rows_, per_block=per).collect()
        assert sorted(map(tuple, got)) == want
    assert topk.top_k(found.limit(0), found.limit(0)).count() == 0
    few = found.where("id < 3")
    assert topk.top_k(few, few.where("id = 0")).count() == 2
