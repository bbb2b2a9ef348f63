"""SimHash against brute force over all pairs."""

import random

import xxhash

from parchment.llm import simhash

DATA = "/root/testdata/sf0.001"


def brute_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=4):
    """{fp: smallest id} over (id, fp) rows."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return {f: least.get(root(f)) for f in fps}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs]
    expected = brute_components(rows)
    got = simhash.op5_simhash(spark, DATA).collect()
    assert len(got) == len(docs)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", expected[f]) for d, f in rows}


def test_links_of_dense_groups_on_every_path(spark):
    rng = random.Random(5)
    centre, fps = rng.getrandbits(64), set()
    for _ in range(120):
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps |= {rng.getrandbits(64) for _ in range(60)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    expected = brute_components(rows)
    distinct = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    for options in ({}, {"bucket": 2}, {"blocks": 5}, {"blocks": 8, "bucket": 10}):
        pairs = simhash.components(simhash.links(distinct, 4, **options)).collect()
        root = {f: f for f in fps} | {r.a % (1 << 64): r.b % (1 << 64) for r in pairs}
        groups, wanted = {}, {}
        for i, f in rows:
            groups.setdefault(root[f], set()).add(f)
            wanted.setdefault(expected[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values())), options


def test_nulls_ties_empty_and_extra_columns(spark):
    rows = [(3, None, "x"), (None, "", "y"), (1, "  \n", "z"), (2, "One two three four five", "z"), (2, "one TWO three four five", None), (None, "unlike all the others here", "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").selectExpr("*", "1 AS root", "2 AS component")
    got = {(r.id, r.component, r.fp == 0) for r in simhash.near_duplicates(df).collect()}
    assert got == {(3, 1, True), (None, 1, True), (1, 1, True), (2, 2, False), (None, None, False)}
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]
    empty = df.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_groups_of_similar_texts_against_all_pairs(spark):
    """Planted copies with edits: every pair of at least 0.8 is together, and no group without such links."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    vocabulary = [word() for _ in range(400)]
    texts = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.choice([3, 12, 60, 250]))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                edited[rng.randrange(len(edited))] = word()
            texts.append(" ".join(edited))
    sets = []
    for t in texts:
        w = t.split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if texts[i] == texts[j] or shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in simhash.similar_groups(df).collect():
        got.setdefault(r.root, set()).add(r.id)
    want = {}
    for i in range(len(texts)):
        want.setdefault(root(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_copies_whose_fingerprints_are_far_apart_by_repeats(spark):
    """A line that repeats moves the fingerprint, but not the set of shingles."""
    rng = random.Random(3)
    rows = []
    for i in range(0, 40, 2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(304)]
        rows += [(i, " ".join(base)), (i + 1, " ".join(base[:152] + base[140:152] * 100 + base[152:]))]
    far = [(a ^ b).bit_count() for a, b in zip(*([simhash.fingerprint(simhash.shingle_hashes(t, 5)) for _, t in rows[k::2]] for k in (0, 1)), strict=True)]
    assert sum(d >= 22 for d in far) >= 10
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))


def linked(names, pairs):
    """The groups that pairs make of names, sorted."""
    of = {x: {x} for x in names}
    for a, b in pairs:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for x in of[b]:
                of[x] = of[a]
    return sorted({id(g): sorted(g) for g in of.values()}.values())


def test_pairs_among_strangers_that_share_a_passage(spark, monkeypatch):
    """Texts with 300 of 338 shingles in common are less than similar; planted copies among them are found."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**7)}"
    passage = [word() for _ in range(304)]
    texts = []
    for _ in range(240):
        texts.append(passage + [word() for _ in range(38)])
        if len(texts) % 3 == 0:
            texts.append(texts[-1][:-31] + [word() for _ in range(31)])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    assert 30 < len(pairs) < 200
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for block in (1 << 10, 50):
        monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
        got = [(r.id, r.root) for r in simhash.similar_groups(df).collect()]
        groups = {}
        for i, root in got:
            groups.setdefault(root, []).append(i)
        assert sorted(map(sorted, groups.values())) == linked(range(len(texts)), pairs)


def test_fingerprint_links_are_verified_pairs(spark, monkeypatch):
    """Without bands, each pair of at most four bits that is similar enough links, whoever the centre of its bits is."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=90)
        for _ in range(25):
            texts.append(list(base))
            at = rng.randrange(len(base))
            base = base[:at] + [rng.choice(vocabulary)] + base[at + 1 :]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    fps = [simhash.fingerprint(simhash.shingle_hashes(" ".join(t), 5)) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4 and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    signatures = simhash.signatures
    lone = lambda *a: signatures(*a).withColumn("bands", simhash.F.array(simhash.F.xxhash64("th")))
    monkeypatch.setattr(simhash, "signatures", lone)
    root = {r.id: r.root for r in simhash.similar_groups(df).collect()}
    assert near and all(root[a] == root[b] for a, b in near)


def test_filed_fingerprints_are_not_broadcast(spark):
    """Explode multiplies the rows, which Spark's estimate doesn't know: they don't go over the driver."""
    rng = random.Random(7)
    distinct = simhash.written(spark.createDataFrame([(simhash._signed(rng.getrandbits(64) >> 20),) for _ in range(300)], "fp bigint"), "distinct")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for options in ({}, {"bucket": 2}):
            plan = simhash.links(distinct, 4, **options)._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan and "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
