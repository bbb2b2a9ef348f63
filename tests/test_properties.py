"""Properties that hold for any text or table."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchment.operators import chunks, embedding, pages, registry

TEXT = st.text(st.sampled_from("ab .!?\n#|é가"), max_size=400)


@settings(max_examples=200, deadline=None, derandomize=True)
@given(TEXT, st.integers(20, 120), st.integers(0, 15))
def test_rule_chunks_lose_no_word_and_keep_to_their_size(text, size, overlap):
    found = chunks.rule_chunks(text, size, overlap)
    assert all(x == x.strip() and x for x, _ in found)
    words = {w for x, _ in found for w in x.split()}
    # A word longer than a chunk may be cut; every other one is somewhere whole.
    assert all(w in words for w in text.split() if len(w) <= overlap)
    longest = max((len(s) for p in chunks.paragraphs(text) for s in chunks._SENTENCE.split(p)), default=0)
    tables = any(chunks.is_table(p) for p in chunks.paragraphs(text))
    assert tables or all(len(x) <= max(2 * size, overlap + 1 + longest) for x, _ in found)


@settings(max_examples=100, deadline=None, derandomize=True)
@given(TEXT)
def test_semantic_chunks_hold_all_words_in_order(text):
    found = chunks.semantic_chunks(text)
    assert " ".join(" ".join(x.split()) for x, _ in found).split() == text.split()


@settings(deadline=None, derandomize=True)
@given(st.lists(st.floats(0, 2), max_size=30))
def test_breakpoints_are_few(distances):
    assert len(chunks.breakpoints(distances)) <= max(1, len(distances) // 10 + 1)


def test_chunks_lose_no_character_that_could_be_a_mark():
    text = "# Head\nbelow\n\n" + "a\u200bb \x00 \ue000 c. " * 30 + "\n| x | y |\n| 1 | 2 |\n" + "End\ue001 of it. " * 20
    for found in (chunks.rule_chunks(text, 5000), chunks.semantic_chunks(text)):
        whole = "".join(x for x, _ in found)
        assert all(whole.count(c) == text.count(c) for c in "\u200b\x00\ue000\ue001")
    assert any("| x | y |\n| 1 | 2 |" in x for x, _ in chunks.semantic_chunks(text))


def test_pages_round_trip(spark):
    rows = [(d, p, f"text {d} of page {p}\n\nmore {'x' * p}") for d in range(5) for p in range(1, 4 + d)]
    df = spark.createDataFrame(rows, "document_id int, page_number int, text string")
    got = {tuple(r) for r in pages.split(pages.render(df)).select("document_id", "page_number", "text").collect()}
    assert got == set(rows)


def test_cleaning_again_removes_nothing_that_was_kept_for_good(spark):
    rows = [(1, p, f"Header line\nbody {p} says {'word ' * p}\nPage {p}") for p in range(1, 7)]
    df = spark.createDataFrame(rows, "document_id int, page_number int, text string")
    once = pages.clean(df)
    assert {r.text.split("\n")[0] for r in once.collect()} == {f"body {p} says {'word ' * p}".strip() for p in range(1, 7)}


def test_ingesting_again_changes_nothing(spark):
    docs = registry.hashed(spark.createDataFrame([(i, f"s{i % 3}", f"text {i % 4}") for i in range(10)], "document_id bigint, source_name string, markdown string"))
    empty = spark.createDataFrame([], "document_id bigint, position bigint, source_name string, source_hash string, content_hash string, indexed_models array<string>")
    once = registry.merged(empty, registry.ingest(docs, empty, "m"), "m")
    twice = registry.merged(once, registry.ingest(docs, once, "m").withColumn("existing_id", F.when(F.col("reason").isNull(), F.col("existing_id"))), "m")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and once.count() == 4


def test_vectors_do_not_depend_on_row_order(spark):
    rows = [(i, "some words and more words " * (i + 1)) for i in range(6)] + [(9, ""), (10, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    a = {r.id: r.embedding for r in embedding.unit_vectors(df, "id", "t").collect()}
    b = {r.id: r.embedding for r in embedding.unit_vectors(df.orderBy(F.desc("id")), "id", "t").collect()}
    assert a == b and not any(a[9]) and not any(a[10]) and abs(sum(x * x for x in a[3]) - 1) < 1e-5


def test_sentences_of_odd_texts_are_those_of_sql(spark, tmp_path):
    """Texts without sentences, and with tabs and other spaces around them."""
    import duckdb

    from parchment.plans import text_queries

    texts = [None, "", " ", "\n\n", " \n \u3000", "\t", "a\tb.\t\tNext one is a long sentence.\t\nx", "\u00a0Nothing but spaces around here \u2003\nNothing but spaces around here", "# a heading of some length\n. ! ?", "end.\r\nA line of windows with an end.\r\n", "v.\x0bt a vertical tab is no white space.", "\ufeffA mark of order is no white space\u200b"]
    rows = [(i, x, "s") for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.execute(text_queries.TEXT_SENTENCES).fetchall())
    assert sorted(tuple(r) for r in text_queries.text_sentences(spark, str(tmp_path)).collect()) == want


def test_semantic_chunks_hash_a_token_once_and_look_for_a_tie_as_far_as_needed(monkeypatch):
    """Equal to vectors of windows of joined sentences; little memory is taken for a short text."""
    import tracemalloc

    from parchment.operators import chunks as c

    text = " ".join(f"Word{i % 7} has {i} tokens of kind {i % 5}." for i in range(300)) + chr(0xE000)
    sentences = [x for x in c._SENTENCE.split(text) if x.strip()]
    windows = [c._vector(c._hashes(" ".join(sentences[max(0, i - 1) : i + 2]))) for i in range(len(sentences))]
    want = c.breakpoints(c._distances(windows))
    assert len(c.semantic_chunks(text)) == len(want) + 1 > 2
    short = "A line of text. " * 20
    tracemalloc.start()
    c.semantic_chunks(short)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500_000
    asked = []
    monkeypatch.setattr(c, "sha256", lambda x, of=c.sha256: (asked.append(x), of(x))[1])
    c._bucket.cache_clear()
    c.semantic_chunks(short)
    assert sorted(asked) == [b"a", b"line", b"of", b"text"]


def test_rivals_rank_targets_as_all_scores_do(spark):
    """Copies, near copies and targets that are far off; no pairs of vectors that have little in common."""
    from pyspark.sql import functions as F

    from parchment.operators import embedding as e

    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randint(0, 60)}" for _ in range(12))
    first = [text() for _ in range(120)]
    rows = [(d, n, first[d] if n == 0 else text()) for d in range(120) for n in range(3)]
    rows += [(200 + i, 1, first[i]) for i in range(20)] + [(-5, 1, first[7]), (300, 1, " ".join([first[3]] * 40 + ["w0"]))]
    asked = [(d, first[d]) for d in range(100)] + [(d, text()) for d in range(100, 120)] + [(999, "w1 w2")]
    docs = e.sparse_vectors(spark.createDataFrame(rows, "d int, n int, t string").withColumn("key", F.struct("d", "n")), "key", "t")
    queries = e.sparse_vectors(spark.createDataFrame(asked, "q int, t string"), "q", "t")
    targets = docs.select("id", F.col("id.d").alias("query_id")).distinct()
    rank = lambda x: e.hit_rates(x.groupBy("query_id", F.col("id.d").alias("doc")).agg(F.round(F.max("score"), 6).alias("score")).withColumn("target", F.col("query_id"))).first()
    found = e.rivals(docs, queries, targets)
    assert rank(found) == rank(e.cosine_scores(docs, queries))
    near = found.where("query_id < 100").count()
    assert 100 <= near < 2000 < e.cosine_scores(docs, queries.where("id < 100")).count()
