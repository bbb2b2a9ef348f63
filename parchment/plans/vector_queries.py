"""Queries over embeddings, cosine search and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.functions.storage import written
from parchment.operators import embedding, evaluation
from parchment.plans.tables import conversation_pages, documents, table

QUESTION = "the nation of the thing and what it is for"


def semantic_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents nearest to a question by hashed embeddings."""
    vectors = embedding.sparse_vectors(documents(spark, sf_dir), "document_id", "markdown")
    scored = embedding.scores_to_one(vectors, QUESTION).select(F.col("id").alias("document_id"), F.round("score", 6).alias("score"))
    return scored.orderBy(F.desc("score"), "document_id").limit(5)


def _hashed(source: str, dims: int) -> str:
    """CTEs v (id, bucket, w) from a relation (id, text)."""
    return f"""
t AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z가-힣{".%" if dims == 256 else ""}]+')) AS tok FROM {source}),
c AS (SELECT id, tok, count(*) AS n, sha256(tok) AS h FROM t GROUP BY ALL),
v AS (SELECT id, (('0x' || substr(h, 1, 8))::BIGINT % {dims})::INT AS bucket,
   sum(n * (CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * (1.0::DOUBLE + ('0x' || substr(h, 11, 2))::INT / 255.0::DOUBLE)) AS w FROM c GROUP BY 1, 2)"""


SEMANTIC_TOP5 = f"""
WITH s AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1, '{QUESTION}'), {_hashed("s", 128)},
n AS (SELECT id, sqrt(sum(w * w)) AS n FROM v GROUP BY id),
d AS (SELECT a.id, sum(a.w * coalesce(q.w, 0)) AS dot FROM v a LEFT JOIN (SELECT * FROM v WHERE id = -1) q USING (bucket) WHERE a.id <> -1 GROUP BY a.id)
SELECT d.id AS document_id, round(dot / (n.n * (SELECT n FROM n WHERE id = -1)), 6) AS score FROM d JOIN n USING (id) ORDER BY score DESC, document_id LIMIT 5"""


def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero buckets of every document, in 128 and 256 dimensions."""
    d = documents(spark, sf_dir)
    parts = [embedding.sparse_vectors(d, "document_id", "markdown", n).withColumn("dims", F.lit(n)) for n in (128, 256)]
    rows = parts[0].unionByName(parts[1])
    return rows.groupBy(F.col("id").alias("document_id"), "dims").agg(F.count("*").alias("n_buckets"), F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"), F.round(F.sum(F.col("weight") * (F.col("bucket") + 1)), 4).alias("moment"))


HASHED_VECTORS = f"""
WITH s AS (SELECT doc_id AS id, text FROM documents), {_hashed("s", 128)}, {_hashed("s", 256).replace("t AS", "t2 AS").replace("c AS", "c2 AS").replace("v AS", "v2 AS").replace("FROM t ", "FROM t2 ").replace("FROM c ", "FROM c2 ")},
a AS (SELECT *, 128 AS dims FROM v UNION ALL SELECT *, 256 FROM v2)
SELECT id AS document_id, dims::INT AS dims, count(*) AS n_buckets, round(sqrt(sum(w * w)), 6) AS norm, round(sum(w * (bucket + 1)), 4) AS moment FROM a GROUP BY ALL"""


def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors, by cosine, of each label's first vector.

    Every vector meets every query, of which there is a row for each label; they are written, so that
    the planner knows their size and broadcasts them only below its threshold.
    """
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    q = v.groupBy("label").agg(F.min_by("e", "vec_id").alias("q"), F.min("vec_id").alias("query_id")).select("query_id", "q")
    pairs = v.join(written(q, "queries"), F.col("vec_id") != F.col("query_id"))
    scored = pairs.select("query_id", "vec_id", F.round(embedding.cosine(F.col("e"), F.col("q")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("query_id", "rank", "vec_id", "score")


EMBEDDING_NEIGHBOURS = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
q AS (SELECT min(vec_id) AS query_id, arg_min(e, vec_id) AS q FROM v GROUP BY label),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(e, q), 6) AS score FROM v, q WHERE vec_id <> query_id),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 3"""


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit@1, Hit@3 and MRR; each conversation is found again by its first turn."""
    pages = conversation_pages(spark, sf_dir)
    # Written, as both sides of the search take them more than once.
    docs = written(embedding.sparse_vectors(pages.withColumn("key", F.struct("document_id", "page_number")), "key", "text"), "pages")
    queries = written(embedding.sparse_vectors(pages.where("page_number = 1"), "document_id", "text"), "queries")
    targets = docs.select("id", F.col("id.document_id").alias("query_id")).distinct()
    # A rank takes no more than what is as near as the target.
    best = embedding.rivals(docs, queries, targets).groupBy("query_id", F.col("id.document_id").alias("doc")).agg(F.round(F.max("score"), 6).alias("score"))
    return embedding.hit_rates(best.withColumn("target", F.col("query_id")))


RETRIEVAL_QUALITY = f"""
WITH s AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), {_hashed("s", 128)},
n AS (SELECT id, sqrt(sum(w * w)) AS n FROM v GROUP BY id),
d AS (SELECT q.id // 1000 AS query_id, a.id // 1000 AS doc, a.id AS page, sum(a.w * q.w) / (any_value(na.n) * any_value(nq.n)) AS score
      FROM v a JOIN v q USING (bucket) JOIN n na ON na.id = a.id JOIN n nq ON nq.id = q.id WHERE q.id % 1000 = 0 GROUP BY 1, 2, 3),
b AS (SELECT query_id, doc, round(max(score), 6) AS score FROM d GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM b),
p AS (SELECT query_id, min(rank) FILTER (doc = query_id) AS rank FROM r GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(coalesce((rank = 1)::INT, 0)), 4) AS hit_at_1, round(avg(coalesce((rank <= 3)::INT, 0)), 4) AS hit_at_3, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr FROM p"""


def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest class centroid of every embedding: hit rates by label."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("d", "x"))
    centre = v.groupBy("label", "d").agg(F.avg("x").alias("c")).withColumnRenamed("label", "class")
    dots = v.join(written(centre, "centres"), "d").groupBy("vec_id", "label", "class").agg(F.sum(F.col("x").cast("double") * F.col("c")).alias("dot"), F.sum(F.col("x").cast("double") * F.col("x")).alias("nv"), F.sum(F.col("c") * F.col("c")).alias("nc"))
    ranked = dots.select(F.col("vec_id").alias("query_id"), F.col("class").alias("doc"), F.col("label").alias("target"), F.round(F.col("dot") / F.sqrt(F.col("nv") * F.col("nc")), 6).alias("score"))
    return embedding.hit_rates(ranked)


LABEL_QUALITY = """
WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
c AS (SELECT label AS class, d, avg(x) AS c FROM v GROUP BY 1, 2),
s AS (SELECT vec_id, label, class, round(sum(x * c) / sqrt(sum(x * x) * sum(c * c)), 6) AS score FROM v JOIN c USING (d) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS rank FROM s),
p AS (SELECT vec_id, min(rank) FILTER (class = label) AS rank FROM r GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(coalesce((rank = 1)::INT, 0)), 4) AS hit_at_1, round(avg(coalesce((rank <= 3)::INT, 0)), 4) AS hit_at_3, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr FROM p"""


def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations' turns packed into requests of at most 6000 characters, per conversation."""
    pages = conversation_pages(spark, sf_dir)
    packed = embedding.batches(pages, "page_number", "text", 6000, ("document_id",))
    return packed.groupBy("document_id").agg(F.count("*").alias("n_texts"), (F.max("batch") + 1).cast("long").alias("n_batches"))


EMBEDDING_BATCHES = """
WITH RECURSIVE s AS (SELECT conv_id, turn, greatest(length(coalesce(text, '')), 1) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, k, n AS room, 0 AS batch FROM s WHERE k = 1
      UNION ALL SELECT s.conv_id, s.k, CASE WHEN f.room + s.n > 6000 THEN s.n ELSE f.room + s.n END, f.batch + (f.room + s.n > 6000)::INT FROM f JOIN s ON s.conv_id = f.conv_id AND s.k = f.k + 1)
SELECT conv_id AS document_id, count(*) AS n_texts, (max(batch) + 1)::BIGINT AS n_batches FROM f GROUP BY 1"""

def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit@1, Hit@3 and MRR of a document for each nation, found by its name and section titles."""
    n = table(spark, sf_dir, "nation")
    key, region = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    text = F.concat(F.lit("# "), "n_name", F.lit(" land\n\nThe land of "), "n_name", F.lit(" has key "), key, F.lit(".\n\n# Region "), region, F.lit("\n\nIt lies in region "), region, F.lit(" of the world."))
    return evaluation.document_quality(n.select(F.col("n_nationkey").alias("document_id"), F.col("n_name").alias("source_name"), text.alias("markdown")))


DOCUMENT_QUALITY = f"""
WITH s AS (SELECT n_nationkey * 10 AS id, n_name || ' land The land of ' || n_name || ' has key ' || n_nationkey AS text FROM nation
      UNION ALL SELECT n_nationkey * 10 + 1, 'Region ' || n_regionkey || ' It lies in region ' || n_regionkey || ' of the world' FROM nation
      UNION ALL SELECT 100000 + n_nationkey * 10, n_name || ' ' || n_name || ' land' FROM nation UNION ALL SELECT 100001 + n_nationkey * 10, n_name || ' Region ' || n_regionkey FROM nation), {_hashed("s", 128)},
n AS (SELECT id, sqrt(sum(w * w)) AS n FROM v GROUP BY id),
d AS (SELECT q.id AS query_id, a.id // 10 AS doc, a.id AS part, sum(a.w * q.w) / (any_value(na.n) * any_value(nq.n)) AS score
      FROM v a JOIN v q USING (bucket) JOIN n na ON na.id = a.id JOIN n nq ON nq.id = q.id WHERE q.id >= 100000 AND a.id < 100000 GROUP BY 1, 2, 3),
b AS (SELECT query_id, doc, round(max(score), 6) AS score FROM d GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM b),
p AS (SELECT query_id, min(rank) FILTER (doc = (query_id - 100000) // 10) AS rank FROM r GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(coalesce((rank = 1)::INT, 0)), 4) AS hit_at_1, round(avg(coalesce((rank <= 3)::INT, 0)), 4) AS hit_at_3, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr FROM p"""


QUERIES = {
    "document_quality": document_quality,
    "semantic_top5": semantic_top5,
    "hashed_vectors": hashed_vectors,
    "embedding_neighbours": embedding_neighbours,
    "retrieval_quality": retrieval_quality,
    "label_quality": label_quality,
    "embedding_batches": embedding_batches,
}
ORACLES = {
    "document_quality": DOCUMENT_QUALITY,
    "semantic_top5": SEMANTIC_TOP5,
    "hashed_vectors": HASHED_VECTORS,
    "embedding_neighbours": EMBEDDING_NEIGHBOURS,
    "retrieval_quality": RETRIEVAL_QUALITY,
    "label_quality": LABEL_QUALITY,
    "embedding_batches": EMBEDDING_BATCHES,
}
