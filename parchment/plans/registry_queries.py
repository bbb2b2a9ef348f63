"""Queries over the registry: duplicates, ingest, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.operators import registry
from parchment.plans.tables import conversation_pages, documents, fixture, table, values

MODEL = "local-deterministic-v1-128"


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A registry of the documents with even ids, and the documents with odd ones to ingest."""
    docs = registry.hashed(documents(spark, sf_dir))
    even = docs.where("document_id % 2 = 0").groupBy("content_hash").agg(F.min(F.struct("document_id", "source_name", "source_hash")).alias("x"))
    known = even.select(
        F.col("x.document_id").alias("document_id"), F.col("x.document_id").alias("position"), "x.source_name", "x.source_hash", "content_hash",
        F.when(F.col("x.document_id") % 3 == 0, F.array(F.lit("other-model"))).otherwise(F.array(F.lit(MODEL))).alias("indexed_models"),
    )
    return known, docs.where("document_id % 2 = 1")


_HASHES = r"h AS (SELECT doc_id AS document_id, source AS source_name, sha256(coalesce(text, '')) AS sh, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS ch FROM documents)"
_KNOWN = "k AS (SELECT ch, min(document_id) AS document_id, arg_min(sh, document_id) AS sh, min(document_id) % 3 <> 0 AS cur FROM h WHERE document_id % 2 = 0 GROUP BY ch)"
_INGEST = f"""{_HASHES}, {_KNOWN},
o AS (SELECT h.document_id, h.ch, k.document_id AS ex, coalesce(cur, false) AS cur, k.sh = h.sh AS same, min(h.document_id) OVER (PARTITION BY h.ch) AS f FROM h LEFT JOIN k USING (ch) WHERE h.document_id % 2 = 1)"""


def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of documents that meet a registry."""
    known, new = _parts(spark, sf_dir)
    return registry.ingest(new, known, MODEL).select("document_id", "status", F.coalesce("reason", F.lit("")).alias("reason"), F.col("existing_id").cast("long").alias("existing_id"))


INGEST_STATUS = f"""
WITH {_INGEST}
SELECT document_id, CASE WHEN cur OR f <> document_id THEN 'duplicate' ELSE 'indexed' END AS status,
 CASE WHEN cur THEN CASE WHEN same THEN 'source_hash' ELSE 'content_hash' END WHEN f <> document_id THEN 'content_hash' ELSE '' END AS reason, CASE WHEN cur THEN ex WHEN f <> document_id THEN f END AS existing_id FROM o"""


def registry_after_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and models of the registry after the ingest."""
    known, new = _parts(spark, sf_dir)
    done = registry.find_duplicates(new, known)
    plain = registry.ingest(new, known, MODEL).drop("existing_id").join(done.select("document_id", "existing_id"), "document_id")
    after = registry.merged(known, plain, MODEL)
    return after.groupBy(F.array_join("indexed_models", ",").alias("models")).agg(F.count("*").alias("records"), F.countDistinct("content_hash").alias("contents"))


REGISTRY_AFTER_INGEST = f"""
WITH {_INGEST},
n AS (SELECT ch FROM o WHERE ex IS NULL AND f = document_id), a AS (SELECT DISTINCT ch FROM o WHERE ex IS NOT NULL AND NOT cur AND f = document_id),
r AS (SELECT ch, CASE WHEN cur THEN '{MODEL}' WHEN a.ch IS NOT NULL THEN 'other-model,{MODEL}' ELSE 'other-model' END AS models FROM k LEFT JOIN a USING (ch) UNION ALL SELECT ch, '{MODEL}' FROM n)
SELECT models, count(*) AS records, count(DISTINCT ch) AS contents FROM r GROUP BY 1"""


def upload_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads that are skipped, and why. Ids ending in 1 are being processed, those ending in
    2 are known, all others are uploads."""
    docs = registry.hashed(documents(spark, sf_dir)).withColumn("position", F.col("document_id"))
    busy, known = docs.where("document_id % 10 = 1"), docs.where("document_id % 10 = 2")
    found = registry.partition_uploads(docs.where("document_id % 10 NOT IN (1, 2)"), busy, known)
    return found.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("uploads"))


UPLOAD_REASONS = f"""
WITH {_HASHES}, u AS (SELECT sh, row_number() OVER (PARTITION BY sh ORDER BY document_id) AS n FROM h WHERE document_id % 10 NOT IN (1, 2))
SELECT CASE WHEN n > 1 THEN 'same_batch' WHEN sh IN (SELECT sh FROM h WHERE document_id % 10 = 1) THEN 'already_processing' WHEN sh IN (SELECT sh FROM h WHERE document_id % 10 = 2) THEN 'same_source_hash' ELSE 'accepted' END AS reason, count(*) AS uploads FROM u GROUP BY 1"""


def index_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of conversation turns after an upsert of changed turns and a delete."""
    turns = conversation_pages(spark, sf_dir).groupBy("document_id", "page_number").agg(F.min("text").alias("text"))
    rows = turns.withColumn("id", registry.chunk_ids(F.sha2(F.col("document_id").cast("string"), 256), F.lit("semantic"), F.col("page_number")))
    first = rows.withColumn("version", F.lit(1))
    again = rows.where("page_number % 2 = 0").withColumns({"version": F.lit(2), "text": F.concat("text", F.lit("!"))})
    left, _ = registry.delete(registry.upsert(registry.upsert(first, again), again), rows.where("document_id % 5 = 0"))
    return left.groupBy("document_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("version") == 2).alias("n_changed"), F.sum(F.length("text")).alias("n_chars"))


INDEX_UPSERTS = """
WITH t AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2)
SELECT conv_id AS document_id, count(*) AS n_rows, count(*) FILTER (turn % 2 = 1) AS n_changed, sum(length(text) + (turn % 2 = 1)::INT)::BIGINT AS n_chars FROM t WHERE conv_id % 5 <> 0 GROUP BY 1"""


def related_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the same source, and how many there are."""
    return registry.related(documents(spark, sf_dir))


RELATED_DOCUMENTS = "SELECT doc_id AS document_id, min(doc_id) OVER (PARTITION BY lower(trim(source))) AS related_id, count(*) OVER (PARTITION BY lower(trim(source))) AS n_related FROM documents"

SOURCES = [(0, "Annual Report 2024.pdf"), (1, "quarterly results q3.pdf"), (2, "Board minutes.docx"), (3, "annual budget.xlsx")]
ASKED = "what does the annual report 2024 say"


def source_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that a question names, if it leads by three points."""
    from parchment.operators import retrieval

    catalog = fixture(spark, SOURCES, "document_id int, source_name string")
    return retrieval.source_candidate(catalog, ASKED).select("document_id", "score")


SOURCE_CANDIDATE = f"""
WITH s(document_id, n) AS (VALUES {values(SOURCES)}), k AS (SELECT document_id, regexp_replace(lower(n), '\\.[a-z]+$', '') AS n, list_filter(regexp_split_to_array(regexp_replace(lower(n), '\\.[a-z]+$', ''), '[\\s_\\-()]+'), lambda x: length(x) >= 2) AS t FROM s),
c AS (SELECT document_id, (CASE WHEN contains('{ASKED}', n) THEN 100 ELSE 0 END + coalesce(list_sum(list_transform(list_filter(t, lambda x: contains('{ASKED}', x)), lambda x: length(x))), 0))::INT AS score FROM k),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, document_id) AS n, lead(score, 1, 0) OVER (ORDER BY score DESC, document_id) AS next FROM c)
SELECT document_id::INT AS document_id, score FROM r WHERE n = 1 AND score >= next + 3"""


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of an event stream by type and outcome, as a run report counts them."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


RUN_TOTALS = "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1"

QUERIES = {
    "ingest_status": ingest_status,
    "registry_after_ingest": registry_after_ingest,
    "upload_reasons": upload_reasons,
    "index_upserts": index_upserts,
    "related_documents": related_documents,
    "source_candidate": source_candidate,
    "run_totals": run_totals,
}
ORACLES = {
    "ingest_status": INGEST_STATUS,
    "registry_after_ingest": REGISTRY_AFTER_INGEST,
    "upload_reasons": UPLOAD_REASONS,
    "index_upserts": INDEX_UPSERTS,
    "related_documents": RELATED_DOCUMENTS,
    "source_candidate": SOURCE_CANDIDATE,
    "run_totals": RUN_TOTALS,
}
