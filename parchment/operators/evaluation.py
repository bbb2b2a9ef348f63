"""Evaluation of an embedding: whether documents are found again by their names and section titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import text as t
from parchment.operators import chunks, embedding, pages

#: Chunks that stand for a document, section titles that are asked for.
MOST_CHUNKS, MOST_TITLES = 12, 3


def title_questions(docs: DataFrame) -> DataFrame:
    """(query_id, target, query) of documents (document_id, source_name, markdown): the name with each of the
    first three section titles, the name alone if there are none."""
    found = pages.sections(docs).where("title <> ''")
    order = Window.partitionBy("document_id").orderBy("line_number")
    first = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_TITLES).select("document_id", "n", "title")
    rows = docs.select("document_id", t.text("source_name").alias("name")).join(first, "document_id", "left")
    query = F.concat_ws(" ", "name", "title")
    return rows.select(F.struct("document_id", F.coalesce("n", F.lit(0)).alias("n")).alias("query_id"), F.col("document_id").alias("target"), query.alias("query"))


def document_scores(docs: DataFrame, questions: DataFrame, dimensions: int = embedding.DIMENSIONS) -> DataFrame:
    """(query_id, doc, score): for each question and document the best cosine of its first twelve rule-based
    chunks. Pairs come from a join by vector bucket; those that share none score zero and have no row."""
    cut = chunks.chunk(docs).where(F.col("chunk_index") < MOST_CHUNKS).withColumn("key", F.struct("document_id", "chunk_index"))
    vectors = embedding.sparse_vectors(cut, "key", "text", dimensions)
    asked = embedding.sparse_vectors(questions, "query_id", "query", dimensions)
    scores = embedding.cosine_scores(vectors, asked)
    return scores.groupBy("query_id", F.col("id.document_id").alias("doc")).agg(F.round(F.max("score"), 6).alias("score"))


def document_quality(docs: DataFrame, dimensions: int = embedding.DIMENSIONS) -> DataFrame:
    """One row: questions, hit_at_1, hit_at_3 and mrr of documents found by names and titles."""
    questions = title_questions(docs)
    found = document_scores(docs, questions, dimensions).join(questions.select("query_id", "target"), "query_id")
    return embedding.hit_rates(found)
