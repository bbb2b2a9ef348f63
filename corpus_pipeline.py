"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Toxic documents go, cross-site boilerplate lines go, one document of each group of near copies
stays, sources are mixed to their target weights, and what is left is encoded.

For all stages: a null text is an empty one; texts of any length are read whole; an empty table gives an empty
table; columns beyond those of documents are passed on, whatever their names, but by the last stage. Null ids
and sources are values like any other. What each stage makes of ties and repeated rows stands with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import bpe, line_dedup, mixing, simhash, toxicity
from parchment.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, with their own columns. Their labels, source
    and language aren't inputs of the score, so repeated rows go or stay together; a score at the
    threshold is rejected. Without labels none is."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return toxicity.passages(whole, model, keep=("doc",)).where(F.col("score") < toxicity.THRESHOLD).select("doc.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines; n_chars is that of the text that stays, null for a null
    text. A line stays where it first stands: the smallest id, then position; null ids last. Rows equal in id
    and text are cut alike."""
    out = line_dedup.remove_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id (null last), of equal ids the smallest
    text hash; of rows equal in both one. Texts without words are copies of each other."""
    return simhash.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document taken for two epochs is there twice. Rows equal in id and text are taken
    together; ties of hashes are broken by them."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them, row by row."""
    return bpe.digests(bpe.encode(docs, bpe.vocabulary(), keep=("doc_id", "source"), round_trip=True))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Neither hashes nor the trained classifier can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
