"""The index registry: duplicates, incremental ingest, upserts and deletes.

A registry is a table (position, document_id, source_name, source_hash, content_hash,
indexed_models). Files can't be merged in place, so a change is the new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import text as t


def hashed(docs: DataFrame, text_col: str = "markdown") -> DataFrame:
    """docs with source_hash (of the text as it is) and content_hash (white space collapsed)."""
    return docs.withColumns({"source_hash": F.sha2(t.text(text_col), 256), "content_hash": t.content_hash(t.text(text_col))})


def find_duplicates(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """docs with reason, existing_id and existing_models of the first registry record that has the
    same source hash or the same content hash; nulls if there is none.

    Two equi joins against one record per hash; the earlier position wins, the source hash on ties.
    """
    first = F.min(F.struct("position", F.col("document_id").alias("id"), F.col("indexed_models").alias("models")))
    by_source = registry.where("source_hash IS NOT NULL").groupBy("source_hash").agg(first.alias("__s"))
    by_content = registry.where("content_hash IS NOT NULL").groupBy("content_hash").agg(first.alias("__c"))
    joined = docs.join(by_source, "source_hash", "left").join(by_content, "content_hash", "left")
    source = F.col("__s").isNotNull() & (F.col("__c").isNull() | (F.col("__s.position") <= F.col("__c.position")))
    found = F.when(source, F.col("__s")).otherwise(F.col("__c"))
    reason = F.when(source, "source_hash").when(F.col("__c").isNotNull(), "content_hash")
    return joined.withColumns({"reason": reason, "existing_id": found["id"], "existing_models": found["models"]}).drop("__s", "__c")


def ingest(docs: DataFrame, registry: DataFrame, model: str, order_col: str = "document_id") -> DataFrame:
    """docs in order with status: duplicate if a registry record that is indexed for the model, or an
    earlier document of the same ingest, has the same content; else indexed.

    Only ids and hashes go through the lookups; a content that many documents share costs one row
    per task, and a join whose hot keys can be split. Rows of one id and content get one status each;
    of one id and several contents, each has the status of its own.
    """
    by = [order_col, "source_hash", "content_hash"]
    keys = find_duplicates(docs.select(*by).distinct(), registry)
    first = docs.groupBy("content_hash").agg(F.min(order_col).alias("__first"))
    rows = keys.join(first, "content_hash", "left")
    known = F.coalesce(F.array_contains("existing_models", model), F.lit(False))
    earlier = F.col("__first") != F.col(order_col)
    rows = rows.select(
        *(F.col(c).alias(f"__{c}") for c in by),
        F.when(known | earlier, "duplicate").otherwise("indexed").alias("status"),
        F.when(known, F.col("reason")).when(earlier, "content_hash").alias("reason"),
        F.when(known, F.col("existing_id")).when(earlier, F.col("__first")).alias("existing_id"),
        "existing_models",
    )
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return docs.join(rows, same).drop(*(f"__{c}" for c in by))


def partition_uploads(uploads: DataFrame, in_flight: DataFrame, registry: DataFrame, order_col: str = "position") -> DataFrame:
    """Uploads with a reason to skip them: same_batch, already_processing, same_source_hash; null to go on."""
    rows = uploads.join(uploads.groupBy("source_hash").agg(F.min(order_col).alias("__first")), "source_hash")
    rows = rows.join(in_flight.select("source_hash", F.lit(True).alias("__busy")).distinct(), "source_hash", "left")
    rows = rows.join(registry.select("source_hash", F.lit(True).alias("__known")).distinct(), "source_hash", "left")
    later = F.col("__first") != F.col(order_col)
    reason = F.when(later, "same_batch").when(F.col("__busy"), "already_processing").when(F.col("__known"), "same_source_hash")
    return rows.withColumn("reason", reason).drop("__first", "__busy", "__known")


def merged(registry: DataFrame, ingested: DataFrame, model: str) -> DataFrame:
    """The registry after an ingest: the model is added to records whose documents were indexed
    again, new documents go to the end in the order of their ids, rows of one id and content once."""
    indexed = ingested.where("status = 'indexed'")
    again = indexed.where("existing_id IS NOT NULL").select(F.col("existing_id").alias("document_id"), F.lit(True).alias("__again")).distinct()
    old = registry.join(again, "document_id", "left").withColumn("indexed_models", F.when(F.col("__again"), F.array_union("indexed_models", F.array(F.lit(model)))).otherwise(F.col("indexed_models")))
    last = registry.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("__last"))
    new = indexed.where("existing_id IS NULL").dropDuplicates(["document_id", "source_hash", "content_hash"])
    lowest = new.agg(F.min("document_id").alias("__low"))
    # One row each.
    new = new.join(F.broadcast(last)).join(F.broadcast(lowest))
    position = F.col("__last") + 1 + F.col("document_id") - F.col("__low")
    new = new.select("document_id", position.alias("position"), "source_name", "source_hash", "content_hash", F.array(F.lit(model)).alias("indexed_models"))
    return old.select(new.columns).unionByName(new)


def chunk_ids(content_hash: Column, strategy: Column, index: Column) -> Column:
    return F.concat_ws(":", content_hash, strategy, index.cast("string"))


def upsert(index: DataFrame, rows: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The latest version of each row by key; the same rows again change nothing."""
    united = index.unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.desc(version))
    return united.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def delete(index: DataFrame, document_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is left, counts of deleted rows by document)."""
    gone = document_ids.select("document_id").distinct()
    return index.join(gone, "document_id", "left_anti"), index.join(gone, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("deleted"))


def related(docs: DataFrame, name_col: str = "source_name") -> DataFrame:
    """(document_id, related_id): documents with the same normalised source name, in one direction
    per group: each with the smallest id of its name."""
    key = t.source_key(t.text(name_col))
    group = docs.groupBy(key.alias("__k")).agg(F.min("document_id").alias("related_id"), F.count("*").alias("n_related"))
    return docs.withColumn("__k", key).join(group, "__k").select("document_id", "related_id", "n_related")


def totals(statuses: DataFrame) -> DataFrame:
    """Totals of a run by outcome."""
    return statuses.groupBy("status").agg(F.count("*").alias("documents"))
