"""The engine as an interface: ingest documents, ask questions, summarise, list and delete.

State is a folder of Parquet segments. A change appends segments, and tombstones for documents whose older
rows no longer count, and then names all segments in a small manifest; nothing is rewritten until `compact`.
Chunks' vectors are stored with them. One engine writes to a folder at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions import text as t
from parchment.operators import chunks, embedding, pages, registry, retrieval
from parchment.sources.adapters import Options
from parchment.streaming.ingest import RECORD

DOCUMENTS = "document_id bigint, source_name string, markdown string"
CHUNKS = "document_id bigint, retrieval_lane string, chunk_index int, chunk_id string, text string, char_count int, section_hint string, page_number int, chunk_type string, source_name string"
VECTORS = "document_id bigint, chunk_index int, bucket int, weight double"
SCHEMAS = {"documents": DOCUMENTS, "chunks": CHUNKS, "registry": RECORD, "vectors": VECTORS}
GONE = "name string, document_id bigint, version int"
MANIFEST = "name string, segment string"


class Engine:
    """Tables: documents, chunks, registry, vectors."""

    def __init__(self, spark: SparkSession, folder: str, options: Options | None = None) -> None:
        self.spark, self.folder, self.options = spark, folder.rstrip("/"), options or Options()

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(path, f"{n}/_SUCCESS")))

    def _manifest(self) -> dict[str, list[str]]:
        """The segments of each table as of the last change: one row a change and table."""
        found = self._versions()
        segments: dict[str, list[str]] = {}
        if found:
            for r in self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/done/{found[-1]}").collect():
                segments.setdefault(r.name, []).append(r.segment)
        return segments

    def _segments(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{x}" for x in self._manifest().get(name, [])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        """A table as of the last change; empty at first. A tombstone ends a document's rows of older
        versions."""
        rows = self._segments(name, f"{SCHEMAS[name]}, version int")
        if "gone" not in self._manifest():
            return rows.drop("version")
        gone = self._segments("gone", GONE).where(F.col("name") == name).groupBy("document_id").agg(F.max("version").alias("__until"))
        return rows.join(gone, "document_id", "left").where(F.col("__until").isNull() | (F.col("version") >= F.col("__until"))).drop("version", "__until")

    def _write(self, number: int, name: str, df: DataFrame, schema: str) -> str:
        """Write a segment; returns its place below the folder."""
        columns = [F.col(c.split()[0]).cast(c.split(None, 1)[1]) for c in schema.split(", ")]
        df.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/{number}")
        return f"{name}/{number}"

    def _commit(self, number: int, gone: DataFrame, fresh: bool = False, **tables: DataFrame) -> None:
        """Append rows to tables and tombstones (name, document_id), or begin anew, and name the segments."""
        segments = {} if fresh else self._manifest()
        for name, df in tables.items():
            segments.setdefault(name, []).append(self._write(number, name, df.withColumn("version", F.lit(number)), f"{SCHEMAS[name]}, version int"))
        if not fresh:
            segments.setdefault("gone", []).append(self._write(number, "gone", gone.withColumn("version", F.lit(number)), GONE))
        rows = [(name, x) for name, places in segments.items() for x in places]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/done/{number}")

    def _next(self) -> int:
        return max(self._versions(), default=-1) + 1

    def compact(self) -> None:
        """Rewrite all tables as one segment each, without what tombstones ended."""
        if self._versions():
            self._commit(self._next(), self.spark.createDataFrame([], GONE), fresh=True, **{name: self.table(name) for name in SCHEMAS})

    def _chunked(self, docs: DataFrame) -> DataFrame:
        """The hybrid chunks of documents: semantic chunks and one clean chunk a page."""
        semantic = chunks.chunk(docs, "semantic").select("document_id", "chunk_index", "text")
        by_page = pages.split(docs, without_headings="one").withColumn("body", pages.compact_blank_lines(F.col("text")))
        clean = by_page.select("document_id", F.col("page_number").alias("chunk_index"), F.concat(F.format_string("## Page %d\n\nContent:\n\n", "page_number"), "body").alias("text"))
        found = chunks.hybrid([("legacy_context", semantic), ("clean_context", clean)])
        page = t.page_number(F.lit(None).cast("string"), F.when(F.col("retrieval_lane") == "clean_context", F.substring("text", 1, 20)))
        first = F.regexp_extract("text", r"(?m)^#{1,6}\s+(.*\S)\s*$", 1)
        names = docs.select("document_id", "source_name")
        return found.join(names, "document_id").withColumns(
            {"page_number": page, "section_hint": first, "chunk_type": F.when(F.col("retrieval_lane") == "clean_context", "clean_text").otherwise("main_markdown_semantic")}
        )

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Add documents (document_id, source_name, markdown); returns document_id, status, reason and
        existing_id. Documents with known content for the embedder's model are duplicates."""
        model, number = self.options.embedder.model_name, self._next()
        known = self.table("registry")
        # Duplicates are looked up once: what the tables get and what is reported is read from here.
        found = registry.ingest(registry.hashed(docs.select("document_id", "source_name", "markdown")), known, model)
        found.write.mode("overwrite").parquet(f"{self.folder}/reports/{number}")
        status = self.spark.read.schema(found.schema).parquet(f"{self.folder}/reports/{number}")
        again = status.withColumn("existing_id", F.when(F.col("reason").isNull(), F.col("existing_id")))
        new = status.where("status = 'indexed'").select("document_id", "source_name", "markdown")
        indexed = again.where("status = 'indexed'").select(F.coalesce("existing_id", "document_id").alias("document_id")).distinct()
        records = registry.merged(known, again, model).join(indexed, "document_id", "left_semi")
        cut = self._chunked(new)
        cut = self.spark.read.schema(CHUNKS).parquet(f"{self.folder}/{self._write(number, 'cut', cut, CHUNKS)}")
        ids = new.select("document_id").distinct()
        gone = [ids.withColumn("name", F.lit(name)) for name in ("documents", "chunks", "vectors")] + [indexed.withColumn("name", F.lit("registry"))]
        ended = gone[0].unionByName(gone[1]).unionByName(gone[2]).unionByName(gone[3])
        self._commit(number, ended, documents=new, chunks=cut, registry=records, vectors=self._hashed(cut))
        return status.select("document_id", "status", "reason", "existing_id")

    def _hashed(self, rows: DataFrame) -> DataFrame:
        """The vectors of chunks."""
        found = embedding.sparse_vectors(rows.withColumn("key", F.struct("document_id", "chunk_index")), "key", "text")
        return found.select("id.document_id", "id.chunk_index", "bucket", "weight")

    def documents(self) -> DataFrame:
        """Documents by normalised source name: the smallest id, and how many share it."""
        d = registry.related(self.table("documents").select("document_id", "source_name"))
        return d.where("document_id = related_id").join(self.table("documents").select("document_id", "source_name"), "document_id").select("document_id", "source_name", "n_related").orderBy("document_id")

    def content(self, document_id: int) -> DataFrame:
        """The pages of a document."""
        return pages.split(self.table("documents").where(F.col("document_id") == document_id), without_headings="one").orderBy("page_number")

    def search(self, question: str, k: int | None = None, document_ids: list[int] | None = None, source_name: str | None = None) -> DataFrame:
        """The best chunks. Without a scope, the hashed embeddings choose which chunks are scored."""
        k = k or self.options.top_k
        rows = self.table("chunks")
        if document_ids is not None or source_name is not None:
            if document_ids is not None:
                rows = rows.where(F.col("document_id").isin(document_ids))
            if source_name is not None:
                rows = rows.where(t.source_key(t.text("source_name")) == t.source_key(F.lit(source_name)))
            return retrieval.search(rows, question, k)
        vectors = self.table("vectors").withColumn("id", F.struct("document_id", "chunk_index"))
        near = embedding.scores_to_one(vectors, question).orderBy(F.desc("score"), "id").limit(embedding.over_fetch(k))
        chosen = near.select("id.document_id", "id.chunk_index")
        return retrieval.search(rows.join(F.broadcast(chosen), ["document_id", "chunk_index"], "left_semi"), question, k)

    def answer(self, question: str, k: int | None = None, **scope) -> DataFrame:
        """One row: the extractive answer and the documents that it cites."""
        found = retrieval.evidence(retrieval.sentence_scores(self.search(question, k, **scope), question))
        return retrieval.answer(found)

    def summaries(self, document_ids: list[int] | None = None) -> DataFrame:
        """Basic summaries of documents."""
        docs = self.table("documents")
        docs = docs if document_ids is None else docs.where(F.col("document_id").isin(document_ids))
        titles = pages.sections(docs).groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_number", "title"))), lambda x: x["title"]).alias("titles"))
        rows = docs.join(titles, "document_id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
        return rows.select("document_id", pages.basic_summary(F.col("source_name"), F.col("titles"), t.candidate_sentences(t.text("markdown"))).alias("summary_text"))

    def page_summaries(self, document_id: int) -> DataFrame:
        return pages.summaries(self.content(document_id))

    def delete(self, document_ids: list[int]) -> DataFrame:
        """Take documents out of all tables; returns how many chunks each had."""
        number = self._next()
        gone = self.spark.createDataFrame([(i,) for i in document_ids], "document_id bigint").distinct()
        counts = registry.delete(self.table("chunks"), gone)[1]
        counts.write.mode("overwrite").parquet(f"{self.folder}/reports/{number}")
        self._commit(number, gone.withColumn("name", F.explode(F.array(*map(F.lit, SCHEMAS)))))
        return self.spark.read.schema("document_id bigint, deleted bigint").parquet(f"{self.folder}/reports/{number}")

    def status(self) -> DataFrame:
        """One row: documents, chunks and registry records."""
        counts = [self.table(n).agg(F.count("*").alias(n)) for n in ("documents", "chunks", "registry")]
        return counts[0].join(counts[1]).join(counts[2])
