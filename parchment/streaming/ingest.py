"""Streaming ingest: documents that arrive become registry and index rows, batch by batch."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.operators import registry

RECORD = "document_id bigint, position bigint, source_name string, source_hash string, content_hash string, indexed_models array<string>"
_VERSION = re.compile(r"v(\d+)-.*")


class RegistrySink:
    """A foreachBatch sink that merges each batch into a registry kept as numbered versions.

    A version is a folder that is named by its number, the query and the batch, and that counts once its
    writing has ended. The versions there are the sink's only state, so another sink over the same folder
    goes on with the last one. A batch that is run again is merged into the version before its own, so it
    changes nothing. One query at a time writes to a folder.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str) -> None:
        self.spark, self.folder, self.model = spark, folder, model

    def versions(self) -> list[tuple[int, str]]:
        """(number, name) of the complete versions, in order."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        found = [(int(m[1]), name) for name in names if (m := _VERSION.fullmatch(name))]
        return sorted(x for x in found if files.exists(jvm.org.apache.hadoop.fs.Path(path, f"{x[1]}/_SUCCESS")))

    def _read(self, version: tuple[int, str] | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).parquet(f"{self.folder}/{version[1]}")

    def read(self) -> DataFrame:
        return self._read(max(self.versions(), default=None))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        query = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        mark = f"-{query}-{batch_id}"
        before = [v for v in self.versions() if not v[1].endswith(mark)]
        known = self._read(max(before, default=None))
        ingested = registry.ingest(registry.hashed(batch), known, self.model)
        again = ingested.withColumn("existing_id", F.when(F.col("reason").isNull(), F.col("existing_id")))
        after = registry.merged(known, again, self.model)
        number = 1 + max((v[0] for v in before), default=-1)
        after.select([c.split()[0] for c in RECORD.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/v{number}{mark}")


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that has arrived, then stop."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def latest_rows(stream: DataFrame, folder: str, checkpoint: str, mode: str = "complete") -> str:
    """Run a stream whose result of the last batch is written to a folder; returns the folder."""
    run(stream, lambda df, _: df.write.mode("overwrite").parquet(folder), checkpoint, mode)
    return folder
