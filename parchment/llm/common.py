"""Shared plumbing of the training-data operators: the shared folder, written
intermediate tables and Arrow batch mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of a text, as the query contracts define them, for Java regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: The six white-space characters that separate such words.
SPACES = " \t\n\x0b\f\r"


#: Rows of an Arrow batch while a table is written; whole texts make large batches.
BATCH_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and all runs on one machine (tests), a temporary folder is made and set;
    on a cluster that is an error, as executors would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='parchment-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, rows: int = ROWS) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    It cuts the lineage, survives lost executors, and gives the planner exact sizes, so that a
    join with it is a broadcast only below spark.sql.autoBroadcastJoinThreshold. Python workers
    get Arrow batches of `rows` rows at most while it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parchment/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    before = int(spark.conf.get(BATCH_ROWS))
    spark.conf.set(BATCH_ROWS, min(before, rows) if before > 0 else rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete what `written` has left behind in this application, once no result that was built on it is
    needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/parchment/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def fold(id_col: str, parts: int):
    """crc32 of the id as text, modulo parts (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def kept(columns: Iterable[str], made: Iterable[str]) -> list[str]:
    """The columns that pass an operator: each once, without those named like one it makes (as Spark
    compares names)."""
    taken, out = {x.lower() for x in made}, []
    for c in columns:
        if c.lower() not in taken:
            taken.add(c.lower())
            out.append(c)
    return out


def sliced(batch, column: int, size: int) -> Iterator:
    """Slices of a record batch with about `size` bytes in a string or list column each."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    values = batch.column(column)
    count = pc.binary_length(values) if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.list_value_length(values)
    total = np.cumsum(pc.fill_null(count, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + size, "right")))
        yield batch.slice(start, end - start)
        start = end


def give_back() -> None:
    """Return what a task has freed to the system: a worker goes on to other tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_texts(
    df: DataFrame,
    text_col: str,
    worker: Callable[[], Callable[[list], dict]],
    schema: str,
    keep: Iterable[str],
    size: int = 1 << 20,
) -> DataFrame:
    """Map Arrow batches of whole texts.

    worker() runs once per task and returns a function from a list of texts (None for null) to a
    dict of Arrow arrays, one value per text. The columns in `keep` are passed through, but for those
    named like a column of the schema, which give way to it. Batches
    are cut into slices of about `size` bytes of text, a longer text alone, so that a task's memory
    doesn't depend on the batch size.
    """
    made_fields = StructType.fromDDL(schema).fields
    keep = kept(keep, (f.name for f in made_fields))
    source = df.select(*keep, F.col(text_col).alias("__text"))
    out = StructType([source.schema[c] for c in keep] + made_fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        apply = worker()
        for batch in batches:
            for part in sliced(batch, len(keep), size):
                made = apply(part.column(len(keep)).to_pylist())
                columns = {c: part.column(i) for i, c in enumerate(keep)} | made
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                del made, columns
        del apply
        give_back()

    return source.mapInArrow(run, out)


class Places:
    """A hash table from distinct keys of 64 bits to their positions; -1 is no key."""

    def __init__(self, keys) -> None:
        import numpy as np

        self.keys = keys
        self.shift = np.uint64(64 - max(4, (2 * len(keys) - 1).bit_length()))
        slots = self._slot(keys)
        order = np.argsort(slots, kind="stable")
        steps = np.arange(len(keys))
        # In the order of their slots, each key goes to its slot or to the next free place behind.
        at = np.maximum.accumulate(slots[order] - steps) + steps
        size = (1 << (64 - int(self.shift))) + len(keys) + 1
        self.key, self.place = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        self.key[at], self.place[at] = keys[order], order

    def _slot(self, keys):
        import numpy as np

        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, wanted):
        """The position of each wanted key, -1 for those that aren't there."""
        import numpy as np

        at = self._slot(wanted)
        there = self.key[at]
        found = np.where(there == wanted, self.place[at], -1)
        more = np.flatnonzero((there != wanted) & (there != -1))
        at = at[more] + 1
        while len(more):
            there = self.key[at]
            hit = there == wanted[more]
            found[more[hit]] = self.place[at[hit]]
            stay = ~hit & (there != -1)
            more, at = more[stay], at[stay] + 1
        return found
