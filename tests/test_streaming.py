"""The registry sink over restarts, and ingests with repeated ids."""

from parchment.operators import registry
from parchment.streaming.ingest import RECORD, RegistrySink, run

DOCS = [(i, f"name {i}", f"text of document {i % 5}") for i in range(8)]
SCHEMA = "document_id bigint, source_name string, markdown string"


def rows(sink):
    return sorted((r.document_id, r.position, tuple(r.indexed_models)) for r in sink.read().collect())


def test_another_sink_goes_on_with_the_folder(spark, tmp_path):
    folder = f"file://{tmp_path}/registry"
    first = RegistrySink(spark, folder, "m")
    assert rows(first) == []
    first(spark.createDataFrame(DOCS[:6], SCHEMA), 0)
    before = rows(first)
    assert [r[0] for r in before] == [0, 1, 2, 3, 4]
    again = RegistrySink(spark, folder, "m")
    assert rows(again) == before
    again(spark.createDataFrame(DOCS[:6], SCHEMA), 0)  # the last batch, run again
    assert rows(again) == before
    again(spark.createDataFrame(DOCS[5:] + [(9, "new", "something else")], SCHEMA), 1)
    assert [r[0] for r in rows(again)] == [0, 1, 2, 3, 4, 9]
    assert rows(RegistrySink(spark, folder, "m")) == rows(again)


def test_a_version_that_was_not_ended_does_not_count(spark, tmp_path):
    folder = f"file://{tmp_path}/registry"
    sink = RegistrySink(spark, folder, "m")
    sink(spark.createDataFrame(DOCS[:2], SCHEMA), 0)
    (tmp_path / "registry" / "v1-batch-1").mkdir()
    assert [r[0] for r in rows(sink)] == [0, 1]


def test_a_stream_that_restarts(spark, tmp_path):
    folder = f"file://{tmp_path}/registry"
    for part in (DOCS[:3], DOCS[3:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        run(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), RegistrySink(spark, folder, "m"), f"{tmp_path}/checkpoint")
    assert [r[0] for r in rows(RegistrySink(spark, folder, "m"))] == [0, 1, 2, 3, 4]


def test_repeated_ids_are_not_multiplied(spark):
    docs = spark.createDataFrame([(1, "a", "same"), (1, "a", "same"), (1, "a", "same"), (1, "b", "other"), (2, "c", "same"), (None, "d", None)], SCHEMA)
    empty = spark.createDataFrame([], RECORD)
    got = registry.ingest(registry.hashed(docs), empty, "m").select("document_id", "markdown", "status").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(
        map(repr, [(1, "same", "indexed")] * 3 + [(1, "other", "indexed"), (2, "same", "duplicate"), (None, None, "indexed")])
    )
    after = registry.merged(empty, registry.ingest(registry.hashed(docs), empty, "m"), "m")
    assert sorted(repr(r.document_id) for r in after.collect()) == ["1", "1", "None"]
