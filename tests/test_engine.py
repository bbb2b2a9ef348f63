"""The engine's interface on a small folder."""

from pyspark.sql import functions as F

from parchment.engine import Engine

TEXTS = [
    (1, "Energy report.pdf", "# Page 1\n\n# Wind power\n\nWind power grew by 12% in 2023 across the northern regions of the country.\n\n# Page 2\n\nSolar power fell behind. The ministry expects 1,200 new turbines."),
    (2, "Cooking.txt", "Boil the water first. Add the pasta and wait for eleven minutes before you serve it to guests."),
    (3, "cooking.TXT", "Boil  the water first.\nAdd the pasta and wait for eleven minutes before you serve it to guests."),
    (4, "empty", None),
]


def test_ingest_ask_and_delete(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/engine")
    assert tuple(engine.status().first()) == (0, 0, 0)
    docs = spark.createDataFrame(TEXTS, "document_id bigint, source_name string, markdown string")
    status = {r.document_id: (r.status, r.existing_id) for r in engine.ingest(docs).collect()}
    assert status == {1: ("indexed", None), 2: ("indexed", None), 3: ("duplicate", 2), 4: ("indexed", None)}
    assert {r.status for r in engine.ingest(docs).collect()} == {"duplicate"}
    assert [(r.document_id, r.n_related) for r in engine.documents().collect()] == [(1, 1), (2, 1), (4, 1)]
    assert [r.page_number for r in engine.content(1).collect()] == [1, 2]
    best = engine.search("how much did wind power grow in 2023", 2).first()
    assert best.document_id == 1 and "12%" in best.text
    assert engine.search("anything", 3, document_ids=[2]).select("document_id").distinct().collect()[0][0] == 2
    assert engine.search("anything", 3, source_name=" COOKING.txt").count() > 0
    answer = engine.answer("how long does the pasta take").first()
    assert "eleven minutes" in answer.answer and answer.cited[0] == 2
    summary = engine.summaries([1]).first().summary_text
    assert summary.startswith("Energy report.pdf") and "Wind power" in summary
    assert engine.page_summaries(1).count() == 2
    assert {r.document_id for r in engine.delete([2, 99]).collect()} == {2}
    assert engine.status().select(F.col("documents")).first()[0] == 2
    assert engine.search("pasta", 3, document_ids=[2]).count() == 0
    again = {r.document_id: r.status for r in engine.ingest(docs.where("document_id = 3")).collect()}
    assert again == {3: "indexed"}


def test_changes_append_and_compaction_keeps_all(spark, tmp_path):
    folder = f"file://{tmp_path}/engine"
    engine = Engine(spark, folder)
    engine.ingest(spark.createDataFrame(TEXTS[:2], "document_id bigint, source_name string, markdown string"))
    first = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "engine" / "chunks" / "0").iterdir()}
    engine.ingest(spark.createDataFrame([(1, "Energy report.pdf", "Hydrogen is new here.")], "document_id bigint, source_name string, markdown string"))
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "engine" / "chunks" / "0").iterdir()} == first
    assert [r.text for r in engine.content(1).collect()] == ["Hydrogen is new here."]
    engine.delete([2])

    def state(e):
        return [sorted(map(str, e.table(n).drop("version").collect())) for n in ("documents", "chunks", "registry", "vectors")]

    before = state(engine)
    assert len(before[0]) == 1 and "Hydrogen" in engine.search("hydrogen", 1).first().text
    engine.compact()
    other = Engine(spark, folder)
    assert state(other) == before and list((tmp_path / "engine" / "done").iterdir())
    assert {r.status for r in other.ingest(spark.createDataFrame(TEXTS[1:2], "document_id bigint, source_name string, markdown string")).collect()} == {"indexed"}
    assert "eleven minutes" in other.answer("how long does the pasta take").first().answer
