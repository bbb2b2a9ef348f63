"""Reports as they are written."""

import json
import re

from parchment.operators import reports


def test_reports_are_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b|c", None), (1, "a", 0.5)], "n int, name string, hit double")
    lines = reports.fields(reports.run_totals(rows.selectExpr("'parsed' AS status", "hit AS total_seconds"), ("total_seconds",)), "# Run").unionByName(reports.table_lines(rows, "n", {"name": "Name", "hit": "Hit"}))
    reports.save_lines(lines, f"{tmp_path}/report")
    written = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert written.split("\n")[:3] == ["# Run", "", "- Total Documents: `2`"] and written.endswith("\n\n| Name | Hit |\n| --- | --- |\n| a | 0.5 |\n| b\\|c |  |\n")
    assert reports.text(lines).first().text == written
    reports.save_json(rows, f"{tmp_path}/json")
    read = [json.loads(x) for p in (tmp_path / "json").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(read, key=lambda r: r["n"]) == [{"n": 1, "name": "a", "hit": 0.5}, {"n": 2, "name": "b|c", "hit": None}]
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00", spark.range(1).select(reports.utc_now()).first()[0])


def test_empty_runs_and_summaries(spark):
    none = spark.createDataFrame([], "status string, s double")
    assert tuple(reports.run_totals(none, ("s",)).first()) == (0, 0, 0, 0, 0.0)
