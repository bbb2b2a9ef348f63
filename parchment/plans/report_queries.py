"""Queries over reports. Orders are documents that a run has dealt with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.operators import reports
from parchment.plans.tables import table



def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "parsed").when(F.col("o_orderstatus") == "O", "fallback").otherwise("failed")
    return o.select("o_orderkey", status.alias("status"), (F.col("o_custkey") % 100 / 8).alias("parser_seconds"), (F.col("o_orderkey") % 50 / 4).alias("total_seconds"))


def outcome_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's documents by outcome, and the seconds of its stages."""
    return reports.run_totals(_outcomes(spark, sf_dir), ("parser_seconds", "total_seconds"))


_OUTCOMES = "o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'parsed' WHEN 'O' THEN 'fallback' ELSE 'failed' END AS status, (o_custkey % 100) / 8.0::DOUBLE AS p, (o_orderkey % 50) / 4.0::DOUBLE AS t FROM orders)"
OUTCOME_TOTALS = f"""
WITH {_OUTCOMES} SELECT count(*) AS total_documents, count(*) FILTER (status = 'parsed') AS parsed_documents, count(*) FILTER (status = 'fallback') AS fallback_documents, count(*) FILTER (status = 'failed') AS failed_documents,
  round(sum(p), 3) AS parser_seconds, round(sum(t), 3) AS total_seconds FROM o"""


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a run's report: totals, then a row for each document."""
    rows = _outcomes(spark, sf_dir)
    head = reports.fields(reports.run_totals(rows), "# Run")
    return head.unionByName(reports.table_lines(rows, "o_orderkey", {"o_orderkey": "Source", "status": "Status"}))


RUN_REPORT = f"""
WITH {_OUTCOMES}, c AS (SELECT count(*) AS a, count(*) FILTER (status = 'parsed') AS b, count(*) FILTER (status = 'fallback') AS d, count(*) FILTER (status = 'failed') AS e FROM o)
SELECT 0 AS part, unnest(range(6)) AS position, unnest(['# Run', '', '- Total Documents: `' || a || '`', '- Parsed Documents: `' || b || '`', '- Fallback Documents: `' || d || '`', '- Failed Documents: `' || e || '`']) AS line FROM c
UNION ALL SELECT 1, unnest([-3, -2, -1]), unnest(['', '| Source | Status |', '| --- | --- |'])
UNION ALL SELECT 1, o_orderkey, '| ' || o_orderkey || ' | ' || status || ' |' FROM o"""


def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric table as one text: a row for each region."""
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name", (F.col("r_regionkey") / 4).alias("hit"))
    return reports.text(reports.table_lines(r, "r_regionkey", {"r_name": "Model", "hit": "Hit@1"}, 0))


METRIC_REPORT = """
SELECT chr(10) || '| Model | Hit@1 |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_name || ' | ' || (r_regionkey / 4.0::DOUBLE) || ' |', chr(10) ORDER BY r_regionkey) || chr(10) AS text FROM region"""


def summary_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported summary of each customer."""
    c = table(spark, sf_dir, "customer")
    points = F.when(F.col("c_custkey") % 2 == 0, F.array(F.col("c_mktsegment"), F.lit(" "), F.lit(" last ")))
    text = reports.summary_text(F.col("c_name"), F.col("c_custkey"), F.lit("pdf"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), "c_name", F.lit(" "))), points)
    return c.select("c_custkey", text.alias("text"))


SUMMARY_EXPORTS = """
SELECT c_custkey, array_to_string(['# ' || c_name || ' 요약', '', '- Document ID: ' || c_custkey, '- Document Type: pdf', '', '## 요약', '', CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '(요약 없음)' END, '', '## 핵심 포인트', '']
  || CASE WHEN c_custkey % 2 = 0 THEN ['- ' || c_mktsegment, '- last'] ELSE ['- 핵심 포인트 없음'] END, chr(10)) || chr(10) AS text FROM customer"""


QUERIES = {"outcome_totals": outcome_totals, "run_report": run_report, "metric_report": metric_report, "summary_exports": summary_exports}
ORACLES = {"outcome_totals": OUTCOME_TOTALS, "run_report": RUN_REPORT, "metric_report": METRIC_REPORT, "summary_exports": SUMMARY_EXPORTS}
