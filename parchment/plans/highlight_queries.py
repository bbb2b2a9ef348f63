"""Queries over highlights, key terms and mixed scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.operators import highlights
from parchment.plans.tables import conversation_pages
from parchment.plans.retrieval_queries import _both, _numbers, _periods, _tokens
from parchment.plans.vector_queries import _hashed

QUERY = "what does page 3 say of the nation in 2023 and 12.5% growth"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_pages(spark, sf_dir).groupBy("document_id", "page_number").agg(F.min("text").alias("text")).withColumns({"chunk_index": F.col("page_number"), "chunk_type": F.when(F.col("page_number") % 2 == 0, "structured_relation").otherwise("clean_text")})


_P = "p AS (SELECT conv_id AS document_id, (turn + 1)::INT AS page_number, coalesce(min(text), '') AS text FROM conversations GROUP BY 1, 2)"
_TOK = "list_distinct(regexp_extract_all(lower({}), '[0-9A-Za-z가-힣.%]+'))"


def curated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed score of every conversation turn."""
    found = highlights.curated_scores(_turns(spark, sf_dir), QUERY)
    return found.select("document_id", "page_number", "word_overlap", "number_overlap", F.round("key_score", 6).alias("key_score"), "page_points", "score")


CURATED_SCORES = f"""
WITH {_P}, s AS (SELECT document_id * 1000 + page_number AS id, text FROM p UNION ALL SELECT -1, '{QUERY}'), {_hashed("s", 256)},
n AS (SELECT id, sqrt(sum(w * w)) AS n FROM v GROUP BY id), d AS (SELECT a.id, sum(a.w * q.w) AS dot FROM v a JOIN v q USING (bucket) WHERE q.id = -1 GROUP BY a.id),
q AS (SELECT {_TOK.format(f"'{QUERY}'")} AS q), k AS (SELECT q, list_filter(q, lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^\\d+(?:\\.\\d+)?$')) AS kt FROM q),
f AS (SELECT p.*, {_TOK.format("text")} AS b, regexp_replace(lower(text), '\\s+', '', 'g') AS flat, q, kt, coalesce(dot / (n.n * (SELECT n FROM n WHERE id = -1)), 0) AS vs
      FROM p CROSS JOIN k LEFT JOIN d ON d.id = document_id * 1000 + page_number LEFT JOIN n ON n.id = document_id * 1000 + page_number),
z AS (SELECT *, len(list_intersect(q, b))::INT AS w, len(list_intersect(list_filter(q, lambda x: regexp_matches(x, '\\d')), list_filter(b, lambda x: regexp_matches(x, '\\d'))))::INT AS nu,
   coalesce(list_sum(list_transform(list_filter(kt, lambda x: contains(flat, x)), lambda x: CASE WHEN regexp_matches(x, '^(?:20\\d{{2}}|[1-4]?q\\d{{2}}|ytd|qoq)$') THEN 0.05 WHEN length(x) >= 4 THEN 0.42 ELSE 0.18 END)), 0)::DOUBLE AS ks, CASE WHEN page_number = 3 THEN 1.2 ELSE -1.0 END::DOUBLE AS pp FROM f)
SELECT document_id, page_number, w AS word_overlap, nu AS number_overlap, round(ks, 6) AS key_score, pp AS page_points, round(vs + w * 0.035::DOUBLE + nu * 0.08::DOUBLE + ks + CASE WHEN page_number % 2 = 0 THEN 0.16 ELSE 0 END + pp, 6) AS score FROM z"""


def best_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the line of each turn that answers best."""
    return _turns(spark, sf_dir).select("document_id", "page_number", highlights.best_line(F.lit(QUERY), F.coalesce("text", F.lit(""))).alias("line"))


BEST_LINES = f"""
WITH {_P}, l AS (SELECT document_id, page_number, trim(unnest(string_split(text, chr(10))), ' ' || chr(9)) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p),
s AS (SELECT *, len(list_intersect({_TOK.format(f"'{QUERY}'")}, {_TOK.format("line")})) * 2 + len(list_intersect(list_filter({_TOK.format(f"'{QUERY}'")}, lambda x: regexp_matches(x, '\\d')), list_filter({_TOK.format("line")}, lambda x: regexp_matches(x, '\\d')))) * 3 + contains(line, '|')::INT AS s FROM l WHERE line <> '' AND NOT starts_with(line, '|---')),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY s DESC, i) AS n FROM s)
SELECT p.document_id, p.page_number, coalesce(line, '') AS line FROM p LEFT JOIN r ON p.document_id = r.document_id AND p.page_number = r.page_number AND n = 1"""


def best_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of each turn that shares most with the question."""
    return _turns(spark, sf_dir).select("document_id", "page_number", highlights.best_sentence(F.lit(QUERY), F.coalesce("text", F.lit(""))).alias("sentence"))


_QUOTED = r"trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"
BEST_SENTENCES = rf"""
WITH {_P}, q AS (SELECT {_tokens(f"'{QUERY}'")} AS qt), f AS (SELECT document_id, page_number, {_QUOTED} AS x FROM p),
l AS (SELECT document_id, page_number, list_filter(list_transform(regexp_split_to_array(regexp_replace(x, '([.!?])\s+', concat('\1', chr(10)), 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '') AS parts FROM f),
s AS (SELECT document_id, page_number, unnest(parts) AS st, generate_subscripts(parts, 1) AS i FROM l),
r AS (SELECT s.*, row_number() OVER (PARTITION BY document_id, page_number ORDER BY {_both("qt", _tokens("st"))} DESC, length(st) DESC, i) AS n FROM s, q)
SELECT f.document_id, f.page_number, coalesce(st, x) AS sentence FROM f LEFT JOIN r ON f.document_id = r.document_id AND f.page_number = r.page_number AND n = 1"""


def pages_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that the middle of each turn is from, by shared words."""
    turns = _turns(spark, sf_dir)
    pieces = turns.select("document_id", F.struct("document_id", "page_number").alias("chunk_id"), F.substring("text", 30, 90).alias("text"))
    found = highlights.page_by_words(pieces, turns)
    return found.select("chunk_id.document_id", F.col("chunk_id.page_number").alias("source_page"), "page_number", "shared")


PAGES_BY_WORDS = f"""
WITH {_P}, a AS (SELECT document_id, page_number AS source_page, unnest(list_filter({_TOK.format("substr(text, 30, 90)")}, lambda x: length(x) >= 3)) AS w FROM p),
b AS (SELECT document_id, page_number, unnest(list_filter({_TOK.format("text")}, lambda x: length(x) >= 3)) AS w FROM p),
s AS (SELECT document_id, source_page, page_number, count(*) AS shared FROM a JOIN b USING (document_id, w) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, source_page ORDER BY shared DESC, page_number) AS n FROM s)
SELECT document_id, source_page, page_number, shared FROM r WHERE n = 1 AND shared >= 4"""


def plain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of the diagnostics for every turn."""
    rows = _turns(spark, sf_dir).withColumns({"section_hint": F.lit("the nation"), "source_name": F.lit("report 2023")})
    return highlights.plain_scores(rows, QUERY).select("document_id", "page_number", F.col("score").cast("double").alias("score"))


PLAIN_SCORES = f"""
WITH {_P}, q AS (SELECT {_tokens(f"'{QUERY}'")} AS qt, {_numbers(f"'{QUERY}'")} AS qn, {_periods(f"'{QUERY}'")} AS qp)
SELECT document_id, page_number, ({_both("qt", _tokens("text"))} + {_both("qt", _tokens("'the nation'"))} * 3 + {_both("qt", _tokens("'report 2023'"))} * 6 + {_both("qn", _numbers("text"))} * 8 + {_both("qp", _periods("text"))} * 6)::DOUBLE AS score FROM p, q"""


QUERIES = {"curated_scores": curated_scores, "best_lines": best_lines, "best_sentences": best_sentences, "pages_by_words": pages_by_words, "plain_scores": plain_scores}
ORACLES = {"curated_scores": CURATED_SCORES, "best_lines": BEST_LINES, "best_sentences": BEST_SENTENCES, "plain_scores": PLAIN_SCORES, "pages_by_words": PAGES_BY_WORDS}
