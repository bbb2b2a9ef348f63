"""Queries over pages: rendering, splitting, repeated lines, cleaning and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions import text as t
from parchment.operators import pages
from parchment.plans.tables import conversation_pages, documents, line_pages, table
from parchment.plans.text_queries import _COLLAPSED, _rlike


def pages_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rendered with page headings and split again."""
    rendered = pages.render(conversation_pages(spark, sf_dir))
    return pages.split(rendered).select("document_id", "page_number", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


PAGES_ROUND_TRIP = r"""
SELECT conv_id AS document_id, (turn + 1)::INT AS page_number, length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''))::BIGINT AS n_chars,
  sha256(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) AS text_sha256 FROM conversations WHERE trim(coalesce(text, '')) <> ''"""


def page_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without page headings are one page."""
    whole = pages.split(documents(spark, sf_dir), without_headings="one")
    none = pages.split(documents(spark, sf_dir)).groupBy("document_id").agg(F.count("*").alias("dropped"))
    return whole.join(none, "document_id", "left").select("document_id", "page_number", F.length("text").cast("long").alias("n_chars"), F.coalesce("dropped", F.lit(0)).alias("n_dropped"))


PAGE_POLICIES = r"""SELECT doc_id AS document_id, 1 AS page_number, length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''))::BIGINT AS n_chars, 0::BIGINT AS n_dropped
FROM documents WHERE trim(coalesce(text, '')) <> ''"""


def _key(c: str) -> str:
    """compare_key() as SQL."""
    numbers = rf"regexp_replace(lower({_COLLAPSED.format(c)}), '\b\d{{4}}[./-]\d{{1,2}}[./-]\d{{1,2}}\b', '<date>', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({numbers}, '\b(?:ver(?:sion)?|v)\.?\s*\d+(?:\.\d+){{0,3}}\b', '<version>', 'gi'), '\b\d+(?:[.,/-]\d+)*\b', '<num>', 'g'), '\bpage\s+<num>', '<page>', 'g')"


def _pages_sql(source: str) -> str:
    """CTEs p (document_id, page_number, text) .. l (lines with edge flags), c (catalog)."""
    note = (
        f"length(s) >= {t.LEAST_NOTE} AND ({_rlike('s', t.COPYRIGHT)} OR {_rlike('s', t.DISCLAIMER)} OR {_rlike('s', t.WATERMARK)} OR "
        + " OR ".join(f"starts_with(lower(s), '{x}')" for x in t.LEGAL_OPENINGS)
        + " OR (len(regexp_extract_all(s, '[A-Za-z가-힣]{2,}')) >= 8 AND NOT regexp_matches(s, '^(#|>|\\||- |\\* )')))"
    )
    protected = f"({_rlike('line', t.CAPTION)} OR {_rlike('line', t.SOURCE_NOTE)})"
    return rf"""
p AS ({source}),
r AS (SELECT document_id, page_number, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM p),
l AS (SELECT *, row_number() OVER w <= 4 AS top, row_number() OVER (PARTITION BY document_id, page_number ORDER BY i DESC) <= 4 AS bottom, {_key("line")} AS key, {_COLLAPSED.format("line")} AS s
      FROM r WHERE line <> '' WINDOW w AS (PARTITION BY document_id, page_number ORDER BY i)),
e AS (SELECT *, CASE WHEN top AND bottom THEN ['bottom', 'top'] WHEN top THEN ['top'] WHEN bottom THEN ['bottom'] WHEN {note} THEN ['body'] END AS edges, {protected} AS protected FROM l),
n AS (SELECT document_id, count(DISTINCT page_number) AS pages FROM p GROUP BY 1),
c AS (SELECT document_id, key, arg_min(line, (page_number, i)) AS canonical_text, count(DISTINCT page_number)::INT AS repeat_count, count(DISTINCT page_number) FILTER (protected) AS prot,
        list_sort(list_distinct(flatten(list(edges)))) AS edges, any_value(pages) AS pages
      FROM e JOIN n USING (document_id) WHERE edges IS NOT NULL AND key <> '' GROUP BY 1, 2
      HAVING any_value(pages) >= 2 AND count(DISTINCT page_number) >= greatest(2, ceil(any_value(pages) * 0.5)) AND count(DISTINCT page_number) > count(DISTINCT page_number) FILTER (protected))"""


_LINE_PAGES = """SELECT doc_id AS document_id, g + 1 AS page_number, array_to_string(l[g * 10 + 1 : g * 10 + 10], chr(10)) AS text
  FROM (SELECT doc_id, l, unnest(range(0, (len(l) - 1) // 10 + 1)) AS g FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"""
_TURN_PAGES = "SELECT conv_id AS document_id, (turn + 1)::INT AS page_number, coalesce(text, '') AS text FROM conversations"


def repeated_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat at the edges of a document's pages."""
    found = pages.repeated_lines(line_pages(spark, sf_dir)).unionByName(pages.repeated_lines(conversation_pages(spark, sf_dir)).withColumn("document_id", F.col("document_id") + 1_000_000_000))
    return found.withColumn("edges", F.array_join("edges", ","))


def _catalog(source: str, shift: int) -> str:
    return f"(WITH {_pages_sql(source)} SELECT document_id + {shift} AS document_id, key, canonical_text, repeat_count, round(repeat_count / pages, 4) AS repeat_ratio, array_to_string(edges, ',') AS edges FROM c)"


REPEATED_PAGE_LINES = f"{_catalog(_LINE_PAGES, 0)} UNION ALL {_catalog(_TURN_PAGES, 1_000_000_000)}"


def page_line_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each page's lines, by kind."""
    rows = pages.evaluate_lines(line_pages(spark, sf_dir))
    # Sums of fractions are taken from the last line to the first, and rounded, as in SQL: where half of the last digit
    # is left, the last bit tells.
    scores = F.sort_array(F.collect_list(F.struct("line_index", F.when(F.col("candidate"), F.col("score")).otherwise(0.0).alias("x"))), asc=False)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x["x"])
    return rows.groupBy("document_id", "page_number").agg(
        F.count("*").alias("n_lines"),
        F.count_if("candidate").alias("n_candidates"),
        F.count_if(F.col("removed_as") == "page_number").alias("page_numbers"),
        F.count_if(F.col("removed_as") == "repeated_header").alias("headers"),
        F.count_if(F.col("removed_as") == "repeated_footer").alias("footers"),
        F.count_if(F.col("removed_as") == "noise").alias("noise"),
        (F.round(total * 1000, 0) / 1000).alias("score"),
    )


_CLASS_SCORE = f"least({t.NOISE_LIMIT}::DOUBLE, " + " + ".join(f"CASE WHEN {_rlike('line', p)} THEN {w}::DOUBLE ELSE 0 END" for _, p, w in t.NOISE) + ")"
_ANY_CLASS = "(" + " OR ".join(_rlike("line", p) for _, p, _ in t.NOISE) + ")"
PAGE_LINE_DECISIONS = f"""
WITH {_pages_sql(_LINE_PAGES)},
j AS (SELECT e.*, c.repeat_count IS NOT NULL AS repeated, round(c.repeat_count / c.pages, 4) AS ratio, c.edges[1] AS fe, {_ANY_CLASS} AS classed, {_CLASS_SCORE} AS cs, {_rlike("line", t.PAGE_LINE)} AS number,
        CASE WHEN top OR bottom THEN 0.2::DOUBLE ELSE 0 END AS loc FROM e LEFT JOIN c USING (document_id, key)),
k AS (SELECT *, round(loc + CASE WHEN repeated THEN least(0.55::DOUBLE, 0.25 + ratio * 0.4) ELSE 0 END + cs, 4) AS score, classed OR repeated OR loc > 0 AS cand, CASE WHEN top THEN 'top' WHEN bottom THEN 'bottom' ELSE fe END AS edge FROM j),
d AS (SELECT *, cand AND NOT protected AND (loc > 0 OR repeated) AND score >= CASE WHEN number AND loc >= 0.2 THEN 0.45 ELSE 0.75 END AS remove FROM k)
SELECT document_id, page_number::INT AS page_number, count(*) AS n_lines, count(*) FILTER (cand) AS n_candidates, count(*) FILTER (remove AND number) AS page_numbers,
  count(*) FILTER (remove AND NOT number AND repeated AND edge = 'top') AS headers, count(*) FILTER (remove AND NOT number AND repeated AND edge = 'bottom') AS footers,
  count(*) FILTER (remove AND NOT number AND NOT (repeated AND edge IN ('top', 'bottom'))) AS noise, round(sum(CASE WHEN cand THEN score ELSE 0 END), 3) AS score
FROM d GROUP BY 1, 2"""


def cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned pages of every document, with totals of the run."""
    source = line_pages(spark, sf_dir)
    cleaned = pages.clean(source)
    return cleaned.groupBy("document_id").agg(F.count("*").alias("n_pages"), F.sum("removed").alias("n_removed"), F.sum((F.col("text") == "").cast("long")).alias("n_empty"))


CLEANED_PAGES = f"""
WITH {_pages_sql(_LINE_PAGES)},
j AS (SELECT e.*, c.repeat_count IS NOT NULL AS repeated, round(c.repeat_count / c.pages, 4) AS ratio, {_CLASS_SCORE} AS cs, {_rlike("line", t.PAGE_LINE)} AS number, CASE WHEN top OR bottom THEN 0.2::DOUBLE ELSE 0 END AS loc FROM e LEFT JOIN c USING (document_id, key)),
d AS (SELECT *, NOT protected AND (loc > 0 OR repeated) AND round(loc + CASE WHEN repeated THEN least(0.55::DOUBLE, 0.25 + ratio * 0.4) ELSE 0 END + cs, 4) >= CASE WHEN number AND loc >= 0.2 THEN 0.45 ELSE 0.75 END AS remove FROM j),
g AS (SELECT document_id, page_number, count(*) FILTER (remove) AS removed, count(*) FILTER (NOT remove) AS kept FROM d GROUP BY 1, 2)
SELECT p.document_id, count(*) AS n_pages, sum(coalesce(removed, 0))::BIGINT AS n_removed, sum((coalesce(kept, 0) = 0)::INT)::BIGINT AS n_empty FROM p LEFT JOIN g USING (document_id, page_number) GROUP BY 1"""


def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive summaries of every conversation's pages."""
    s = pages.summaries(conversation_pages(spark, sf_dir))
    return s.select("document_id", "page_number", "summary_text", F.size("key_points").alias("n_points"), "char_count")


_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '([.!?])\s+', concat('\1', chr(10)), 'g'), '\n+', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) >= 15 AND NOT starts_with(x, '#'))"""
PAGE_SUMMARIES = rf"""
WITH b AS (SELECT conv_id AS document_id, (turn + 1)::INT AS page_number, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS b FROM conversations),
s AS (SELECT *, {_SENTENCES.format("b")} AS s0, {_COLLAPSED.format("b")} AS w FROM b WHERE b <> ''),
u AS (SELECT *, list_filter(s0, lambda x, i: list_position(s0, x) = i) AS s FROM s)
SELECT document_id, page_number, CASE WHEN len(s) > 0 THEN array_to_string(s[1:2], ' ') ELSE trim(left(w, 220)) || CASE WHEN length(w) > 220 THEN '...' ELSE '' END END AS summary_text,
  CASE WHEN len(s) > 0 THEN least(3, len(s)) ELSE 1 END::INT AS n_points, length(b)::BIGINT AS char_count FROM u"""


def basic_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic summaries of pages turned into markdown, with their headings."""
    md = page_markdown(spark, sf_dir)
    titles = pages.sections(md).groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_number", "title"))), lambda x: x["title"]).alias("titles"))
    rows = md.join(titles, "document_id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    summary = pages.basic_summary(F.col("source_name"), F.col("titles"), t.candidate_sentences(F.col("markdown")))
    return rows.select("document_id", F.size("titles").alias("n_sections"), summary.alias("summary_text"))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, source_name, markdown): headings and paragraphs of the pages table, by patterns."""
    body = F.regexp_replace("html", r"(?s)<(script|style|nav|footer|head)\b.*?</\1>", "")
    md = F.regexp_replace(F.regexp_replace(body, r"(?s)<h1>(.*?)</h1>", "\n# $1\n"), r"<p>|</p>|<br>", "\n")
    md = F.regexp_replace(F.regexp_replace(md, r"<[^>]*>", ""), r"[ \t]*\n[ \t]*", "\n")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), F.col("url").alias("source_name"), F.regexp_replace(md, r"\A\n+|\n+\z", "").alias("markdown"))


_MARKDOWN = r"""m AS (SELECT page_id AS document_id, url AS source_name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
   regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>', '', 'gs'), '<style\b.*?</style>', '', 'gs'), '<nav\b.*?</nav>', '', 'gs'), '<footer\b.*?</footer>', '', 'gs'), '<head\b.*?</head>', '', 'gs'),
   '<h1>(.*?)</h1>', concat(chr(10), '# \1', chr(10)), 'gs'), '<p>|</p>|<br>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), chr(10)) AS markdown FROM pages)"""
BASIC_SUMMARIES = rf"""
WITH {_MARKDOWN},
l AS (SELECT document_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS i FROM m),
h AS (SELECT document_id, list(regexp_extract(line, '^#{{1,6}}\s+(.*\S)\s*$', 1) ORDER BY i) AS t FROM l WHERE regexp_matches(line, '^#{{1,6}}\s+(.*\S)\s*$') GROUP BY 1),
s AS (SELECT m.*, coalesce(t, []) AS t, {_SENTENCES.format("markdown")} AS s0 FROM m LEFT JOIN h USING (document_id)),
u AS (SELECT *, list_filter(s0, lambda x, i: list_position(s0, x) = i) AS s FROM s)
SELECT document_id, len(t)::INT AS n_sections, source_name || CASE WHEN len(t) > 0 THEN ' | 주요 섹션: ' || array_to_string(t[1:3], ', ') ELSE '' END || CASE WHEN len(s) > 0 THEN ' | 핵심 내용: ' || array_to_string(s[1:2], ' ') ELSE '' END AS summary_text FROM u"""


def merged_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations folded into paragraphs."""
    merged = pages.merge_paragraphs(F.col("text"))
    return conversation_pages(spark, sf_dir).where("text IS NOT NULL").select("document_id", "page_number", F.size(t.lines(F.col("text"))).alias("n_lines"), F.size(t.lines(merged)).alias("n_paragraphs"))


QUERIES = {
    "pages_round_trip": pages_round_trip,
    "page_policies": page_policies,
    "repeated_page_lines": repeated_page_lines,
    "page_line_decisions": page_line_decisions,
    "cleaned_pages": cleaned_pages,
    "page_summaries": page_summaries,
    "basic_summaries": basic_summaries,
    "merged_paragraphs": merged_paragraphs,
}
ORACLES = {
    "pages_round_trip": PAGES_ROUND_TRIP,
    "page_policies": PAGE_POLICIES,
    "repeated_page_lines": REPEATED_PAGE_LINES,
    "page_line_decisions": PAGE_LINE_DECISIONS,
    "cleaned_pages": CLEANED_PAGES,
    "page_summaries": PAGE_SUMMARIES,
    "basic_summaries": BASIC_SUMMARIES,
}
