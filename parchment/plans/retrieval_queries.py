"""Queries over lexical retrieval, page lookup, citations and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.operators import retrieval
from parchment.plans.tables import conversation_pages, table

QUERY = "Which table shows the nation of 2023, 1,200 orders and 5% on page 3"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as chunks, each under a section named after its speaker."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("document_id"), F.concat(F.lit("source "), (F.col("conv_id") % 7).cast("string")).alias("source_name"), F.concat(F.lit("Page "), (F.col("turn") + 1).cast("string"), F.lit(" "), F.col("role")).alias("section_hint"), F.col("turn").cast("int").alias("chunk_index"), (F.col("turn") + 1).cast("int").alias("page_number"), F.col("text"))


def _ordered(c: DataFrame) -> DataFrame:
    return c.dropDuplicates(["document_id", "chunk_index"])


_C = """c AS (SELECT conv_id AS document_id, 'source ' || (conv_id % 7) AS source_name, 'Page ' || (turn + 1) || ' ' || role AS section_hint, turn::INT AS chunk_index, (turn + 1)::INT AS page_number, coalesce(text, '') AS text FROM conversations)"""


def _tokens(c: str) -> str:
    """The search token set of ASCII text as SQL."""
    b = f"regexp_extract_all(lower({c}), '[0-9A-Za-z가-힣]+')"
    w = f"regexp_replace(lower({c}), '[^0-9a-zA-Z가-힣]+', '', 'g')"
    pairs = f"list_transform(range(1, len({b})), lambda i: CASE WHEN length({b}[i]) >= 2 AND length({b}[i + 1]) >= 2 AND length({b}[i]) + length({b}[i + 1]) <= 24 THEN {b}[i] || {b}[i + 1] END)"
    return f"list_distinct(list_filter({b} || {pairs} || CASE WHEN len({b}) > 0 AND length({w}) BETWEEN 2 AND 24 THEN [{w}] ELSE [] END, lambda x: x IS NOT NULL))"


def _numbers(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({c}), '\b\d[\d,]*(?:\.\d+)?%?\b'))"


def _periods(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({c}), '\b[1-4]q(?:fy)?\d{{2,4}}\b') || regexp_extract_all(lower({c}), '\bfy\d{{2,4}}\b') || regexp_extract_all(lower({c}), '\bh[12]\s?\d{{2,4}}\b') || regexp_extract_all(lower({c}), '\b20\d\d\b'))"


def _both(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def _compact(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^0-9a-zA-Z가-힣]+', '', 'g')"


_Q = f"q AS (SELECT {_tokens(f"'{QUERY}'")} AS qt, list_filter({_tokens(f"'{QUERY}'")}, lambda x: length(x) >= 2) AS qi, {_numbers(f"'{QUERY}'")} AS qn, {_periods(f"'{QUERY}'")} AS qp)"


def _intents(c: str) -> str:
    return f"len(list_filter(qi, lambda x: contains({_compact(c)}, x)))"


_SCORED = f"""{_C}, {_Q},
s AS (SELECT c.*, {_both("qt", _tokens("text"))} AS sh, {_both("qt", _tokens("section_hint"))} AS se, {_both("qt", _tokens("source_name"))} AS so, {_intents("source_name")} * 7 + {_intents("section_hint")} * 12 + {_intents("text")} * 5 AS it,
   {_both("qn", _numbers("text"))} * 8 + {_both("qp", _periods("text"))} * 6 AS ex FROM c, q),
o AS (SELECT *, (so * 6 + se * 3 + sh + it + ex + CASE WHEN page_number = 3 THEN 30 ELSE -25 END + CASE WHEN it <= 0 THEN -12 ELSE 0 END)::DOUBLE AS overlap, greatest(0, 100 - sh)::DOUBLE AS distance FROM s)"""


def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every conversation turn for a question."""
    return retrieval.scored(_chunks(spark, sf_dir), QUERY).select("document_id", "chunk_index", "overlap", "distance")


LEXICAL_SCORES = f"WITH {_SCORED} SELECT document_id, chunk_index, overlap, distance FROM o"


def lexical_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best turns."""
    return retrieval.search(_ordered(_chunks(spark, sf_dir)), QUERY).select("document_id", "chunk_index", "overlap")


LEXICAL_TOP5 = f"WITH {_SCORED} SELECT DISTINCT ON (document_id, chunk_index) document_id, chunk_index, overlap FROM (SELECT * FROM o ORDER BY overlap DESC, distance, document_id, chunk_index LIMIT 5)"


def sentence_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relevance of every sentence of every turn."""
    rows = retrieval.scored(_chunks(spark, sf_dir), QUERY)
    return retrieval.sentence_scores(rows, QUERY).groupBy("document_id").agg(F.count("*").alias("n_sentences"), F.round(F.sum("relevance"), 4).alias("total"), F.round(F.max("relevance"), 4).alias("best"))


SENTENCE_RELEVANCE = rf"""
WITH {_SCORED},
p AS (SELECT o.*, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', concat('\1', chr(10)), 'g'), '\n+', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS st FROM o),
r AS (SELECT document_id, {_both("qt", _tokens("st"))} * 10.0 + se * 6.0 + {_both("qn", _numbers("st"))} * 12.0 + {_both("qp", _periods("st"))} * 10.0 - distance AS rel FROM p, q)
SELECT document_id, count(*) AS n_sentences, round(sum(rel), 4)::DOUBLE AS total, round(max(rel), 4)::DOUBLE AS best FROM r GROUP BY 1"""


TABLE_QUERY = "성장률 실적 표"


def table_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for a table over orders as one-line tables, half of them on pages with tables."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("document_id"), F.lit(0).alias("chunk_index"), F.when(F.col("o_orderstatus") == "F", "실적").otherwise("notes").alias("section_hint"), F.concat(F.when(F.col("o_orderstatus") == "O", "growth").otherwise("성장률"), F.lit(" | "), F.col("o_orderstatus")).alias("text"), (F.col("o_custkey") % 2 == 0).alias("page_has_table"), F.lit(0.5).alias("distance"))
    return retrieval.sentence_scores(rows, TABLE_QUERY).select("document_id", "sentence", "relevance")


TABLE_QUESTION = """
SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus = 'O' THEN 'growth' ELSE '성장률' END || ' | ' || o_orderstatus AS sentence,
  (16 + CASE WHEN o_orderstatus <> 'O' THEN 10 + 8 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 6 + 10 + 6 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 12 ELSE 0 END - 0.5)::DOUBLE AS relevance
FROM orders"""


def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question to answer: search, sentences, evidence, answer."""
    matches = retrieval.search(_ordered(_chunks(spark, sf_dir)), QUERY)
    found = retrieval.evidence(retrieval.sentence_scores(matches, QUERY))
    return retrieval.answer(found).select("answer", F.size("cited").alias("n_cited"))


def turn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of its conversation that the middle of each turn fits best."""
    pages = conversation_pages(spark, sf_dir).groupBy("document_id", "page_number").agg(F.min("text").alias("text"))
    chunks = pages.select("document_id", F.col("page_number").alias("chunk_id"), F.substring("text", 20, 60).alias("text"), F.lit("the").alias("section_hint"))
    ids = chunks.withColumn("chunk_id", F.struct("document_id", "chunk_id"))
    best = retrieval.align_pages(ids, pages)
    return best.select("chunk_id.document_id", F.col("chunk_id.chunk_id").alias("chunk_id"), "page_number", "score", "shared")


_PLAIN = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
TURN_ALIGNMENT = rf"""
WITH p AS (SELECT conv_id AS document_id, (turn + 1)::INT AS page_number, min(text) AS text FROM conversations GROUP BY 1, 2),
l AS (SELECT document_id, page_number AS chunk_id, {_PLAIN.format("substr(text, 20, 60)")} AS c FROM p), r AS (SELECT document_id, page_number, {_PLAIN.format("text")} AS p FROM p),
x AS (SELECT l.document_id, chunk_id, page_number, c, p, list_intersect(list_distinct(regexp_extract_all(c, '[0-9A-Za-z가-힣]+')), list_distinct(regexp_extract_all(p, '[0-9A-Za-z가-힣]+'))) AS s FROM l JOIN r USING (document_id) WHERE len(regexp_extract_all(c, '[0-9A-Za-z가-힣]+')) > 0),
y AS (SELECT *, len(s) * 3.0 + CASE WHEN contains(p, c) THEN 1200 WHEN contains(c, p) THEN 700 ELSE 0 END + CASE WHEN contains(p, 'the') THEN 120.0 ELSE 0 END + len(list_filter(s, lambda t: regexp_matches(t, '[0-9]'))) * 6.0 AS score FROM x WHERE len(s) > 0 OR len(list_distinct(regexp_extract_all(c, '[0-9A-Za-z가-힣]+'))) < 3),
z AS (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY score DESC, page_number) AS n FROM y)
SELECT document_id, chunk_id, page_number, score::DOUBLE AS score, len(s)::BIGINT AS shared FROM z WHERE n = 1 AND score > 0 AND (len(s) > 0 OR score >= 100)"""


def quote_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that a quote from each turn is looked up on."""
    pages = conversation_pages(spark, sf_dir).groupBy("document_id", "page_number").agg(F.min("text").alias("text"))
    quotes = pages.select(F.struct("document_id", "page_number").alias("quote_id"), "document_id", F.substring("text", 10, 50).alias("quote"))
    texts = pages.withColumn("kind", F.when(F.col("page_number") % 3 == 0, "chunk").when(F.col("page_number") % 3 == 1, "markdown").otherwise("element"))
    found = retrieval.lookup_pages(quotes, texts)
    return found.select("quote_id.document_id", F.col("quote_id.page_number").alias("quoted_page"), "page_number", "score")


QUOTE_PAGES = rf"""
WITH p AS (SELECT conv_id AS document_id, (turn + 1)::INT AS page_number, min(text) AS text FROM conversations GROUP BY 1, 2),
f0 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '^\s+', ''), '\s+$', '') AS x FROM p), f AS MATERIALIZED (SELECT *, {_tokens("x")} AS xt FROM f0),
q0 AS (SELECT document_id, page_number AS quoted_page, regexp_replace(regexp_replace(regexp_replace(substr(text, 10, 50), '[ \t]+', ' ', 'g'), '^\s+', ''), '\s+$', '') AS q FROM p), q AS MATERIALIZED (SELECT *, {_tokens("q")} AS qt FROM q0),
y AS (SELECT q.document_id, quoted_page, page_number, page_number % 3 AS k,
  CASE WHEN contains(x, q) THEN CASE page_number % 3 WHEN 0 THEN 1000.0 WHEN 1 THEN 1500 ELSE 1600 END WHEN contains(q, x) THEN CASE page_number % 3 WHEN 0 THEN 700 WHEN 1 THEN 900 ELSE 1000 END ELSE 0 END
  + {_both("qt", "xt")} * CASE page_number % 3 WHEN 0 THEN 12.0 WHEN 1 THEN 10 ELSE 18 END AS score FROM q JOIN f USING (document_id) WHERE len(qt) > 0),
a AS (SELECT *, row_number() OVER (PARTITION BY document_id, quoted_page, k > 0 ORDER BY score DESC, k DESC, page_number) AS n1, row_number() OVER (PARTITION BY document_id, quoted_page ORDER BY score DESC, k DESC, page_number) AS n2,
  max(score) FILTER (k > 0) OVER (PARTITION BY document_id, quoted_page) AS best FROM y WHERE score > 0)
SELECT document_id, quoted_page, page_number, score::DOUBLE AS score FROM a WHERE CASE WHEN coalesce(best, 0) >= 800 THEN k > 0 AND n1 = 1 ELSE n2 = 1 END"""


def turn_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each turn fits the one before."""
    p = conversation_pages(spark, sf_dir).groupBy("document_id", "page_number").agg(F.min("text").alias("text"))
    before = p.select("document_id", (F.col("page_number") + 1).alias("page_number"), F.col("text").alias("before"))
    return p.join(before, ["document_id", "page_number"]).select("document_id", "page_number", F.round(retrieval.overlap_score(F.col("before"), F.col("text")), 4).alias("score"))


_M = r"lower(trim(regexp_replace(regexp_replace({}, '[*_`#>\-\[\]()|]', ' ', 'g'), '\s+', ' ', 'g')))"
TURN_OVERLAPS = f"""
WITH p AS (SELECT conv_id AS document_id, (turn + 1)::INT AS page_number, min(text) AS text FROM conversations GROUP BY 1, 2),
m AS (SELECT b.document_id, b.page_number, {_M.format("a.text")} AS a, {_M.format("b.text")} AS b FROM p a JOIN p b ON a.document_id = b.document_id AND a.page_number + 1 = b.page_number)
SELECT document_id, page_number, round(CASE WHEN a = '' OR b = '' THEN -1.0 WHEN a = b THEN 20000 WHEN contains(b, a) THEN 12000 - abs(length(a) - length(b)) WHEN contains(a, b) THEN 10000 - abs(length(a) - length(b))
 ELSE coalesce(list_sum(list_transform(list_filter(string_split(b, ' '), lambda x: x <> '' AND list_contains(string_split(a, ' '), x)), lambda x: CASE WHEN length(x) > 2 THEN 12.0 ELSE 4.0 END)), 0) - abs(length(a) - length(b)) * 0.05 END, 4)::DOUBLE AS score FROM m"""


def citation_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from turns and the chunks that they resolve to."""
    turns = conversation_pages(spark, sf_dir).groupBy("document_id", "page_number").agg(F.min("text").alias("text"))
    matches = turns.withColumns({"chunk_index": F.col("page_number"), "distance": (F.col("page_number") * 7 % 50).cast("double")})
    citations = turns.select(F.struct("document_id", "page_number").alias("citation_id"), "document_id", F.substring("text", 5, 40).alias("quote"), F.lit(2).alias("chunk_index"))
    found = retrieval.resolve_citations(citations, matches)
    return found.select("document_id", F.col("citation_id.page_number").alias("cited_page"), "matched_chunk", "score")


CITATION_MATCHES = r"""
WITH p AS (SELECT conv_id AS document_id, (turn + 1)::INT AS page_number, min(text) AS text FROM conversations GROUP BY 1, 2),
f AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '^\s+', ''), '\s+$', '') AS x, regexp_replace(regexp_replace(regexp_replace(substr(text, 5, 40), '[ \t]+', ' ', 'g'), '^\s+', ''), '\s+$', '') AS q FROM p),
s AS (SELECT a.document_id, a.page_number AS cited_page, b.page_number AS matched_chunk, CASE WHEN a.q <> '' AND contains(b.x, a.q) THEN 1000.0 WHEN a.q <> '' AND contains(a.q, b.x) THEN 600 ELSE 0 END
   + CASE WHEN b.page_number = 2 THEN 400 ELSE 0 END + greatest(0, 100 - b.page_number * 7 % 50) AS score FROM f a JOIN f b USING (document_id) WHERE b.x <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, cited_page ORDER BY score DESC, matched_chunk) AS n FROM s)
SELECT document_id, cited_page, matched_chunk, score::DOUBLE AS score FROM r WHERE n = 1"""


def lane_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four line items of each supplier: two returned, one accepted, one other lane first."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"))
    found = retrieval.lane_quota(items, "l_suppkey", "l_returnflag", "l_extendedprice", {"R": 2, "A": 1, "N": 1}, 4, "item")
    return found.select("l_suppkey", "item", "rank")


LANE_QUOTAS = """
WITH i AS (SELECT l_suppkey, l_returnflag, l_extendedprice AS p, l_orderkey * 10 + l_linenumber AS item FROM lineitem),
a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY p DESC, item) <= CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 WHEN 'N' THEN 1 ELSE 0 END AS q FROM i),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, p DESC, item) AS n FROM a)
SELECT l_suppkey, item, row_number() OVER (PARTITION BY l_suppkey ORDER BY p DESC, item)::INT AS rank FROM b WHERE n <= 4"""


def selected_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table and the picture of each order that lead by enough."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citation_id"), F.col("l_linenumber").alias("asset_id"), F.when(F.col("l_linenumber") % 2 == 1, "table").otherwise("image").alias("kind"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").alias("synthetic"))
    found = retrieval.select_assets(items.groupBy("citation_id", "asset_id", "kind").agg(F.max("score").alias("score"), F.bool_or("synthetic").alias("synthetic")))
    return found.groupBy("kind", "synthetic").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"))


SELECTED_ASSETS = """
WITH i AS (SELECT l_orderkey AS c, l_linenumber AS a, CASE WHEN l_linenumber % 2 = 1 THEN 'table' ELSE 'image' END AS kind, max(l_quantity) AS score, bool_or(l_returnflag = 'R') AS synthetic FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS next FROM i WINDOW w AS (PARTITION BY c, kind ORDER BY score DESC, a))
SELECT kind, synthetic, count(*) AS n, round(sum(score), 2) AS total FROM r WHERE n = 1 AND score >= CASE WHEN kind = 'image' THEN 9 WHEN synthetic THEN 18 ELSE 12 END
  AND (next IS NULL OR score - next >= CASE WHEN kind = 'image' THEN 3 WHEN synthetic THEN 5 ELSE 4 END) GROUP BY 1, 2"""


def asset_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which combinations of shared tokens, numbers and periods speak for a citation."""
    grid = spark.range(3).select(F.col("id").cast("int").alias("tokens")).join(spark.range(2).select(F.col("id").cast("int").alias("numbers"))).join(spark.range(2).select(F.col("id").cast("int").alias("periods")))
    kinds = grid.select("*", F.explode(F.array(*[F.lit(k) for k in ("image", "table", "text")])).alias("kind"), F.explode(F.array(F.lit(False))).alias("synthetic"))
    zero = F.lit(0)
    return kinds.select("kind", "tokens", "numbers", "periods", retrieval.asset_supports(F.col("kind"), F.col("synthetic"), F.col("tokens"), F.col("numbers"), F.col("periods"), F.col("numbers"), zero).alias("supports"))


ASSET_SUPPORT = """
WITH g AS (SELECT kind, t::INT AS tokens, n::INT AS numbers, p::INT AS periods FROM range(3) a(t), range(2) b(n), range(2) c(p), (VALUES ('image'), ('table'), ('text')) k(kind))
SELECT *, CASE kind WHEN 'image' THEN tokens >= 2 OR (numbers + periods > 0 AND tokens >= 1) WHEN 'table' THEN (numbers > 0 AND tokens + periods > 0) OR (periods > 0 AND tokens >= 2) OR tokens >= 3 OR (tokens >= 2 AND numbers = 0)
  ELSE (numbers > 0 AND tokens + periods > 0) OR (periods > 0 AND tokens >= 1) OR tokens >= 2 END AS supports FROM g"""


QUERIES = {
    "lexical_scores": lexical_scores,
    "lexical_top5": lexical_top5,
    "sentence_relevance": sentence_relevance,
    "table_question": table_question,
    "extractive_answer": extractive_answer,
    "turn_alignment": turn_alignment,
    "quote_pages": quote_pages,
    "turn_overlaps": turn_overlaps,
    "citation_matches": citation_matches,
    "lane_quotas": lane_quotas,
    "selected_assets": selected_assets,
    "asset_support": asset_support,
}
ORACLES = {
    "lexical_scores": LEXICAL_SCORES,
    "lexical_top5": LEXICAL_TOP5,
    "sentence_relevance": SENTENCE_RELEVANCE,
    "table_question": TABLE_QUESTION,
    "turn_alignment": TURN_ALIGNMENT,
    "quote_pages": QUOTE_PAGES,
    "turn_overlaps": TURN_OVERLAPS,
    "citation_matches": CITATION_MATCHES,
    "lane_quotas": LANE_QUOTAS,
    "selected_assets": SELECTED_ASSETS,
    "asset_support": ASSET_SUPPORT,
}
