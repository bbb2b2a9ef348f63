"""Lexical retrieval: scoring chunks and sentences, evidence, answers, citations and page lookup.

A question is one row of features that is joined to every chunk; a chunk's score is arithmetic over
intersections of token sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import text as t

#: Words that no intent token holds, phrases that ask for tables, words of table sections.
INTENT_STOPS = ("표", "테이블", "수치", "숫자", "알려줘", "보여줘", "보여주", "궁금해", "대해", "대한", "관련", "내용", "요약")
TABLE_PHRASES = ("표", "테이블", "손익계산서", "재무제표", "수치", "숫자", "항목", "series table")
TABLE_SECTIONS = ("표", "현황", "실적", "비율", "재무상태표", "손익계산서", "추진 실적", "총회", "이사회")
#: Words of table headers.
HEADER_WORDS = ("성장률", "비율", "증감", "달성률", "개최일자", "참석인원", "항목", "실적", "계획")
#: Weights of the page lookup by kind of candidate text: equal part, part of, further text, token.
LOOKUP_WEIGHTS = {"element": (1600.0, 1000.0, 240.0, 18.0), "markdown": (1500.0, 900.0, 220.0, 10.0), "chunk": (1000.0, 700.0, 180.0, 12.0)}
ENOUGH = 800.0


def any_of(c: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, p: a | c.contains(p), phrases, F.lit(False))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(t.text(c)), "[^0-9a-zA-Z가-힣]+", "")


def has_table(c: Column) -> Column:
    """A bar, a table marker, or two lines with a colon among the first eight."""
    c = t.quoted(c)
    first = F.slice(F.filter(F.transform(F.split(c, "\n"), t.strip), lambda x: x != ""), 1, 8)
    return (c != "") & (c.contains("|") | c.contains("[표:") | (F.size(F.filter(first, lambda x: x.contains(":"))) >= 2))


def question(spark, query: str) -> DataFrame:
    """The features of a question, one row."""
    q = F.col("q")
    intents = F.filter(t.search_tokens(q), lambda x: (F.length(x) >= 2) & ~any_of(x, INTENT_STOPS))
    return spark.createDataFrame([(query,)], "q string").select(
        t.search_tokens(q).alias("q_tokens"), intents.alias("q_intents"), t.numeric_tokens(q).alias("q_numbers"), t.temporal_tokens(q).alias("q_periods"), t.requested_pages(q).alias("q_pages"), any_of(F.lower(q), TABLE_PHRASES).alias("q_table")
    )


def _shared(a: str, b: Column) -> Column:
    return F.size(F.array_intersect(F.col(a), b))


def _intents_in(c: str) -> Column:
    """How many of the question's intents a compact text holds."""
    return F.size(F.filter("q_intents", lambda x: F.col(c).contains(x)))


def scored(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks with `overlap`, the lexical score of a question, and `distance` = max(0, 100 - tokens shared).

    Needs document_id, source_name, section_hint, text; page_number, chunk_type and page_has_table
    count if they are there.
    """
    have = set(chunks.columns)
    page = F.col("page_number") if "page_number" in have else F.lit(None).cast("int")
    kind = F.col("chunk_type") if "chunk_type" in have else F.lit("")
    on_page = F.coalesce(F.col("page_has_table"), F.lit(False)) if "page_has_table" in have else F.lit(False)
    source, section, body = (t.text(c) for c in ("source_name", "section_hint", "text"))
    rows = chunks.join(F.broadcast(question(chunks.sparkSession, query)))
    rows = rows.withColumn("__shared", _shared("q_tokens", t.search_tokens(body))).withColumn("__section", _shared("q_tokens", t.search_tokens(section)))
    rows = rows.withColumns({"__c1": compact(source), "__c2": compact(section), "__c3": compact(body)})
    rows = rows.withColumn("__intent", _intents_in("__c1") * 7 + _intents_in("__c2") * 12 + _intents_in("__c3") * 5).drop("__c1", "__c2", "__c3")
    words = _shared("q_tokens", t.search_tokens(source)) * 6 + F.col("__section") * 3 + F.col("__shared")
    exact = _shared("q_numbers", t.numeric_tokens(body)) * 8 + _shared("q_periods", t.temporal_tokens(body)) * 6
    asked = F.when((F.size("q_pages") == 0) | page.isNull(), 0).when(F.array_contains("q_pages", page), 30).otherwise(-25)
    lane = F.when(kind == "structured_relation", 10).when(kind == "clean_text", 3).otherwise(0)
    tabular = F.when(has_table(body), 12).otherwise(0) + F.when(any_of(t.quoted(section), TABLE_SECTIONS), 8).otherwise(0) + F.when(on_page, 10).otherwise(0) + F.col("__section") * 3
    wanted = F.size("q_intents") > 0
    extra = F.when(F.col("q_table") & (~wanted | (F.col("__intent") > 0)), tabular).when(wanted & (F.col("__intent") <= 0), -12).otherwise(0)
    rows = rows.withColumn("overlap", (words + F.col("__intent") + exact + asked + lane + extra).cast("double")).withColumn("distance", F.greatest(F.lit(0.0), 100.0 - F.col("__shared")))
    return rows.drop("__shared", "__section", "__intent", *[c for c in rows.columns if c.startswith("q_")])


def search(chunks: DataFrame, query: str, k: int = 5) -> DataFrame:
    """The k best chunks by overlap, then distance, then document and chunk."""
    return scored(chunks, query).orderBy(F.desc("overlap"), "distance", "document_id", "chunk_index").limit(k)


def sentence_scores(matches: DataFrame, query: str) -> DataFrame:
    """Sentences of matched chunks with their relevance; tables count as one sentence. A question for
    tables looks for table structure, sections and pages with tables (page_has_table, if it is
    there), and for the header words that it names."""
    on_page = F.coalesce(F.col("page_has_table"), F.lit(False)) if "page_has_table" in matches.columns else F.lit(False)
    parts = matches.withColumn("__s", t.sentences(t.text("text"))).select("*", F.posexplode("__s").alias("sentence_index", "sentence")).drop("__s")
    rows = parts.join(F.broadcast(question(matches.sparkSession, query)))
    s, section = F.col("sentence"), t.text("section_hint")
    score = _shared("q_tokens", t.search_tokens(s)) * 10.0 + _shared("q_tokens", t.search_tokens(section)) * 6.0 + _shared("q_numbers", t.numeric_tokens(s)) * 12.0 + _shared("q_periods", t.temporal_tokens(s)) * 10.0 - F.col("distance")
    table = F.when(has_table(s), 16.0).otherwise(0.0) + F.when(any_of(t.quoted(section), TABLE_SECTIONS), 10.0).otherwise(0.0)
    headers = F.array_intersect("q_tokens", F.array(*map(F.lit, HEADER_WORDS)))
    named = lambda c: F.size(F.array_intersect(headers, t.search_tokens(c)))
    table = table + F.when(on_page, 12.0).otherwise(0.0) + named(s) * 8.0 + named(section) * 6.0
    score = score + F.when(F.col("q_table"), table).otherwise(0.0)
    rows = rows.withColumn("relevance", score)
    return rows.drop(*[c for c in rows.columns if c.startswith("q_")])


def evidence(sentences: DataFrame, k: int = 5) -> DataFrame:
    """The first k sentences, distinct by document and text, numbered."""
    top = sentences.orderBy(F.desc("relevance"), "document_id", "chunk_index", "sentence_index").limit(k)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("relevance"), "document_id", "chunk_index", "sentence_index")
    same = Window.partitionBy("document_id", "sentence").orderBy(F.desc("relevance"), "chunk_index", "sentence_index")
    # k rows.
    kept = top.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    return kept.withColumn("source_number", F.row_number().over(order))


def answer(found: DataFrame) -> DataFrame:
    """The extractive answer: the first three pieces of evidence, and where they are from."""
    rows = F.sort_array(F.collect_list(F.struct("source_number", "sentence", "document_id")))
    return found.agg(rows.alias("r")).select(F.array_join(F.transform(F.slice("r", 1, 3), lambda x: x["sentence"]), " ").alias("answer"), F.transform(F.slice("r", 1, 3), lambda x: x["document_id"]).alias("cited"))


def distinct_citations(citations: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """Citations distinct by their keys, the first one kept, numbered anew."""
    first = Window.partitionBy(*keys).orderBy(order_col)
    kept = citations.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.withColumn("citation_number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order_col)))


def resolve_citations(citations: DataFrame, matches: DataFrame) -> DataFrame:
    """Each citation (citation_id, document_id, quote, chunk_index) with its best match's chunk:
    1000 if the match has the quote, 600 if the quote has the match, 400 for the same chunk, and
    what the distance is under 100. Citations without a match of their document keep nulls."""
    m = matches.select("document_id", F.col("chunk_index").alias("m_chunk"), t.quoted(t.text("text")).alias("m_text"), F.col("distance").alias("m_distance")).where("m_text <> ''")
    q = t.quoted(t.text("quote"))
    inside = F.when((q != "") & F.col("m_text").contains(q), 1000.0).when((q != "") & q.contains(F.col("m_text")), 600.0).otherwise(0.0)
    score = inside + F.when(F.col("chunk_index") == F.col("m_chunk"), 400.0).otherwise(0.0) + F.greatest(F.lit(0.0), 100.0 - F.col("m_distance"))
    best = citations.join(m, "document_id").withColumn("score", score).groupBy("citation_id").agg(F.max_by(F.struct("m_chunk", "score"), F.struct("score", -F.col("m_chunk"))).alias("x"))
    return citations.join(best, "citation_id", "left").select(*citations.columns, F.col("x.m_chunk").alias("matched_chunk"), F.col("x.score").alias("score"))


def _candidates(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Pairs of a left row and a page of the same document that share a token, with the number of
    shared tokens and of those with a digit; left rows of one or two tokens meet all pages.

    A row that stands in a page as a whole shares its inner tokens with it, so nothing is lost.
    """
    one = left.select(id_col, "document_id", F.explode("tokens").alias("token"))
    pages = right.select("document_id", "page_number", F.explode("page_tokens").alias("token"))
    digits = F.count_if(F.col("token").rlike("[0-9]"))
    shared = one.join(pages, ["document_id", "token"]).groupBy(id_col, "document_id", "page_number").agg(F.count("*").alias("shared"), digits.alias("digits"))
    short = left.where(F.size("tokens") < 3).select(id_col, "document_id").join(right.select("document_id", "page_number"), "document_id")
    return shared.unionByName(short.select(id_col, "document_id", "page_number", F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("digits"))).groupBy(id_col, "document_id", "page_number").agg(F.max("shared").alias("shared"), F.max("digits").alias("digits"))


def align_pages(chunks: DataFrame, pages: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(chunk_id, page_number, score, shared): the page of its document that a chunk fits best.

    Three points a shared token, 1200 if the page has the whole chunk, 700 if the chunk has the
    page, 120 if the page has the section title, else eight a token of it, six a shared number. Ties
    go to the first page; no shared token and under 100 points is no match.
    """
    plain = lambda c: F.lower(t.collapse(t.text(c)))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(t.TOKEN), F.lit(0)))
    left = chunks.select(id_col, "document_id", plain("text").alias("c_text"), plain("section_hint").alias("section")).withColumn("tokens", words(F.col("c_text"))).where(F.size("tokens") > 0)
    right = pages.select("document_id", "page_number", plain("text").alias("p_text")).withColumn("page_tokens", words(F.col("p_text"))).where(F.size("page_tokens") > 0)
    pairs = _candidates(left, right, id_col).join(left, [id_col, "document_id"]).join(right, ["document_id", "page_number"])
    whole = F.when(F.col("p_text").contains(F.col("c_text")), 1200.0).when(F.col("c_text").contains(F.col("p_text")), 700.0).otherwise(0.0)
    section = F.when(F.col("section") == "", 0.0).when(F.col("p_text").contains(F.col("section")), 120.0).otherwise(F.size(F.array_intersect(words(F.col("section")), F.col("page_tokens"))) * 8.0)
    rows = pairs.withColumn("score", F.col("shared") * 3.0 + whole + section + F.col("digits") * 6.0)
    best = rows.groupBy(id_col).agg(F.max_by(F.struct("page_number", "score", "shared"), F.struct("score", -F.col("page_number"))).alias("x")).select(id_col, "x.*")
    return best.where((F.col("score") > 0) & ((F.col("shared") > 0) | (F.col("score") >= 100)))


def lookup_pages(quotes: DataFrame, texts: DataFrame, id_col: str = "quote_id") -> DataFrame:
    """(quote_id, page_number, score): the page that a quote (document_id, quote) is from.

    texts: (document_id, kind, page_number, text), kind element, markdown or chunk; chunks only
    count where the others reach less than 800 points. Ties go to elements, then to the first page.
    """
    left = quotes.select(id_col, "document_id", t.quoted(t.text("quote")).alias("quote")).withColumn("q_tokens", t.search_tokens(F.col("quote"))).where(F.size("q_tokens") > 0)
    right = texts.select("document_id", "kind", "page_number", t.quoted(t.text("text")).alias("text")).where("text <> ''").withColumn("t_tokens", t.search_tokens(F.col("text")))
    weight = lambda i: F.element_at(F.create_map(*[x for k, w in LOOKUP_WEIGHTS.items() for x in (F.lit(k), F.lit(w[i]))]), F.col("kind"))
    inside = F.when(F.col("text").contains(F.col("quote")), weight(0)).when(F.col("quote").contains(F.col("text")), weight(1)).otherwise(0.0)
    rows = left.join(right, "document_id").withColumn("score", inside + F.size(F.array_intersect("q_tokens", "t_tokens")) * weight(3)).where("score > 0")
    order = F.struct("score", F.when(F.col("kind") == "element", 2).when(F.col("kind") == "markdown", 1).otherwise(0), -F.col("page_number"))
    pick = lambda cond: F.max_by(F.struct("page_number", "score"), F.when(cond, order))
    best = rows.groupBy(id_col).agg(pick(F.col("kind") != "chunk").alias("a"), pick(F.lit(True)).alias("b"))
    found = F.when(F.coalesce(F.col("a.score"), F.lit(0.0)) >= ENOUGH, F.col("a")).otherwise(F.col("b"))
    return best.select(id_col, found["page_number"].alias("page_number"), found["score"].alias("score"))


def overlap_score(candidate: Column, target: Column) -> Column:
    """How well two texts fit: 20000 if equal, 12000 or 10000 less the difference in length if one
    is in the other, else 12 or 4 points a shared word less a twentieth of the difference."""
    a, b = t.matchable(candidate), t.matchable(target)
    gap = F.abs(F.length(a) - F.length(b))
    have = F.split(a, " ")
    words = F.aggregate(F.filter(F.split(b, " "), lambda x: (x != "") & F.array_contains(have, x)), F.lit(0.0), lambda s, x: s + F.when(F.length(x) > 2, 12.0).otherwise(4.0))
    return F.when((a == "") | (b == ""), -1.0).when(a == b, 20000.0).when(b.contains(a), 12000.0 - gap).when(a.contains(b), 10000.0 - gap).otherwise(words - gap * 0.05)


def source_candidate(catalog: DataFrame, query: str, margin: int = 3) -> DataFrame:
    """The document that a question names: 100 points if the whole name is in it, and its length for
    each word of the name; it must lead by `margin`."""
    stem = F.lower(t.collapse(F.regexp_replace(t.text("source_name"), r"(?<=.)\.[^.]*$", "")))
    q = F.lower(t.collapse(F.lit(query)))
    words = F.filter(F.split(stem, r"[\s_\-()]+"), lambda x: (F.length(x) >= 2) & q.contains(x))
    points = F.aggregate(words, F.lit(0), lambda s, x: s + F.length(x)) + F.when((stem != "") & q.contains(stem), 100).otherwise(0)
    # The two best rows.
    top = catalog.withColumn("score", points).where("score > 0").orderBy(F.desc("score"), "document_id").limit(2)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "document_id")
    top = top.withColumn("__next", F.lead("score", 1, 0).over(order)).withColumn("__n", F.row_number().over(order))
    return top.where((F.col("__n") == 1) & (F.col("score") >= F.col("__next") + margin)).drop("__n", "__next")


def lane_quota(scored_rows: DataFrame, group_col: str, lane_col: str, score_col: str, quotas: dict[str, int], k: int, id_col: str) -> DataFrame:
    """k rows per group: first the quota of each lane by score, filled up with the best of the rest,
    ranked by score."""
    by_lane = Window.partitionBy(group_col, lane_col).orderBy(F.desc(score_col), id_col)
    most = reduce(lambda e, x: F.when(F.col(lane_col) == x[0], x[1]).otherwise(e), quotas.items(), F.lit(0))
    rows = scored_rows.withColumn("__in", F.row_number().over(by_lane) <= most)
    pick = Window.partitionBy(group_col).orderBy(F.desc("__in"), F.desc(score_col), id_col)
    rows = rows.withColumn("__n", F.row_number().over(pick)).where(F.col("__n") <= k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group_col).orderBy(F.desc(score_col), id_col))).drop("__in", "__n")


def select_assets(candidates: DataFrame) -> DataFrame:
    """At most one table and one visual per citation: a table of 12 points (18 if made up) that
    leads by 4 (5), a visual of 9 that leads by 3."""
    order = Window.partitionBy("citation_id", "kind").orderBy(F.desc("score"), "asset_id")
    rows = candidates.withColumn("__n", F.row_number().over(order)).withColumn("__next", F.lead("score").over(order)).where("__n = 1")
    made = F.coalesce(F.col("synthetic"), F.lit(False))
    least = F.when(F.col("kind") == "table", F.when(made, 18.0).otherwise(12.0)).otherwise(9.0)
    lead = F.when(F.col("kind") == "table", F.when(made, 5.0).otherwise(4.0)).otherwise(3.0)
    return rows.where((F.col("score") >= least) & (F.col("__next").isNull() | (F.col("score") - F.col("__next") >= lead))).drop("__n", "__next")


def asset_supports(kind: Column, synthetic: Column, tokens: Column, numbers: Column, periods: Column, asked_numbers: Column, asked_periods: Column) -> Column:
    """Whether an asset that shares so many tokens, numbers and periods speaks for a citation."""
    table = ((numbers > 0) & ((tokens > 0) | (periods > 0))) | ((periods > 0) & (tokens >= 2)) | (tokens >= 3) | ((tokens >= 2) & (asked_numbers == 0) & (asked_periods == 0))
    image = (tokens >= 2) | (((numbers > 0) | (periods > 0)) & (tokens >= 1))
    other = ((numbers > 0) & ((tokens > 0) | (periods > 0))) | ((periods > 0) & (tokens >= 1)) | (tokens >= 2)
    return F.when(synthetic, (numbers > 0) & (tokens + periods >= 2)).when(kind == "image", image).when(kind == "table", table).otherwise(other)
