"""Best lines and sentences for a question, key terms, and scores that mix words with vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import text as t
from parchment.operators import embedding, retrieval

#: Tokens of the curated search, particles that it takes off, and words that are no key terms.
TOKEN = embedding.LOCAL_TOKEN
PARTICLES = ("으로는", "에서는", "에게는", "과", "와", "은", "는", "이", "가", "을", "를", "의", "에", "로", "으로", "하고")
NO_TERMS = ("얼마인가", "얼마야", "비교하면", "어떤가", "알려줘")
#: Weights of key terms, shared words, shared numbers, chunk types and pages.
PERIOD_TERM, LONG_TERM, SHORT_TERM = 0.05, 0.42, 0.18
WORD_POINTS, NUMBER_POINTS, RELATION_POINTS, CLEAN_POINTS = 0.035, 0.08, 0.16, 0.04
RIGHT_PAGE, WRONG_PAGE, NO_PAGE = 1.2, -1.0, -0.35
#: Words of table headers that count twice for table questions.
HEADER_WORDS = ("성장률", "비율", "증감", "달성률", "개최일자", "참석인원", "항목", "실적", "계획", "수익률", "per")
#: Between sentences, for highlights.
SENTENCE = "(?<=[.!?。！？])\\s+|\n+"


def tokens(c: Column) -> Column:
    """Lower-case tokens, points and percent signs included, and Korean ones without a particle."""
    basic = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    ends = F.array(*[F.lit(p) for p in PARTICLES])
    cut = F.transform(basic, lambda x: F.get(F.transform(F.filter(ends, lambda p: x.endswith(p) & (F.length(x) > F.length(p) + 1)), lambda p: F.substring(x, F.lit(1), F.length(x) - F.length(p))), 0))
    return F.array_distinct(F.concat(basic, F.filter(cut, lambda x: x.isNotNull())))


def numbers(found: Column) -> Column:
    return F.filter(found, lambda x: x.rlike(r"\d"))


def key_terms(c: Column) -> Column:
    """Tokens of three characters and more that are no plain number and no question word."""
    return F.filter(tokens(c), lambda x: (F.length(x) >= 3) & ~x.isin(*NO_TERMS) & ~x.rlike(r"^\d+(?:\.\d+)?$"))


def term_weight(x: Column) -> Column:
    return F.when(x.rlike(r"(?i)^(?:20\d{2}|[1-4]?q\d{2}|ytd|qoq)$"), PERIOD_TERM).when(F.length(x) >= 4, LONG_TERM).otherwise(SHORT_TERM)


def page_points(chunk_page: Column, body: Column, asked: Column) -> Column:
    """1.2 if the chunk or a page heading in it is of a page that is asked for, -1 if of others,
    -0.35 if it names none; 0 if no page is asked for."""
    named = F.transform(F.regexp_extract_all(body, F.lit(r"(?i)#\s*Page\s+(\d+)\b"), F.lit(1)), lambda x: x.cast("int"))
    have = F.concat(named, F.array_compact(F.array(chunk_page.cast("int"))))
    return F.when(F.size(asked) == 0, 0.0).when(F.arrays_overlap(have, asked), RIGHT_PAGE).when(F.size(have) > 0, WRONG_PAGE).otherwise(NO_PAGE)


def curated_scores(chunks: DataFrame, query: str, id_cols: tuple[str, ...] = ("document_id", "chunk_index"), dimensions: int = embedding.LOCAL_DIMENSIONS, hybrid: bool = False) -> DataFrame:
    """Chunks (…, text, page_number, chunk_type) with vector_score, word and number overlaps,
    key_score, type and page points, and their sum `score` (6 decimals)."""
    key = F.struct(*id_cols)
    vectors = embedding.sparse_vectors(chunks.withColumn("__k", key), "__k", "text", dimensions)
    near = embedding.scores_to_one(vectors, query, dimensions).select(F.col("id").alias("__k"), F.col("score").alias("vector_score"))
    q = F.lit(query)
    one = chunks.sparkSession.range(1).select(tokens(q).alias("__q"), key_terms(q).alias("__t"), t.requested_pages(q).alias("__p"))
    body = t.text("text")
    flat = F.regexp_replace(F.lower(body), r"(?U)\s+", "")
    rows = chunks.withColumn("__k", key).join(near, "__k", "left").join(F.broadcast(one)).withColumn("__b", tokens(body))
    terms = F.aggregate(F.filter("__t", lambda x: flat.contains(x)), F.lit(0.0), lambda s, x: s + term_weight(x))
    kind = F.when(F.col("chunk_type") == "structured_relation", RELATION_POINTS).when(F.lit(hybrid) & (F.col("chunk_type") == "clean_text"), CLEAN_POINTS).otherwise(0.0)
    rows = rows.withColumns(
        {
            "vector_score": F.coalesce("vector_score", F.lit(0.0)),
            "word_overlap": F.size(F.array_intersect("__q", "__b")),
            "number_overlap": F.size(F.array_intersect(numbers(F.col("__q")), numbers(F.col("__b")))),
            "key_score": terms,
            "type_points": kind,
            "page_points": page_points(F.col("page_number"), body, F.col("__p")),
        }
    )
    total = F.col("vector_score") + F.col("word_overlap") * WORD_POINTS + F.col("number_overlap") * NUMBER_POINTS + F.col("key_score") + F.col("type_points") + F.col("page_points")
    return rows.withColumn("score", F.round(total, 6)).drop("__k", "__q", "__t", "__p", "__b")


def plain_scores(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks with the score of the diagnostics: shared words (source six times, section three
    times), eight a number, six a period, and for table questions 12 for a table and header words."""
    q = F.lit(query)
    one = chunks.sparkSession.range(1).select(t.search_tokens(q).alias("__q"), t.numeric_tokens(q).alias("__n"), t.temporal_tokens(q).alias("__t"), retrieval.any_of(F.lower(q), retrieval.TABLE_PHRASES).alias("__table"))
    both = lambda a, b: F.size(F.array_intersect(a, b))
    body, section = t.search_tokens(t.text("text")), t.search_tokens(t.text("section_hint"))
    heads = F.filter("__q", lambda x: x.isin(*HEADER_WORDS))
    table = F.when(retrieval.has_table(t.text("text")), 12.0).otherwise(0.0) + both(heads, section) * 6.0 + both(heads, body) * 8.0
    words = both("__q", body) + both("__q", section) * 3 + both("__q", t.search_tokens(t.text("source_name"))) * 6
    exact = both("__n", t.numeric_tokens(t.text("text"))) * 8 + both("__t", t.temporal_tokens(t.text("text"))) * 6
    rows = chunks.join(F.broadcast(one)).withColumn("score", words + exact + F.when(F.col("__table"), table).otherwise(0.0))
    return rows.drop("__q", "__n", "__t", "__table")


def best_line(question: Column, c: Column) -> Column:
    """The line with most in common with a question: two a word, three a number, one for a bar; the
    first of equals, '' if there is none."""
    lines = F.filter(F.transform(t.lines(c), t.strip), lambda x: (x != "") & ~x.startswith("|---"))
    asked = tokens(question)

    def points(x: Column) -> Column:
        own = tokens(x)
        return F.size(F.array_intersect(asked, own)) * 2 + F.size(F.array_intersect(numbers(asked), numbers(own))) * 3 + F.when(x.contains("|"), 1).otherwise(0)

    ranked = F.transform(lines, lambda x, i: F.struct(points(x).alias("p"), (-i).alias("i"), x.alias("x")))
    return F.coalesce(F.array_max(ranked)["x"], F.lit(""))


def best_sentence(question: Column, c: Column) -> Column:
    """The sentence that shares most words with a question, the longest of equals."""
    parts = F.filter(F.transform(F.split(t.quoted(c), SENTENCE, -1), t.strip), lambda x: x != "")
    asked = t.search_tokens(question)
    ranked = F.transform(parts, lambda x, i: F.struct(F.size(F.array_intersect(asked, t.search_tokens(x))).alias("p"), F.length(x).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.coalesce(F.array_max(ranked)["x"], t.quoted(c))


def page_by_words(chunks: DataFrame, pages: DataFrame, id_col: str = "chunk_id", least: int = 4) -> DataFrame:
    """(chunk_id, page_number, shared): the page of its document that shares most tokens of three
    characters and more with a chunk, four at least; the first page on ties."""
    words = lambda c: F.filter(tokens(t.text(c)), lambda x: F.length(x) >= 3)
    left = chunks.select(id_col, "document_id", F.explode(words("text")).alias("w"))
    right = pages.select("document_id", "page_number", F.explode(words("text")).alias("w"))
    shared = left.join(right, ["document_id", "w"]).groupBy(id_col, "page_number").agg(F.count("*").alias("shared"))
    best = shared.groupBy(id_col).agg(F.max(F.struct("shared", F.negate("page_number").alias("p"))).alias("x"))
    return best.where(F.col("x.shared") >= least).select(id_col, F.negate("x.p").alias("page_number"), "x.shared")


def merged_rows(first: Column, second: Column) -> Column:
    """Rows of one reading of a table with empty cells filled from another reading of it."""
    wide = F.array_max(F.transform(first, lambda r: F.size(r)))
    return F.transform(first, lambda r, i: F.transform(F.sequence(F.lit(0), wide - 1), lambda j: F.when(F.trim(F.coalesce(F.get(r, j), F.lit(""))) != "", F.get(r, j)).otherwise(F.trim(F.coalesce(F.get(F.get(second, i), j), F.lit(""))))))
