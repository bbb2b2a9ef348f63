"""Supporting tables and pictures of citations: scores with their parts, and the choice."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import text as t
from parchment.operators import layout


def context_points(section: Column, title: Column, cited_page: Column, page: Column, document_level: Column) -> Column:
    """18 points if section and title hold one another, 4 a shared token up to 16, 12 for the cited
    page, less 6 a page of distance up to 24, less 10 for a find elsewhere in the document."""
    s, h = t.quoted(t.text(section)), t.quoted(t.text(title))
    named = (s != "") & (h != "")
    shared = F.least(F.lit(4), F.size(F.array_intersect(t.search_tokens(s), t.search_tokens(h)))) * 4.0
    words = F.when(named, F.when(h.contains(s) | s.contains(h), 18.0).otherwise(0.0) + shared).otherwise(0.0)
    known = (cited_page > 0) & (page > 0)
    near = F.when(known & (cited_page == page), 12.0).when(known, -F.least(F.lit(24.0), F.abs(cited_page - page) * 6.0)).otherwise(0.0)
    away = F.when(F.coalesce(document_level, F.lit(False)) & (cited_page > 0) & (page != cited_page), -10.0).otherwise(0.0)
    return words + near + away


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs of citation and candidate with their points by kind and `score`.

    Needs query, focus (the citation's text), section_hint, cited_page; kind (table, image or
    other), text, title, page, width, height, document_level.
    """
    tokens = lambda c: t.search_tokens(t.text(c))
    both = lambda a, b: F.size(F.array_intersect(a, b))
    body = t.text("text")
    parts = {
        "base_points": F.when(F.col("kind") == "table", 1.0).otherwise(0.5),
        "area_points": F.when(F.col("kind") == "image", layout.image_points(F.col("width"), F.col("height"))).otherwise(0.0),
        "query_points": both(tokens("query"), tokens("text")) * 2.0,
        "focus_points": both(tokens("focus"), tokens("text")) * 7.0,
        "number_points": both(t.numeric_tokens(t.text("focus")), t.numeric_tokens(body)) * 10.0,
        "period_points": both(t.temporal_tokens(t.text("focus")), t.temporal_tokens(body)) * 8.0,
        "table_points": F.when((F.col("kind") == "table") & (body.contains("|") | body.contains("[표:")), 4.0).otherwise(0.0),
        "context_points": context_points(F.col("section_hint"), F.col("title"), F.col("cited_page"), F.col("page"), F.col("document_level")),
    }
    total = sum((F.col(c) for c in parts), F.lit(0.0))
    return pairs.withColumns(parts).withColumn("score", F.round(total, 4))


def chosen(best: DataFrame, prefers_visual: bool = False, prefers_table: bool = False) -> DataFrame:
    """(citation_id, assets): the one or two assets of each citation, best first, of rows that hold
    at most one table and one visual each (citation_id, asset_id, kind, score, synthetic).

    What the question asks for goes first; a visual 8 points ahead or a table 10 points ahead goes
    alone; a table that was made up has a visual of 8 points beside it.
    """
    one = F.struct("asset_id", "score", "synthetic")
    rows = best.groupBy("citation_id").agg(F.max(F.when(F.col("kind") == "table", one)).alias("t"), F.max(F.when(F.col("kind") != "table", one)).alias("v"))
    table, visual, made = F.col("t.score"), F.col("v.score"), F.coalesce(F.col("t.synthetic"), F.lit(False))
    t_only, v_only, both_t, both_v = (F.array(*[F.col(f"{x}.asset_id") for x in order]) for order in ("t", "v", "tv", "vt"))
    pick = F.when(F.col("t").isNull(), v_only).when(F.col("v").isNull(), t_only)
    if prefers_visual:
        pick = pick.otherwise(v_only)
    elif prefers_table:
        pick = pick.when(made & (visual >= F.greatest(F.lit(8.0), table - 6)), both_t).otherwise(t_only)
    else:
        pick = pick.when(visual >= table + 8, v_only).when(table >= visual + 10, F.when(made & (visual >= 8), both_t).otherwise(t_only)).when(made, both_v).otherwise(both_t)
    return rows.select("citation_id", pick.alias("assets"))


def nearest_caption(elements: DataFrame, most: int = 4) -> DataFrame:
    """Tables and images (document_id, page_number, element_order, kind, text) with the caption
    nearest in order on their page, within `most` places; the earlier one on ties."""
    captions = elements.where("kind = 'caption'").select("document_id", "page_number", F.col("element_order").alias("c_order"), F.col("text").alias("caption"))
    gap = F.abs(F.col("element_order") - F.col("c_order"))
    things = elements.where("kind IN ('table', 'image')")
    found = things.join(captions, ["document_id", "page_number"]).where(gap <= most)
    best = found.groupBy("document_id", "page_number", "element_order").agg(F.min_by("caption", F.struct(gap, "c_order")).alias("caption"))
    return things.join(best, ["document_id", "page_number", "element_order"], "left")


def nearest_heading(things: DataFrame, texts: DataFrame, orders: int = 20) -> DataFrame:
    """Boxes (id, element_order, x0, x1, y0) with the heading (h_order, h_text, h_x0, h_x1, h_y1) above
    them: at most 20 places before, 6 into to 90 above, 30 wide in common; 100 less the gap less 6 a place."""
    gap = F.col("y0") - F.col("h_y1")
    behind = F.col("element_order") - F.col("h_order")
    wide = F.least(F.col("x1"), F.col("h_x1")) - F.greatest(F.col("x0"), F.col("h_x0"))
    rows = things.join(texts, ["document_id", "page_number"]).where(behind.between(1, orders) & gap.between(-6, 90) & (wide >= 30))
    return rows.groupBy("document_id", "page_number", "id").agg(F.max_by("h_text", F.struct(100 - gap - 6 * behind, -F.col("h_order"))).alias("heading"))


#: Characters on either side of a term, and how many windows and segments count.
AROUND, MOST_WINDOWS, MOST_SEGMENTS = 120, 4, 4


def windows(text: str, terms: list[str], around: int = AROUND, most: int = MOST_WINDOWS) -> list[str]:
    """Parts of a text around its terms, in the order of the terms, none touching one before."""
    lowered, taken, out = text.lower(), [], []
    for term in terms:
        at = lowered.find(term) if len(term) > 1 else -1
        while at >= 0:
            left, right = max(0, at - around), min(len(text), at + len(term) + around)
            if all(right < a or b < left for a, b in taken):
                taken.append((left, right))
                out += [part] if (part := text[left:right].strip()) else []
                if len(out) >= most:
                    return out
            at = lowered.find(term, at + len(term))
    return out


def focus_text(citations: DataFrame) -> DataFrame:
    """Citations (query, section_hint, highlight, quote, chunk_text) with `focus`: hint, highlight,
    windows around the terms of query and hint, longest first, and the segments that share most with
    them (five a word of the query, six of the hint, three a number of the highlight)."""

    @F.pandas_udf("array<string>")
    def around(text: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([windows(x, list(y)) for x, y in zip(text, terms, strict=True)])

    q, s = t.search_tokens(t.text("query")), t.search_tokens(t.quoted(t.text("section_hint")))
    hint, mark, quote = (t.quoted(t.text(c)) for c in ("section_hint", "highlight", "quote"))
    body = t.quoted(F.concat_ws("\n", quote, t.quoted(t.text("chunk_text"))))
    anchors = t.numeric_tokens(F.when(mark != "", mark).otherwise(quote))
    by_length = F.transform(F.array_sort(F.transform(F.array_union(q, s), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda y: y["x"])
    rows = citations.withColumns({"__q": q, "__s": s, "__a": anchors, "__b": body, "__b2": by_length})
    # Not to be merged into the expressions below, which can't call it.
    rows = rows.withColumn("__w", around.asNondeterministic()("__b", "__b2"))
    both = lambda a, b: F.size(F.array_intersect(a, b))
    points = lambda x: both(F.col("__q"), t.search_tokens(x)) * 5 + both(F.col("__s"), t.search_tokens(x)) * 6 + both(F.col("__a"), t.numeric_tokens(x)) * 3
    parts = F.filter(F.transform(F.split("__b", r"\n+|\s+##\s+", -1), lambda x: t.strip(x)), lambda x: x != "")
    ranked = F.filter(F.transform(parts, lambda x, i: F.struct((-points(x)).alias("p"), i.alias("i"), x.alias("x"))), lambda y: y["p"] < 0)
    best = F.transform(F.slice(F.array_sort(ranked), 1, MOST_SEGMENTS), lambda y: y["x"])
    chosen = F.array_distinct(F.filter(F.concat(F.array(hint, mark), F.col("__w"), best), lambda x: x != ""))
    rows = rows.withColumn("focus", t.quoted(F.array_join(F.when(F.size(chosen) > 0, chosen).otherwise(F.array("__b")), "\n")))
    return rows.drop("__q", "__s", "__a", "__b", "__b2", "__w")
