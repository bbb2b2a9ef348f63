"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over the whole text; there is no user function, no explode
and no shuffle, so a document's cost doesn't depend on any other document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import SPACES, WORD, kept, table

#: Common function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with in is it for on was as by this are from at "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch "
    "le la les de et des est un une que pour dans qui sur pas au par du avec en "
    "el los las y que del se una por con no su al lo como más para"
).split()

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """A document fails if the metric is below `low` or above `high`."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. The first two rules make base_failed, all together the verdict.
BASE_RULES = (Rule("too_short", "n_words", low=50), Rule("repeated_words", "repeat_percent", high=50))
RULES = (
    Rule("short_words", "mean_word_chars", low=2.5),
    Rule("long_words", "mean_word_chars", high=14.0),
    Rule("symbols", "symbols_per_word", high=0.1),
    Rule("shouting", "exclamations_per_word", high=0.3),
    Rule("capitals", "upper_ratio", high=0.5),
    Rule("no_stop_words", "stop_ratio", low=0.03),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
)


def _count(text: str, chars: str) -> Column:
    """How often any of some characters stands in a text."""
    return F.length(text) - F.length(F.translate(F.col(text), chars, ""))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _fails(rule: Rule) -> Column:
    low = F.col(rule.metric) < rule.low if rule.low is not None else F.lit(False)
    return low | (F.col(rule.metric) > rule.high) if rule.high is not None else low


#: The columns made here.
MADE = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_exclamations n_upper n_stop_words repeat_percent mean_word_chars symbols_per_word "
    "exclamations_per_word upper_ratio stop_ratio dup_line_ratio failed_rules base_failed kept"
).split()


def measure(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The metrics of every text. Null and empty texts have no words and all counts zero.

    Words are runs of anything but ASCII white space. Repeated words are the positions that
    three-word windows cover which occur at least twice in the same text: the windows' hashes are
    sorted together with their positions, so a text of n words costs n log n. A kept column named like
    one that is made here or by `verdicts` gives way to it.
    """
    keep = kept(keep, MADE)
    d = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    d = d.withColumn("__w", F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("n_words", F.size("__w").cast("long"))
    d = d.withColumn(
        "__h",
        F.expr("CASE WHEN n_words < 3 THEN array() ELSE transform(sequence(0, CAST(n_words AS INT) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) END"),
    )
    # Only texts with a repeated window pay for the sort. One struct per window: hash, position.
    d = d.withColumn(
        "__s",
        F.expr("CASE WHEN size(array_distinct(__h)) = size(__h) THEN NULL ELSE sort_array(transform(__h, (h, i) -> struct(h, i))) END"),
    )
    d = d.withColumn(
        "__p",
        F.expr("sort_array(transform(filter(__s, (x, i) -> x.h = get(__s, i - 1).h OR x.h = get(__s, i + 1).h), x -> x.i))"),
    )
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    d = d.withColumn("__l", lines)
    return d.select(
        *keep,
        "n_words",
        F.length(F.translate(F.col("__t"), SPACES, "")).cast("long").alias("word_chars"),
        _count("__t", SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr("aggregate(transform(__p, (x, i) -> least(3, coalesce(get(__p, i + 1) - x, 3))), 0L, (a, x) -> a + x)"), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        _count("__t", "!").cast("long").alias("n_exclamations"),
        _count("__t", UPPER).cast("long").alias("n_upper"),
        F.size(F.filter("__w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def verdicts(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measure() with base_failed, kept and the names of the rules that failed, in the table's order.

    Null texts count as empty, fail too_short and aren't kept. Repeated rows are judged one by one.
    """
    d = measure(df, text_col, keep).withColumns(
        {
            "repeat_percent": _ratio(100 * F.col("n_repeat_words"), F.col("n_words")),
            "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
            "symbols_per_word": _ratio(F.col("n_symbols"), F.col("n_words")),
            "exclamations_per_word": _ratio(F.col("n_exclamations"), F.col("n_words")),
            "upper_ratio": _ratio(F.col("n_upper"), F.col("word_chars")),
            "stop_ratio": _ratio(F.col("n_stop_words"), F.col("n_words")),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        }
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in (*BASE_RULES, *rules)]))
    d = d.withColumn("failed_rules", failed)
    return d.withColumn("base_failed", base).withColumn("kept", ~base & (F.size("failed_rules") == 0))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every row of documents."""
    d = verdicts(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    stop = ", ".join("'" + w + "'" for w in STOP_WORDS)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
p AS (SELECT r, count(DISTINCT i + o) AS n FROM h, (VALUES (0), (1), (2)) AS v(o) WHERE c > 1 GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
      length(t) - length(replace(t, '!', '')) AS n_ex, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_up,
      len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop
      FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 2.5 * n_words OR word_chars > 14 * n_words OR n_symbols / n_words > 0.1 OR n_ex / n_words > 0.3
    OR n_up / word_chars > 0.5 OR n_stop / n_words < 0.03 OR n_dup_lines / n_lines > 0.5) AS kept
FROM b"""


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": _oracle()}
