"""Cross-site line deduplication by distinct-site spread.

One aggregation per line hash merges HyperLogLog sketches of the sites that show the line; lines
whose estimate is near the threshold get an exact distinct count; lines at or over the threshold
are boilerplate and go from all documents but the one where they first stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import SPACES, table, written

MIN_SITES = 10
LG_K = 12


def _lines(df: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One narrow row per line that has a word: document, position, line hash, site hash."""
    return (
        df.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text_col).alias("th"),
            F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit(""))).alias("site"),
            F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"),
        )
        .withColumn("line", F.btrim("line", F.lit(SPACES)))
        .where("line <> ''")
        .select("id", "th", "site", "pos", F.xxhash64("line").alias("h"))
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h, first): hashes of the lines on at least min_sites sites, and where each first stands.

    The estimate decides alone where it is further from the threshold than four standard errors of
    the sketch; nearer ones are counted exactly. A hot line costs one row per task.
    """
    margin = max(1, round(4 * 1.04 / 2 ** (lg_k / 2) * min_sites + 0.5))
    spread = written(
        lines.groupBy("h")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("est"),
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "pos")).alias("first"),
        )
        .where(F.col("est") >= min_sites - margin),
        "spread",
    )
    near = spread.where(F.col("est") <= min_sites + margin)
    exact = (
        lines.join(near.select("h"), "h").select("h", "site").distinct().groupBy("h").count().where(F.col("count") >= min_sites)
    )
    sure = spread.where(F.col("est") > min_sites + margin).select("h", "first")
    return written(sure.unionByName(near.join(exact, "h", "left_semi").select("h", "first")), "boilerplate")


def remove_boilerplate(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    lg_k: int = LG_K,
) -> DataFrame:
    """df with boilerplate lines cut from its texts, and the columns n_lines and n_removed.

    Lines are split at \\n and compared without the ASCII white space around them; lines without a
    word never go. A boilerplate line stays where it first stands: in the smallest id (null last),
    at the smallest position; so a document of which there are copies everywhere stays whole once.
    A null site is a site of its own. Null texts stay null; texts may become empty; all rows stay.
    Rows with equal id and text are treated alike. Columns n_lines and n_removed are replaced if
    df has them; texts of any length are read whole; of an empty table there are no rows.
    """
    base = df.drop("n_lines", "n_removed")
    lines = written(_lines(base, id_col, text_col, site_col), "lines")
    hot = boilerplate(lines, min_sites, lg_k)
    gone = written(
        lines.join(hot, "h")
        .where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("pos") == F.col("first.pos"))))
        .groupBy("id", "th")
        .agg(F.collect_set("pos").alias("__gone")),
        "gone",
    ).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "__gone")
    joined = base.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    kept = F.transform(stay, lambda i: F.get(parts, i))
    return joined.withColumns(
        {
            "n_lines": F.coalesce(F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(SPACES)) != "")), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
            text_col: F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
        }
    ).select(*base.columns, "n_lines", "n_removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of lines, of removed lines, and a digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = remove_boilerplate(docs)
    return out.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.length("text").cast("long").alias("n_chars_left"),
        F.sha2("text", 256).alias("text_sha256"),
    )


ORACLE = f"""
WITH l AS (SELECT doc_id, coalesce('=' || source, '') AS site, unnest(string_split(text, chr(10))) AS raw,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
hot AS (SELECT line, arg_min(pos, (doc_id, pos)) AS fp, min(doc_id) AS fd FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT t.doc_id, t.pos, t.raw, t.line, hot.line IS NOT NULL AND NOT (t.doc_id = fd AND t.pos = fp) AS gone FROM t LEFT JOIN hot USING (line)),
a AS (SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
             coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS txt FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(txt)::BIGINT AS n_chars_left, sha256(txt) AS text_sha256 FROM a"""

QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {"op1_line_dedup": ORACLE}
