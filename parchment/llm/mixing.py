"""Mixing sources to target weights by hash-threshold histograms.

Every row has a hash. Words are summed by source and leading hash bits; a cumulative sum over the
buckets of a source finds where its budget ends; only that boundary bucket is divided again by
further bits. The mix is then a filter on the hash: nothing is sorted and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.llm.common import WORD, table, written

#: Weights of the sources in code point order, repeating; the share of all words to take.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
BITS = 12
LEVELS = 4


def words(text: str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(src, source_size, target) from (src, source_size), one row per source.

    A target is the source's weight times one common rate, but at most MAX_EPOCHS times its size;
    the rate is such that the targets share SHARE_PERCENT % of all words. Sharing out the excess
    again and again by weight ends at the same targets. The rate is found over the sources in order
    of size by weight: those before the first one that needn't be capped are capped. This runs over
    one row per source.
    """
    order = Window.orderBy(F.col("src").isNull(), F.col("src").cast("binary"))
    rank = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), rank + 1)
    d = sizes.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * MAX_EPOCHS)
    ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").isNull(), F.col("src").cast("binary"))
    everything = Window.partitionBy()
    d = d.withColumn("total", F.sum("source_size").over(everything) * (SHARE_PERCENT / 100))
    d = d.withColumn("cap_before", F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    d = d.withColumn("w_from", F.sum("w").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("rate", (F.col("total") - F.col("cap_before")) / F.col("w_from"))
    # The first source, in order of cap / w, whose share at its own rate is under its cap sets the rate.
    d = d.withColumn("rate", F.min(F.when(F.col("rate") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "rate"))).over(everything)["rate"])
    target = F.least("cap", F.coalesce(F.col("w") * F.col("rate"), F.col("cap")))
    return d.select("src", "source_size", target.alias("target"))


def _bits(level: int) -> Column:
    """Bits of the hash below the leading level * BITS ones, as a bucket number."""
    return F.shiftrightunsigned(F.shiftleft("h", level * BITS), 64 - BITS)


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(src, cut): a row belongs to the last, partial epoch if its hash, unsigned, is below `cut`.

    rows: (src, h, size); goals: (src, budget). Each level sums the boundary buckets only. After
    LEVELS levels of BITS bits the boundary bucket holds rows of one 48-bit prefix; the one bucket
    left goes in if that brings the sum nearer to the budget.
    """
    state = goals.select("src", F.lit(0).cast("long").alias("prefix"), F.col("budget").cast("double").alias("left"))
    for level in range(LEVELS):
        inside = rows.join(
            state.select(F.col("src").alias("s"), "prefix", "left"),
            F.col("src").eqNullSafe(F.col("s"))
            & (F.lit(True) if level == 0 else F.shiftrightunsigned("h", 64 - level * BITS) == F.col("prefix")),
        )
        sums = inside.groupBy("src", _bits(level).alias("b")).agg(
            F.sum("size").alias("n"), F.first("prefix").alias("prefix"), F.first("left").alias("left")
        )
        up_to = F.sum("n").over(Window.partitionBy("src").orderBy("b"))
        sums = sums.withColumn("before", up_to - F.col("n"))
        edge = sums.where(F.col("before") + F.col("n") > F.col("left"))
        first = F.min_by(F.struct("b", "prefix", "left", "before", "n"), "b")
        state = edge.groupBy("src").agg(first.alias("x")).select(
            "src",
            (F.shiftleft("x.prefix", BITS) + F.col("x.b")).alias("prefix"),
            (F.col("x.left") - F.col("x.before")).alias("left"),
            F.col("x.n").alias("n"),
        )
        state = written(state, f"level{level}")
    # Sources without an edge take every row: they have no cut.
    last = (F.col("left") * 2 >= F.col("n")).cast("long")
    return state.select("src", (F.col("prefix") + last).alias("cut"))


def _hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.xxhash64(text_col), F.col(id_col), F.lit(8))


def mix_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, plan). rows: (id, src, size, h) of every row of df; plan: one row per source.

    The hash is of id and text, so reruns agree and null ids are told apart by their texts; rows
    equal in both go together. Null and empty texts have size 0. A null source is a source, sorted
    last. With no words at all every target is 0.
    """
    rows = written(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("src"),
            words(text_col).alias("size"),
            _hash(id_col, text_col).alias("h"),
        ),
        "sizes",
    )
    goals = written(targets(rows.groupBy("src").agg(F.sum("size").alias("source_size"))), "targets")
    whole = F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)
    budgets = goals.withColumn("budget", F.col("target") - whole * F.col("source_size"))
    cuts = thresholds(rows, budgets).withColumnRenamed("src", "s")
    plan = budgets.join(cuts, F.col("src").eqNullSafe(F.col("s")), "left").select(
        F.col("src").alias("__s"), "source_size", "target", whole.alias("__whole"), F.col("budget").alias("__budget"), F.col("cut").alias("__cut")
    )
    return rows, written(plan, "plan")


def _epochs(h: Column) -> Column:
    """How often a row is taken: once for a whole epoch, and once more below the source's cut."""
    below = (F.shiftrightunsigned(h, 64 - LEVELS * BITS) < F.col("__cut")).cast("int")
    part = F.when(F.col("__budget") <= 0, 0).when(F.col("__cut").isNull(), 1).otherwise(below)
    return F.least(F.lit(MAX_EPOCHS), F.col("__whole") + part).cast("int")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix, with df's columns: a row taken for two epochs is there twice.

    The plan has one row per source, so texts are filtered where they are read.
    """
    _, plan = mix_plan(df, id_col, text_col, source_col)
    plan = plan.select("__s", "__whole", "__budget", "__cut")
    return (
        df.join(plan, F.col(source_col).cast("string").eqNullSafe(F.col("__s")))
        .withColumn("__e", _epochs(_hash(id_col, text_col)))
        .where("__e > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__e"))))
        .select(*df.columns)
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every row of documents, with source and epochs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows, plan = mix_plan(docs)
    taken = F.col("size") * _epochs(F.col("h"))
    return rows.join(plan, F.col("src").eqNullSafe(F.col("__s"))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("src").alias("source")
    )


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
