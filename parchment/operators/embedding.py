"""Deterministic feature-hash embeddings and cosine search, all in the JVM.

A vector is kept sparse, as (bucket, weight) pairs: a token's SHA-256 gives its bucket, sign and
weight. Dense arrays are only made for storage.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions import text as t

#: Dimensions and tokens of the stored vectors, and of the local ones of the curated search.
DIMENSIONS, LOCAL_DIMENSIONS = 128, 256
LOCAL_TOKEN = r"[0-9A-Za-z가-힣.%]+"


def token_buckets(tokens: Column, dimensions: int = DIMENSIONS) -> Column:
    """array<struct<bucket, weight>>, one for each token, with repeats.

    Bucket: the digest's first four bytes modulo dimensions; sign: the parity of the fifth byte;
    weight: one plus the sixth byte over 255.
    """

    def one(token: Column) -> Column:
        digest = F.sha2(token, 256)
        number = lambda start, n: F.conv(F.substring(digest, start, n), 16, 10).cast("long")
        sign = F.when(number(9, 2) % 2 == 0, 1.0).otherwise(-1.0)
        return F.struct((number(1, 8) % dimensions).cast("int").alias("bucket"), (sign * (1 + number(11, 2) / 255.0)).alias("weight"))

    return F.transform(tokens, one)


def token_pattern(dimensions: int) -> str:
    """The tokens of vectors of so many dimensions: local ones keep points and percent signs."""
    return LOCAL_TOKEN if dimensions == LOCAL_DIMENSIONS else t.TOKEN


def sparse_vectors(df: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, bucket, weight), summed per bucket; texts without tokens have no rows."""
    tokens = F.regexp_extract_all(F.lower(t.text(text_col)), F.lit(token_pattern(dimensions)), F.lit(0))
    rows = df.select(F.col(id_col).alias("id"), F.explode(tokens).alias("token")).groupBy("id", "token").count()
    one = token_buckets(F.array("token"), dimensions)[0]
    return rows.withColumn("x", one).groupBy("id", F.col("x.bucket").alias("bucket")).agg(F.sum(F.col("x.weight") * F.col("count")).alias("weight"))


def unit_vectors(df: DataFrame, id_col: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, embedding array<float>) of length one; texts without tokens have the zero vector."""
    sums = sparse_vectors(df, id_col, text_col, dimensions).groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")
    )
    at = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(at(i), F.lit(0.0)).cast("float"))
    ids = df.select(F.col(id_col).alias("id")).distinct()
    return ids.join(sums, "id", "left").select("id", dense.alias("embedding"))


def cosine_scores(docs: DataFrame, queries: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, score) of all documents that share a bucket with a query.

    Both are sparse vectors. The query side has at most `dimensions` rows a query and is joined by
    bucket (and by `on`, columns of documents too); dot products and norms come from one aggregation.
    """
    norms = (docs.dropDuplicates(["id", "bucket"]) if on else docs).groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    q = queries.select(F.col("id").alias("query_id"), "bucket", F.col("weight").alias("w"))
    q_norms = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("q_norm"))
    dots = docs.join(q, ["bucket", *on]).groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    scored = dots.join(norms, "id").join(q_norms, "query_id")
    return scored.select("query_id", "id", F.when((F.col("norm") > 0) & (F.col("q_norm") > 0), F.col("dot") / (F.col("norm") * F.col("q_norm"))).otherwise(0.0).alias("score"))


#: Fixed values of the search for what is as near as a target: directions, width of a cell in radians, the widest angle
#: looked up by cells, and what rounding to six decimals takes from a cosine.
DIRECTIONS, CELL, WIDEST, ROUNDED = 3, 0.004, 0.008, 6e-7


def _placed(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(id, norm, dense, a0, a1, ...): vectors with their angles to fixed directions."""
    import random

    rng = random.Random(7)
    w, sums = F.col("weight"), []
    for _ in range(DIRECTIONS):
        way = [rng.gauss(0, 1) for _ in range(dimensions)]
        length = sum(x * x for x in way) ** 0.5
        sums.append(F.sum(w * F.get(F.array(*[F.lit(x / length) for x in way]), F.col("bucket"))))
    rows = vectors.groupBy("id").agg(F.sqrt(F.sum(w * w)).alias("norm"), F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"), *[x.alias(f"a{i}") for i, x in enumerate(sums)])
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    angle = lambda i: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(f"a{i}") / F.col("norm"))))
    return rows.where("norm > 0").select("id", "norm", dense.alias("dense"), *[angle(i).alias(f"a{i}") for i in range(DIRECTIONS)])


def rivals(docs: DataFrame, queries: DataFrame, targets: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(query_id, id, score): of cosine_scores at least the rows whose score, to six decimals, is that of the query's target
    or more; all that a rank of the target needs.

    targets: query_id, id of the vectors that belong to a query's target. Two vectors' angles to a third differ by no
    more than the angle between them, so what is as near as the target is in the cells around the query's own, and only these
    meet. Queries whose targets aren't so near meet all vectors.
    """
    d, q = _placed(docs, dimensions), _placed(queries, dimensions).withColumnRenamed("id", "query_id")
    own = cosine_scores(docs.join(targets, "id"), queries, ("query_id",))
    best = own.groupBy("query_id").agg(F.acos(F.greatest(F.lit(-1.0), F.round(F.max("score"), 6) - ROUNDED)).alias("wide"))
    asked = q.join(best, "query_id", "left").withColumn("near", F.coalesce(F.col("wide") <= WIDEST, F.lit(False)))
    cell = lambda x: F.floor(x / CELL).cast("int")
    cells = [f"c{i}" for i in range(DIRECTIONS)]
    left = asked.where("near").select("query_id", F.col("norm").alias("q_norm"), F.col("dense").alias("q"), "wide", *[f"a{i}" for i in range(DIRECTIONS)])
    for i, c in enumerate(cells):
        low, high = cell(F.col(f"a{i}") - F.col("wide") - 1e-6), cell(F.col(f"a{i}") + F.col("wide") + 1e-6)
        left = left.withColumn(c, F.explode(F.sequence(low, high)))
    right = d.select("id", "norm", "dense", *[cell(F.col(f"a{i}")).alias(c) for i, c in enumerate(cells)])
    dot = F.aggregate(F.zip_with("dense", "q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    met = left.join(right, cells).select("query_id", "id", (dot / (F.col("norm") * F.col("q_norm"))).alias("score"))
    known = asked.where("near").select(F.col("query_id").alias("id"))
    return met.unionByName(cosine_scores(docs, queries.join(known, "id", "left_anti")))


def scores_to_one(docs: DataFrame, query: str, dimensions: int = DIMENSIONS, id_col: str = "id") -> DataFrame:
    """(id, score) of one query: dot product and norm from one pass over the sparse vectors."""
    spark = docs.sparkSession
    q = sparse_vectors(spark.createDataFrame([(0, query)], "id int, t string"), "id", "t", dimensions).select("bucket", F.col("weight").alias("w"))
    norm = q.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("q_norm"))
    # At most `dimensions` rows.
    joined = docs.join(F.broadcast(q), "bucket", "left").groupBy(id_col).agg(
        F.sum(F.col("weight") * F.coalesce("w", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")
    )
    return joined.join(F.broadcast(norm)).select(id_col, F.when((F.col("norm") > 0) & (F.col("q_norm") > 0), F.col("dot") / (F.col("norm") * F.col("q_norm"))).otherwise(0.0).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; 0 for empty vectors and zero norms."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return F.when(norms > 0, product(a, b) / norms).otherwise(0.0)


def over_fetch(k: int) -> int:
    """How many hits a search fetches before it ranks them anew."""
    return max(k, min(8 * k, 40))


def batches(df: DataFrame, order_col: str, text_col: str, limit: int = 6000, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """df with batch: texts in order, greedily filled up to `limit` characters within each group.

    A group is one document's chunks; only their sizes go to a worker, which reads them once.
    """
    @F.pandas_udf("array<int>")
    def filled(sizes: pd.Series) -> pd.Series:
        def one(own) -> list[int]:
            numbers, room, number = [], 0, 0
            for n in own:
                if room and room + n > limit:
                    room, number = 0, number + 1
                room += n
                numbers.append(number)
            return numbers

        return sizes.map(one)

    sized = df.withColumn("__size", F.greatest(F.length(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1)))
    packed = sized.groupBy(*group_cols).agg(F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col("__size").alias("n")))).alias("a"))
    packed = packed.withColumn("b", filled(F.transform("a", lambda x: x["n"])))
    rows = F.transform("a", lambda x, i: F.struct(x["o"].alias(order_col), F.get("b", i).alias("batch")))
    return packed.select(*group_cols, F.explode(rows).alias("x")).select(*group_cols, "x.*")


def hit_rates(ranked: DataFrame, query_col: str = "query_id", target_col: str = "target", doc_col: str = "doc", score_col: str = "score") -> DataFrame:
    """hit_at_1, hit_at_3 and mrr (4 decimals) over all queries; ties go to the smaller document."""
    order = Window.partitionBy(query_col).orderBy(F.desc(score_col), doc_col)
    placed = ranked.withColumn("rank", F.row_number().over(order)).groupBy(query_col).agg(F.min(F.when(F.col(doc_col) == F.col(target_col), F.col("rank"))).alias("rank"))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return placed.agg(
        F.count("*").alias("n_queries"),
        mean(F.coalesce((F.col("rank") == 1).cast("double"), F.lit(0.0))).alias("hit_at_1"),
        mean(F.coalesce((F.col("rank") <= 3).cast("double"), F.lit(0.0))).alias("hit_at_3"),
        mean(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )
