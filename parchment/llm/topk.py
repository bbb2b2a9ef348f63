"""Exact top-k inner products over an impact-ordered score-at-a-time index.

Each block of vectors is indexed by quantised impact: a posting says that a vector has a component
of some level and sign in some dimension, and a segment lists the postings of one level, sign and dimension.
A query goes through the segments by descending impact, its own component times the segment's. Bounds on
what is still missing prove which vectors can be among the k best; when few are left, or no segment is, they
are scored exactly, so nothing is approximate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.llm.common import table

K = 5
EVERY = 50
#: Rows of a block of candidates, which one task indexes, and of the queries that it answers.
ROWS = 8_192
QUERIES_PER_BLOCK = 65_536
LEVELS = 32
#: Shares of the postings after which a query looks at what is left, and the share of vectors that is few.
STEPS = (0.35, 0.6, 0.8, 1.0)
FEW = 0.25


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): floor(256 * x) of each component, of the vectors that take part.

    Null ids, null vectors and vectors with null or non-finite components take no part. Components
    must be under 2**31 in amount, so that scores are whole 64-bit numbers.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("v")
    )


class Index:
    """Posting lists of a block: the vectors of each segment, one after another."""

    def __init__(self, vectors) -> None:
        import numpy as np

        n, dimensions = vectors.shape
        self.vectors = vectors
        self.step = max(1, -(-(int(np.abs(vectors).max(initial=0)) + 1) // LEVELS))
        key = ((np.abs(vectors) // self.step * dimensions + np.arange(dimensions)) * 2 + (vectors < 0)).T.ravel()
        order = np.argsort(key, kind="stable")
        self.postings = np.tile(np.arange(n, dtype=np.int32), dimensions)[order]
        key = key[order]
        self.start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.start, len(key)))
        segment = key[self.start]
        level, self.dimension = segment // (2 * dimensions), segment // 2 % dimensions
        self.most = level * self.step + self.step - 1
        self.middle = (1 - 2 * (segment % 2)) * (level * self.step + (self.step - 1) / 2)

    def search(self, query, barred, k: int):
        """The positions that can be among the query's k best, without those in `barred`."""
        import numpy as np

        n, amount = len(self.vectors), np.abs(query).astype(np.float64)
        impact = amount[self.dimension] * self.most
        order = np.argsort(-impact, kind="stable")
        total = np.cumsum(self.size[order])
        weight = query[self.dimension] * self.middle
        score, seen = np.zeros(n), np.zeros(n)
        # Off by half a step where seen; components not seen have at most the next segment's impact.
        half = amount.sum() * ((self.step - 1) / 2 + 1e-9 * self.step * LEVELS)
        possible, done = np.ones(n, bool), 0
        for share in STEPS if n > k else ():
            end = len(order) if share == 1 else int(np.searchsorted(total, share * total[-1])) + 1 if len(order) else 0
            own, done = order[done:end], end
            sizes = self.size[own]
            rows = self.postings[np.repeat(self.start[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            score += np.bincount(rows, np.repeat(weight[own], sizes), n)
            seen += np.bincount(rows, minlength=n)
            slack = half + (len(query) - seen) * (impact[order[end]] if end < len(order) else 0.0)
            low, high = score - slack, score + slack
            low[barred] = high[barred] = -np.inf
            possible = high >= np.partition(low, n - k)[n - k]
            if possible.sum() <= FEW * n:
                break
        possible[barred] = False
        return np.flatnonzero(possible)


def block_top(ids, vectors, query_ids, queries, k: int):
    """(query, candidate, score) arrays: the k best of one block for each query, ties to the smaller id."""
    import numpy as np

    index = Index(vectors)
    order = np.argsort(ids, kind="stable")
    left, right = (np.searchsorted(ids, query_ids, side, sorter=order) for side in ("left", "right"))
    found: list[tuple] = []
    for q, vector, a, b in zip(query_ids, queries, left, right, strict=True):
        rows = index.search(vector, order[a:b], k)
        exact = vectors[rows] @ vector
        best = np.lexsort((ids[rows], -exact))[:k]
        found.append((np.full(len(best), q), ids[rows][best], exact[best]))
    return [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ()))]


def _matrix(columns, dimensions: int):
    import numpy as np

    out = np.zeros((len(columns), dimensions), np.int64)
    for i, v in enumerate(columns):
        out[i, : len(v)] = v
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, rows: int = ROWS, per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner product per query.

    Both have (id, v). Queries meet every block of candidates, whose index is built once for up to
    per_block of them; each sends on k rows a query. A candidate with the query's own id is left out. Shorter
    vectors count as filled up with zeros. Ties go to the smaller id; fewer than k candidates are
    all returned, and none of an empty table. Candidates of one id are ranked one by one, queries of
    one id together.
    """
    import pandas as pd

    blocks, query_blocks = (max(1, -(-df.count() // size)) for df, size in ((candidates, rows), (queries, per_block)))

    def block(n: int, salt: int):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))

    def other(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = candidates.select("id", "v", block(blocks, 6).alias("c")).withColumn("q", other(query_blocks))
    right = queries.select("id", "v", block(query_blocks, 7).alias("q")).withColumn("c", other(blocks))

    def search(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        names = ("query_id", "vec_id", "score")
        if not len(x) or not len(y):
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
        wide = max(map(len, [*x.v, *y.v]))
        found = block_top(x.id.to_numpy(), _matrix(x.v, wide), y.id.to_numpy(), _matrix(y.v, wide), k)
        return pd.DataFrame(dict(zip(names, found, strict=True)))

    best = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every vector whose id is divisible by 50, against all rows."""
    vectors = integers(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("id") % EVERY == 0))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""

QUERIES = {"op6_topk": op6_topk}
ORACLES = {"op6_topk": ORACLE}
