"""Toxic passages by maximum-scoring segments.

Training: log-odds of words, and of the beginnings of words, between the lines of toxic and of
clean documents, each with a Dirichlet prior centred on the next shorter beginning. Scoring: one
linear scan finds all maximal segments of a text; their scores become P-values by extreme-value
statistics (Karlin and Altschul), the P-values of a document are combined by the sum statistic,
and a logistic curve turns them into a probability.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import fold, map_texts, table, written

#: Bound of the labelled sample that the classifier is fitted on, in documents.
SAMPLE = 40_000
#: Letters of the beginnings of words that are features: a choice of the model, whole words are others.
SHORTEST, LONGEST = 2, 8
PRIOR = 10.0
LEAST = 5
DRIFT = 1.5
#: Largest log-odds of one token.
MOST = 7.0
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W_]+")
CACHE = 200_000


@dataclass
class Model:
    """weight: log-odds by word beginning, or by whole word with a closing tab."""

    weight: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    size: float = 1.0
    intercept: float = -2.0
    slope: float = 0.0

    def token(self, word: str) -> float:
        """The weight of the longest known beginning."""
        w = self.weight
        if (x := w.get(f"{word}\t")) is not None:
            return x - DRIFT
        for k in range(min(LONGEST, len(word) - 1), SHORTEST - 1, -1):
            if (x := w.get(word[:k])) is not None:
                return x - DRIFT
        return -DRIFT


class Weights(dict):
    """Weights of the words met so far; it forgets them all when there are too many."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        self[word] = x = self.model.token(word)
        return x


def segments(values) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence, in linear time (Ruzzo, Tompa).

    A candidate is kept with the sums before and up to its end and with a link to the nearest
    earlier candidate whose sum before it is lower.
    """
    import numpy as np

    v = np.asarray(values, np.float64)
    if not len(v):
        return []
    total = np.cumsum(v)
    found: list[list] = []  # first, last, sum before, sum at the end, link
    for i in np.flatnonzero(v > 0).tolist():
        first, left, right = i, float(total[i] - v[i]), float(total[i])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([first, i, left, right, j])
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def evidence(scores: list[float], n: int, model: Model) -> float:
    """-log10 of the P-value of the best r segments together, the best r, in n tokens; 0 if none."""
    best, total = 0.0, 0.0
    base = math.log(max(model.size * max(n, 1), 1e-9))
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += model.rate * s - base
        if total <= 0:
            break
        # Sum statistic of r segments; a factor of two for each further r that was tried.
        log_p = -total + (r - 1) * math.log(max(total, 1.0)) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)
        best = max(best, -log_p / math.log(10))
    return best


def probability(x: float, model: Model) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.intercept + model.slope * math.log1p(x)))))


def _sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(id, t, y) of at most `sample` labelled documents of the training fold, chosen by hash.

    At most `sample` ids and labels are broadcast; of several labels of an id the highest counts, of
    several texts of an id the smallest, so that repeated rows don't widen the sample.
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & (fold(id_col, 4) != 2))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max("toxic").alias("y"))
        .orderBy(F.xxhash64("__id", F.lit(4)), "__id")
        .limit(sample)
    )
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("__id"))
    return written(found.groupBy("id").agg(F.min("t").alias("t"), F.max("y").alias("y")), "sample")


def _counts(sample: DataFrame) -> DataFrame:
    """(f, n0, n1): in how many clean and toxic documents a word, or a word that so begins, is.

    Of equal lines only that of the smallest id counts, and a line that also is in a clean document
    is clean, so copies and boilerplate weigh nothing.
    """
    lines = sample.select("id", F.explode(F.split(F.lower("t"), "\n")).alias("line"), "y").where("line <> ''")
    lines = lines.groupBy(F.xxhash64("line").alias("h")).agg(F.first("line").alias("line"), F.min("y").alias("y"), F.min("id").alias("id"))
    texts = lines.groupBy("id", "y").agg(F.concat_ws("\n", F.collect_list("line")).alias("text"))

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in set(TOKEN.findall(text)):
                    counts.setdefault(w, [0, 0])[y > 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))], names=["w", "n0", "n1"])

    words = texts.select("text", "y").mapInArrow(count, "w string, n0 bigint, n1 bigint").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    words = written(words, "words")
    starts = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.length("w") - 1)), lambda k: F.substring(F.col("w"), F.lit(1), k))
    begun = words.where(F.length("w") > SHORTEST).select(F.explode(starts).alias("f"), "n0", "n1")
    whole = words.select(F.concat("w", F.lit("\t")).alias("f"), "n0", "n1")
    return written(begun.unionByName(whole).groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= LEAST), "features")


def log_odds(features: dict[str, tuple[int, int]], n0: int, n1: int) -> dict[str, float]:
    """Posterior log-odds by feature, against those of all; those near the next shorter one's go.

    The Dirichlet prior of a beginning, or of a whole word, has the rates of the next shorter
    beginning that is known, with weight PRIOR. The same counts as there are no new evidence.
    """
    top = (n1 + 1) / (n0 + n1 + 2)
    odds = lambda q: max(-MOST, min(MOST, math.log(q / (1 - q)) - math.log(top / (1 - top))))
    rate: dict[str, float] = {}
    kept: dict[str, float] = {}
    for f in sorted(features, key=lambda f: (f.endswith("\t"), len(f), f)):
        whole = f.endswith("\t")
        shorter = [f[:k] for k in range(min(LONGEST, len(f) - 1 - whole), SHORTEST - 1, -1)]
        above = next((x for x in shorter if x in rate), None)
        prior = rate[above] if above else top
        a, b = features[f]
        q = prior if above and features[above] == (a, b) else (b + PRIOR * prior) / (a + b + PRIOR)
        if not whole:
            rate[f] = q
        if abs(odds(q) - next((kept[x] for x in shorter if x in kept), 0.0)) > 0.3:
            kept[f] = odds(q)
    return kept


def _scan(df: DataFrame, model: Model, text_col: str, keep: tuple[str, ...], schema: str, columns) -> DataFrame:
    def worker():
        weights = Weights(model)

        def apply(texts: list) -> dict:
            found = []
            for text in texts:
                tokens = TOKEN.findall((text or "").lower())
                values = list(map(weights.__getitem__, tokens))
                found.append((len(tokens), values, segments(values)))
            return columns(found)

        return apply

    return map_texts(df, text_col, worker, schema, keep)


def _logistic(points: list[tuple[float, int]]) -> tuple[float, float]:
    """Intercept and slope of P(toxic) over log1p(evidence): Newton's method with a small ridge."""
    import numpy as np

    if not points:
        return -2.0, 1.0
    x = np.column_stack([np.ones(len(points)), np.log1p([p for p, _ in points])])
    y = np.array([t > 0 for _, t in points], float)
    beta, ridge = np.zeros(2), np.diag([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
    return float(beta[0]), max(0.0, float(beta[1]))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on a hash sample of at most `sample` labelled documents whose crc32(id) mod 4 isn't 2.

    Three quarters of the sample give the weights, one quarter the calibration. Without labels the
    model finds nothing. Null labels are none; of several labels of an id the highest counts; null texts
    are empty.
    """
    chosen = _sample(df, labels, id_col, text_col, sample)
    part = F.pmod(F.xxhash64("id", F.lit(44)), F.lit(4))
    features = _counts(chosen.where(part != 0))
    # All features of the sample: they are bounded by it, whatever the corpus holds.
    rows = features.select("f", "n0", "n1").toArrow()
    counted = dict(zip(rows.column("f").to_pylist(), zip(rows.column("n0").to_pylist(), rows.column("n1").to_pylist(), strict=True), strict=True))
    n0, n1 = (sum(c[i] for f, c in counted.items() if f.endswith("\t")) for i in (0, 1))
    model = Model(weight=log_odds(counted, n0, n1))

    def columns(found: list) -> dict:
        import numpy as np
        import pyarrow as pa

        bins = [np.unique(np.round(np.asarray(v) * 4).astype(int), return_counts=True) for _, v, _ in found]
        return {
            "n": pa.array([n for n, _, _ in found], pa.int64()),
            "scores": pa.array([[s for *_, s in seg] for _, _, seg in found], pa.list_(pa.float64())),
            "bins": pa.array([b.tolist() for b, _ in bins], pa.list_(pa.int64())),
            "counts": pa.array([c.tolist() for _, c in bins], pa.list_(pa.int64())),
        }

    held = written(_scan(chosen.where(part == 0), model, "t", ("y",), "n bigint, scores array<double>, bins array<bigint>, counts array<bigint>", columns), "calibration")
    tokens = held.where("y = 0").select(F.explode(F.arrays_zip("bins", "counts")).alias("x")).groupBy("x.bins").agg(F.sum("x.counts").alias("n")).collect()
    model.rate = _rate({r.bins / 4: r.n for r in tokens})
    most = F.coalesce(F.array_max("scores"), F.lit(0.0))
    count, chance = held.where("y = 0").agg(F.count("*"), F.sum(F.greatest("n", F.lit(1)) * F.exp(most * -model.rate))).first()
    model.size = count / chance if count else 1.0
    points = _evidence(held, model).toArrow()
    model.intercept, model.slope = _logistic(list(zip(points.column("x").to_pylist(), points.column("y").to_pylist(), strict=True)))
    return model


def _evidence(held: DataFrame, model: Model) -> DataFrame:
    """(x, y) of each row of the calibration, a quarter of the sample at most: its evidence and label."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [evidence(s, n, model) for n, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(2)], names=["x", "y"])

    return held.select("n", "scores", F.col("y").cast("double").alias("y")).mapInArrow(run, "x double, y double")


def _rate(counts: dict[float, int]) -> float:
    """The positive solution x of: the mean of exp(x * weight) over clean tokens is 1."""
    total = sum(counts.values())
    if not total or max(counts) <= 0:
        return 1.0
    mean = lambda x: sum(n * math.exp(min(x * s, 500.0)) for s, n in counts.items()) / total
    low, high = 1e-3, 1e-3
    while mean(high) < 1 and high < 20:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return high


def passages(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), p_value: float = 0.05) -> DataFrame:
    """`keep`, score, and passages: the segments with a P-value of at most p_value, as token ranges.

    Tokens are runs of letters and digits. Null and empty texts have no passages and the score of
    no evidence. The score depends on the text only, so repeated rows have equal ones. Texts of any length
    are scanned whole. A kept column named score or passages gives way to that made here; of an
    empty table there are no rows.
    """

    def columns(found: list) -> dict:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        made = []
        for n, _, seg in found:
            least = math.log(max(model.size * max(n, 1), 1e-9) / p_value) / model.rate
            made.append([{"first": a, "last": b, "score": s} for a, b, s in seg if s >= least])
        return {
            "score": pa.array([probability(evidence([s for *_, s in seg], n, model), model) for n, _, seg in found], pa.float64()),
            "passages": pa.array(made, kind),
        }

    return _scan(df, model, text_col, keep, "score double, passages array<struct<first:int,last:int,score:double>>", columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every row of documents, with the number of significant passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return passages(docs, model).select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
