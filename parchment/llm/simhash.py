"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, components.

Two 64-bit fingerprints that differ in at most d bits agree on at least B - d of any B blocks. So
each distinct fingerprint is filed under its bits in every choice of B - d blocks; pairs are only
looked for within a bucket, where a search from fingerprint to fingerprint yields a spanning star
for each linked set instead of all pairs. Buckets too large for that are linked over midpoints.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import map_texts, table, written

WIDTH = 4
MAX_DISTANCE = 4
#: For groups of near copies: words of a shingle, Jaccard similarity, hash bands and their rows.
NEAR_WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Largest bucket that one task searches: 256 KB of fingerprints.
BUCKET = 1 << 15
#: A key that more than one row in so many has is hot.
HOT = 1 << 10
#: Members of a bucket whose shingle sets are compared in one task; larger buckets go block by block.
BLOCK = 1 << 10


def shingle_hashes(text: str | None, width: int):
    """XXH64 (seed 42) of the text's word shingles, in order, as uint64."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(width, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - k + 1)


def fingerprint(hashes) -> int:
    """A bit is 1 if it is set in over half the hashes; of no hashes, zero. Unsigned."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[i : i + (1 << 14)]).view(np.uint8)
        counts += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH) -> DataFrame:
    """`keep` and fp, the fingerprint as a signed long. Null and empty texts: zero."""

    def worker():
        import numpy as np
        import pyarrow as pa

        def apply(texts: list) -> dict:
            made = np.array([fingerprint(shingle_hashes(t, width)) for t in texts], np.uint64)
            return {"fp": pa.array(made.view(np.int64))}

        return apply

    return map_texts(df, text_col, worker, "fp bigint", keep)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks(distance: int, blocks: int) -> list[int]:
    """A mask for each choice of blocks - distance blocks out of `blocks`."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks - distance)]


def _blocks(count: int, distance: int) -> int:
    """Few blocks, but enough that a bucket's key has two bits less than the count at most."""
    blocks = distance + 2
    while 64 * (blocks - distance) // blocks + 2 < max(count, 1).bit_length() and blocks < 2 * distance + 2:
        blocks += 1
    return blocks


def _search(members, distance: int):
    """(member, smallest member of its linked set) within one bucket, for all but the smallest."""
    import numpy as np

    rest, found = np.unique(members), []
    while len(rest):
        group, queue, rest = [rest[0]], [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                hit = rest[near].tolist()
                group += hit
                queue += hit
                rest = rest[~near]
        found += [(y, group[0]) for y in group[1:]]
    return found


def _shuffled(rows: DataFrame, values: DataFrame, *keys: str) -> DataFrame:
    """rows with the columns of values, both shuffled. For rows that explode makes: Spark takes them for as few as
    the rows they are made of, and would broadcast all of them over the driver."""
    return rows.join(values.hint("merge"), list(keys))


def links(distinct: DataFrame, distance: int = MAX_DISTANCE, blocks: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a > b: edges whose components are those of all pairs of fp within `distance` bits."""
    blocks = blocks or _blocks(distinct.count(), distance)
    filed = distinct.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks(distance, blocks))])).alias("x"),
    ).select("fp", "x.c", "x.key")
    sizes = filed.groupBy("c", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    sizes = written(sizes, "buckets")
    pairs = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= distance)).select(F.col("hi").alias("a"), F.col("lo").alias("b"))

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for value in batch.column(0):
                found += _search(value.values.to_numpy(), distance)
                if len(found) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
                    found = []
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    several = sizes.where((F.col("n") > 2) & (F.col("n") <= bucket)).select("c", "key")
    grouped = _shuffled(filed, several, "c", "key").groupBy("c", "key").agg(F.collect_list("fp").alias("fps"))
    searched = grouped.select("fps").mapInArrow(search, "a bigint, b bigint")
    found, large = pairs.unionByName(searched), sizes.where(F.col("n") > bucket)
    if not large.isEmpty():
        found = found.unionByName(_over_midpoints(filed, large, distance))
    return found.distinct()


def _over_midpoints(filed: DataFrame, large: DataFrame, distance: int) -> DataFrame:
    """Edges in buckets of any size, in proportion to their rows: two fingerprints are within
    `distance` bits just if some word is within the halves of it from either; each such word
    links those that it is near to the smallest of them."""
    from math import comb

    near, far = distance // 2, distance - distance // 2
    flips = [0]
    for k in range(1, far + 1):
        flips += [_signed(sum(1 << i for i in c)) for c in combinations(range(64), k)]
    inner = sum(comb(64, k) for k in range(near + 1))
    words = F.posexplode(F.array(*[F.lit(f) for f in flips])).alias("i", "flip")
    rows = _shuffled(filed, large.select("c", "key"), "c", "key").select("fp").distinct()
    rows = rows.select("fp", words).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), (F.col("i") < inner).alias("inner"))
    root = rows.where("inner").groupBy("mid").agg(F.min("fp").alias("root"))
    met = _shuffled(rows, root, "mid").where("fp <> root")
    # Those near a word meet its root within 2 * near <= distance, those far from it within near + far.
    return met.select(F.greatest("fp", "root").alias("a"), F.least("fp", "root").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b): every node that isn't the smallest of its component, and that smallest node.

    Alternating large-star and small-star rounds, each written to the shared folder; no node needs
    its neighbours in one place, and the rounds grow with the logarithm of the nodes.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = written(edges, "edges")
    before = mark(e)
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        if (now := mark(e)) == before:
            return e
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def by_hot_key(rows: DataFrame, values: DataFrame, key: str, count: str = "n") -> DataFrame:
    """rows with the columns of values (key unique; count: how many rows have it, which is left out).

    Keys that more than one in HOT rows has, fewer than HOT of them, are broadcast, so that no task gets all
    rows of one; the others are joined by key.
    """
    total = values.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = values.where(F.col(count) * HOT > total).drop(count)
    rest = values.where(F.col(count) * HOT <= total).drop(count)
    spread = rows.join(F.broadcast(hot), key)
    return spread.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def clusters(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, distance: int = MAX_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row of df, and of every distinct fp its root, the smallest fp of its component, with
    the smallest id and the number of rows.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and
    copies share a fingerprint and are only told apart at the end.
    """
    rows = written(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__t")), "__t", ("id",), width), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), distance)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return rows, distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, fp, component): the component of a row is the smallest id reachable, itself included.

    Null ids are reported as they are and never name a component that has others. Other columns, whatever
    their names, play no part; of an empty table there are no rows.
    """
    rows, distinct = clusters(df, id_col, text_col, width, distance)
    distinct = written(distinct, "clusters")
    names = written(distinct.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("__n")), "names")
    named = written(by_hot_key(distinct.select("fp", "root", "n"), names, "root", "__n").select("fp", "component", "n"), "named")
    return by_hot_key(rows, named, "fp").select("id", "fp", "component")


def folded(hashes):
    """The distinct ones of some hashes, folded to 32 bits."""
    import numpy as np

    return np.unique((hashes ^ (hashes >> np.uint64(32))).astype(np.uint32).view(np.int32))


def signatures(df: DataFrame, text_col: str, keep: tuple[str, ...], width: int) -> DataFrame:
    """`keep`, fp, bands and size: BANDS keys, each of the smallest values of ROWS hash functions over
    the shingles, and how many distinct ones there are; texts without words share one key."""

    def worker():
        import numpy as np
        import pyarrow as pa

        draw = np.random.default_rng(42)
        factor, shift = (draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) for _ in range(2))
        factor = factor * np.uint64(2) + np.uint64(1)
        mix = draw.integers(0, 1 << 63, (ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)

        def keys(hashes) -> list[int]:
            if not len(hashes):
                return [0]
            least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
            for i in range(0, len(hashes), 1024):
                part = hashes[i : i + 1024, None] ^ (hashes[i : i + 1024, None] >> np.uint64(29))
                least = np.minimum(least, (part * factor + shift).min(axis=0))
            spread = (least.reshape(BANDS, ROWS) >> np.uint64(3)) * mix.T
            return np.bitwise_xor.reduce(spread ^ (spread >> np.uint64(31)), axis=1).view(np.int64).tolist()

        def apply(texts: list) -> dict:
            hashed = [shingle_hashes(t, width) for t in texts]
            return {"fp": pa.array([_signed(fingerprint(h)) for h in hashed], pa.int64()), "bands": pa.array([keys(h) for h in hashed], pa.list_(pa.int64())), "size": pa.array([len(folded(h)) for h in hashed], pa.int32())}

        return apply

    return map_texts(df, text_col, worker, "fp bigint, bands array<bigint>, size int", keep)


def shingle_sets(df: DataFrame, text_col: str, keep: tuple[str, ...], width: int) -> DataFrame:
    """`keep` and shingles: the distinct shingles of each text, their hashes folded to 32 bits."""

    def worker():
        import pyarrow as pa

        return lambda texts: {"shingles": pa.array([folded(shingle_hashes(t, width)) for t in texts], pa.list_(pa.int32()))}

    return map_texts(df, text_col, worker, "shingles array<int>", keep)


def filed(distinct: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(th, fp, size, band, key): the buckets that each text (th, fp, bands, size) is in: those of its
    bands, and the pigeonhole blocks that fingerprints within `distance` bits share. The latter's keys
    are longer than in `links`, so that few strangers meet in them."""
    blocks = masks(distance, _blocks(8 * distinct.count(), distance))
    agree = F.array(*[F.struct(F.lit(BANDS + i).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(blocks)])
    near = distinct.select("th", "fp", "size", F.explode(agree).alias("x")).select("th", "fp", "size", "x.band", "x.key")
    return distinct.select("th", "fp", "size", F.posexplode("bands").alias("band", "key")).unionByName(near)


def candidates(buckets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a > b: each text with the first and the last one of its buckets.

    These link most copies at little cost; `unlinked` has what is left to compare. Pairs whose sizes
    alone rule the similarity out are no candidates; their fingerprints rule out nothing, as these
    count each repetition of a shingle.
    """
    one = F.struct("th", "fp", "size")
    ends = buckets.groupBy("band", "key").agg(F.count("*").alias("n"), F.min(one).alias("lo"), F.max(one).alias("hi")).where("n > 1").drop("n")
    met = buckets.join(ends, ["band", "key"]).select("th", "fp", "size", F.explode(F.array("lo", "hi")).alias("x"))
    met = met.where((F.col("th") != F.col("x.th")) & (F.least("size", "x.size") >= similarity * F.greatest("size", "x.size")))
    return met.select(F.greatest("th", "x.th").alias("a"), F.least("th", "x.th").alias("b")).distinct()


def unlinked(buckets: DataFrame, roots: DataFrame, block: int | None = None) -> DataFrame:
    """(band, key, i, j, th, root): the buckets that still have texts of different roots, in pairs of
    blocks, so that each two members of a bucket are together in some group of at most some 2 * block.

    In buckets of up to three, all pairs have one of the ends. Of buckets with the same members one
    is taken.
    """
    block = block or BLOCK
    rows = buckets.join(roots, "th", "left").select("band", "key", "th", F.coalesce("root", "th").alias("root"))
    marks = [F.bit_xor(F.xxhash64("th", F.lit(i))).alias(f"m{i}") for i in (1, 2)]
    several = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), *marks).where("n > 3 AND lo <> hi")
    several = several.groupBy("n", "m1", "m2").agg(F.min(F.struct("band", "key")).alias("x")).select("x.band", "x.key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    rows = rows.join(written(several, "several"), ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("th", F.lit(3)), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts = 1 OR own <> other")
    return rows.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "th", "root")


def _similar(names, roots, sets, similarity: float):
    """(a, b), a > b: similar pairs that, with the pairs of equal roots, link all that similar pairs of
    these texts link. Every text is compared with all that aren't linked to it yet."""
    import numpy as np

    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    _, group, count = np.unique(roots, return_inverse=True, return_counts=True)
    mark, found = np.zeros(int(flat.max(initial=-1)) + 1, bool), []
    # Two texts of different groups aren't both in the largest one.
    for x in np.flatnonzero(group != count.argmax()).tolist():
        mark[own := flat[ends[x] - sizes[x] : ends[x]]] = True
        shared = np.concatenate([[0], np.cumsum(mark[flat])])
        shared = shared[ends] - shared[ends - sizes]
        mark[own] = False
        for y in np.flatnonzero((group != group[x]) & (shared >= similarity * (sizes + sizes[x] - shared))).tolist():
            if group[y] != group[x]:
                found.append((max(names[x], names[y]), min(names[x], names[y])))
                group[group == group[y]] = group[x]
        if (group == group[x]).all():
            break
    return found


def search(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the edges of _similar in each group of `unlinked`, of the texts' shingle sets."""

    def run(x):
        import numpy as np
        import pyarrow as pa

        found = _similar(x["th"].to_numpy(), x["root"].to_numpy(), [np.asarray(v.values) for v in x["shingles"]], similarity)
        return pa.table({k: pa.array([e[i] for e in found], pa.int64()) for i, k in enumerate("ab")})

    keys = ["band", "key", "i", "j"]
    return groups.join(sets, "th").groupBy(*keys).applyInArrow(run, "a bigint, b bigint").distinct()


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = NEAR_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(id, th, root) of every row of df: rows of one root are copies, or linked by pairs of texts
    whose sets of shingles have at least this Jaccard similarity, each pair verified exactly.

    Fingerprints alone can't do this: at a similarity of 0.8 two differ in ten bits on average. Texts
    without words are copies of each other.
    """
    hashed = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("__t"))
    rows = written(signatures(hashed, "__t", ("id", "th"), width), "signatures")
    distinct = written(rows.groupBy("th").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("size").alias("size")), "distinct")

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = hashed.select("th", "__t").join(written(wanted.distinct(), "wanted"), "th", "left_semi").groupBy("th").agg(F.first("__t").alias("__t"))
        return written(shingle_sets(texts, "__t", ("th",), width), "sets")

    buckets = filed(distinct)
    pairs = written(candidates(buckets, similarity), "candidates")
    sets = sets_of(pairs.select(F.col("a").alias("th")).unionByName(pairs.select(F.col("b").alias("th"))))
    both = pairs.join(sets.select(F.col("th").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("th").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    total = F.size("x") + F.size("y")
    both = both.where(F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y"))).where(shared >= similarity * (total - shared))
    edges = components(both.select("a", "b"))
    groups = written(unlinked(buckets, edges.select(F.col("a").alias("th"), F.col("b").alias("root"))), "unlinked")
    more = written(search(groups, sets_of(groups.select("th")), similarity), "links")
    if not more.isEmpty():
        edges = components(edges.select("a", "b").unionByName(more))
    roots = edges.select(F.col("a").alias("th"), F.col("b").alias("root"))
    return rows.select("id", "th").join(roots, "th", "left").select("id", "th", F.coalesce("root", "th").alias("root"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = NEAR_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of similar texts: the smallest id (null last), of equal ids the
    smallest text hash.

    Of rows equal in id and text one stays, even if other columns differ. Columns are those of df.
    """
    key = F.xxhash64(id_col, "__th", F.lit(5))
    groups = similar_groups(df, id_col, text_col, width, similarity)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("th"))).alias("x"))
    best = written(best.select(F.col("x.id").alias(id_col), F.col("x.th").alias("__th")).select("__th", key.alias("__ih")), "kept")
    rows = df.withColumn("__th", F.xxhash64(text_col)).withColumn("__ih", key)
    return rows.join(best, ["__th", "__ih"], "left_semi").dropDuplicates(["__th", "__ih"]).select(*df.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every row of documents."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


QUERIES = {"op5_simhash": op5_simhash}
ORACLES: dict[str, str] = {}
