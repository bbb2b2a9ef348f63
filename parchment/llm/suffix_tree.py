"""Language-model scoring with a probabilistic suffix tree.

Every word is a symbol of the tree, named by a hash of 64 bits, and so is every sequence of words. The
tree's contexts grow level by level: a context is a candidate if it is frequent, and stays if its
next-word distribution diverges from that of its suffix. Distributions are smoothed by absolute
discounting towards the suffix's. A text is scored with the longest suffix state at each place.

Texts are kept as chunks with a dictionary each. For a level, a chunk sends the distinct pairs of a
candidate context and the word behind it, packed, to the parts of the tree. A part is a subtree: the
contexts with one last word, or some of the following words if that last word is hot, so that what a pair is
compared with, the pair of the context's suffix, is in the same part. The part adds the counts up and answers
each chunk with the sums of its own pairs and the states of its own contexts, in their order.

Nothing bounds the model's rows. What workers hold beside a chunk or part has fixed bounds and decides
nothing but cost: filters by hashed bits, and the most frequent words.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from parchment.llm.common import Places, fold, give_back, table, written

#: Words, the most frequent ones, that each worker holds; all others go by their hashes.
WORDS = 1 << 19
DEPTH = 3
#: A candidate context occurs at least so often; a follower of its own at least twice.
FREQUENT = 20
DISCOUNT = 0.75
#: Nats that a context must save over its suffix, over all its occurrences; nats of a follower.
DIVERGENCE, GAIN = 5.0, 0.1
#: Tokens of a chunk (a longer text is one alone), training tokens of a part.
CHUNK, PART = 1_500_000, 1_000_000
#: Tokens, or answers to them, that are worked on at once where each is by itself; it decides only the memory.
SLICE = 1 << 18
#: Most bits of a filter. More keys than that make it pass more, never less.
FILTER = 1 << 26
SLOTS = (0, 19, 38)
#: Names of the end and the beginning of a text; the base of the keys of sequences.
END, START = -1205034819632174695, 0x2545F4914F6CDD1D
STEP = 0x9E3779B97F4A7C15
#: The codes of a follower that no count of two or more can have, and of the beginning of a text.
OTHER, BEGINNING = -1, -2


def split(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def pack(*columns) -> bytes:
    """Arrays as bytes. Signed integers are kept as differences, others in as few bytes as they need;
    bytes of one weight stand together."""
    import numpy as np
    import pyarrow as pa

    head, body = [len(columns)], []
    for x in columns:
        if x.dtype == np.int64:
            steps = np.diff(x, prepend=np.int64(0))
            x, kind = ((steps << 1) ^ (steps >> 63)).view(np.uint64), 0
        else:
            x = x.astype(np.min_scalar_type(int(x.max(initial=0)))) if x.dtype.kind == "u" else x
            kind = ord(x.dtype.char)
        head += [kind, len(x)]
        body.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> list:
    import numpy as np
    import pyarrow as pa

    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * count, 8).tolist(), 8 + 16 * count, []
    for code, n in zip(head[::2], head[1::2], strict=True):
        kind = np.dtype(chr(code) if code else "u8")
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).view(kind).reshape(n)
        at += n * kind.itemsize
        if not code:
            x = np.cumsum((x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64))
        out.append(x)
    return out


def _encode(df: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """chunk, tokens, the `keep` of its texts as arrays, and text: their sizes, the chunk's distinct words
    by falling count and the words of all texts as places in these, packed."""
    source = df.select(*keep, F.col(text_col).alias("__text"))
    out = StructType([*StructType.fromDDL("chunk bigint, tokens bigint").fields, *(StructField(c, ArrayType(source.schema[c].dataType)) for c in keep), *StructType.fromDDL("text binary").fields])

    def run(batches):
        from array import array
        from collections import defaultdict
        from itertools import count

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        chunk = TaskContext.get().partitionId() << 32

        def fresh():
            index = defaultdict(count().__next__)
            return index, index[b""], array("I"), [], [[] for _ in keep]

        def flush():
            words = np.fromiter(map(xxh64_intdigest, index), np.uint64, len(index)).view(np.int64)
            words[0] = END
            at = np.frombuffer(codes, np.uint32)
            order = np.lexsort((words, -np.bincount(at)))
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            text = pack(np.array(sizes, np.uint64), words[order], place[at])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(c)) for c in kept]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([len(at)], pa.int64()), *lists, pa.array([text], pa.binary())], names=["chunk", "tokens", *keep, "text"])

        index, end, codes, sizes, kept = fresh()
        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column(len(keep))):
                own = split(text.as_py())
                if sizes and len(codes) + len(own) >= CHUNK:
                    for c, values in enumerate(kept):
                        values.append(batch.column(c).slice(start, i - start))
                    yield flush()
                    start, chunk = i, chunk + 1
                    index, end, codes, sizes, kept = fresh()
                codes.extend(map(index.__getitem__, own))
                codes.append(end)
                sizes.append(len(own) + 1)
            for c, values in enumerate(kept):
                values.append(batch.column(c).slice(start))
        if sizes:
            yield flush()
        del index, codes
        give_back()

    return source.mapInArrow(run, out)


def _mixed(ids):
    import numpy as np

    x = ids.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Chunk:
    """A chunk's texts: words by their hashes, and for each token the place of its word in these."""

    def __init__(self, text: bytes, held=None) -> None:
        import numpy as np

        sizes, self.words, self.at = unpack(text)
        self.sizes = sizes.astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.train = None if held is None else np.repeat(~np.asarray(held, bool), self.sizes)
        self.mixed = _mixed(self.words)
        self.place = np.arange(len(self.at), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.sizes)

    def keys(self, there, length: int):
        """Of the contexts so long at some places that have one: their keys, those of their suffixes and of
        their last words. The key of words is a polynomial of their hashes, so that a context with its
        follower is also a context one longer."""
        import numpy as np

        key, power, last = np.zeros(len(there), np.uint64), 1, None
        for k in range(1, length + 1):
            suffix, term = key, self.mixed[self.at[there - k]]
            if k == length:
                term[self.place[there] == k - 1] = _mixed(np.array([START], np.int64))[0]
            key = suffix + term * np.uint64(power)
            power = power * STEP % (1 << 64)
            last = key if last is None else last
        return key.view(np.int64), suffix.view(np.int64), last.view(np.int64)

    def candidates(self, length: int, bits):
        """(places with a context so long that passes the filter, its key), looked for slice by slice."""
        import numpy as np

        places, keys = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(self.at), SLICE):
            there = np.flatnonzero(self.place[i : i + SLICE] >= length - 1).astype(np.int32) + np.int32(i)
            key = self.keys(there, length)[0]
            ok = _passes(bits, key)
            places.append(there[ok])
            keys.append(key[ok])
        return np.concatenate(places), np.concatenate(keys)

    def word_parts(self, parts: int):
        """(order of the words by part and hash, edges of the parts in it, the parts)."""
        import numpy as np

        part = self.mixed % np.uint64(parts)
        order = np.lexsort((self.words, part))
        edges = _edges(part[order])
        return order, edges, part[order][edges[:-1]].astype(np.int64)


@dataclass
class Known:
    """What each worker holds: words by falling count with their counts, bits of the words seen twice,
    last words with more tokens than a part and their pieces, and how many parts there are."""

    words: Any
    counts: Any
    twice: Any
    hot: Any
    pieces: Any
    parts: int
    unit: int

    def find(self, words):
        """The ranks of words, -1 for those that aren't held. The table is made once a worker."""
        if "places" not in self.__dict__:
            self.places = Places(self.words)
        return self.places.find(words)

    def codes(self, words):
        """A held word's rank, another word's hash."""
        import numpy as np

        rank = self.find(words).astype(np.int64)
        return np.where(rank >= 0, rank, np.where((words >= BEGINNING) & (words < len(self.words)), words ^ (1 << 62), words))

    def hashes(self, codes):
        import numpy as np

        held = (codes >= 0) & (codes < len(self.words))
        out = codes.copy()
        out[held] = self.words[codes[held]]
        out[codes == BEGINNING] = START
        return out


@dataclass
class Pairs:
    """The distinct pairs of one length in a chunk, by part, context (by suffix and oldest word) and word."""

    there: Any  # places with a candidate context
    pair: Any  # the pair at each of these
    context: Any  # of each pair: its context, as a place in suffixes and oldest
    suffixes: Any
    oldest: Any
    code: Any
    part: Any

    def entries(self):
        """Of each pair, the number of its part's context among those of all parts."""
        import numpy as np

        if not len(self.part):
            return np.zeros(0, np.int64)
        return np.concatenate([[0], np.cumsum((self.part[1:] != self.part[:-1]) | (self.context[1:] != self.context[:-1]))])


def _distinct(x):
    """The distinct values of x, where one of each stands, and of each of x its value's number."""
    import numpy as np

    order = np.argsort(x)
    values = x[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])[: len(x)]
    values, first = values[new], order[new]
    number = np.empty(len(x), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return values, first, number


def _pairs(chunk: Chunk, length: int, bits, known: Known, codes) -> Pairs:
    import numpy as np

    there, contexts = chunk.candidates(length, bits)
    _, first, context = _distinct(contexts)
    del contexts
    at = there[first]
    _, suffixes, last = chunk.keys(at, length)
    begins = chunk.place[at] == length - 1
    oldest = np.where(begins, BEGINNING, codes[chunk.at[at - length]])
    order = np.lexsort((oldest, suffixes))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    context, suffixes, oldest, last = rank[context], suffixes[order], oldest[order], last[order]
    if len(known.counts):
        often = np.where((codes >= 0) & (codes < len(known.words)), known.counts[np.clip(codes, 0, len(known.counts) - 1)] >= 2, _passes(known.twice, chunk.words))
    else:
        often = np.zeros(len(codes), bool)
    ordered, word = np.unique(np.where(often, codes, OTHER), return_inverse=True)
    key = context.astype(np.int64)
    del context
    key *= len(ordered)
    key += word.astype(np.int32)[chunk.at[there]]
    key, _, pair = _distinct(key)
    context, code = (key // len(ordered)).astype(np.int32), ordered[key % len(ordered)]
    del key
    part = last.view(np.uint64)[context]
    if len(known.hot):
        hot = Places(known.hot).find(last)
        pieces = np.where(hot >= 0, known.pieces[hot], 1)[context]
        part += (code % pieces).view(np.uint64) * np.uint64(STEP)
        del pieces
    part ^= part >> np.uint64(32)
    part *= np.uint64(0xBF58476D1CE4E5B9)
    part >>= np.uint64(33)
    part %= np.uint64(known.parts)
    order = np.argsort(part, kind="stable")
    back = np.empty(len(order), np.int32)
    back[order] = np.arange(len(order), dtype=np.int32)
    return Pairs(there, back[pair], context[order], suffixes, oldest, code[order], part[order].astype(np.int64))


def _edges(x):
    """Where runs of equal values begin, and the end."""
    import numpy as np

    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)


def _bits(df: DataFrame):
    """The filter of the keys of df, as words of 64 bits: 16 bits a key, FILTER at most, of which a key
    sets three."""
    import numpy as np

    size = min(FILTER, max(1 << 10, 1 << (16 * df.count()).bit_length()))
    slots = F.explode(F.array(*(F.shiftrightunsigned("key", k).bitwiseAND(F.lit(size - 1)) for k in SLOTS))).alias("slot")
    rows = df.select(slots).select(F.shiftrightunsigned("slot", 6).alias("at"), F.expr("shiftleft(1L, CAST(slot & 63 AS INT))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return bits


def _passes(bits, keys):
    import numpy as np

    ok = np.ones(len(keys), bool)
    for k in SLOTS:
        slot = ((keys.view(np.uint64) >> np.uint64(k)) & np.uint64(64 * len(bits) - 1)).view(np.int64)
        ok &= (bits[slot >> 6] >> (slot & 63)) & 1 == 1
    return ok


def _counted(encoded: DataFrame, parts: int) -> DataFrame:
    """The words of training texts, counted by part: rows with a chunk have the counts of its words
    (cell), rows without have all words of a part (key) and their counts (n)."""

    def send(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for number, text, held in zip(*(batch.column(i) for i in range(3)), strict=True):
                chunk = Chunk(text.as_py(), held.values.to_numpy(zero_copy_only=False))
                n = np.bincount(chunk.at[chunk.train], minlength=len(chunk.words)).astype(np.uint64)
                order, edges, part = chunk.word_parts(parts)
                cells = [pack(chunk.words[order[a:b]], n[order[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([number.as_py()] * len(part), pa.int64()), pa.array(cells, pa.binary())], names=["part", "chunk", "cell"])
        give_back()

    def merge(x):
        import numpy as np
        import pyarrow as pa

        own = [unpack(v.as_py()) for v in x.column("cell")]
        words, at = np.unique(np.concatenate([c[0] for c in own]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c[1] for c in own])).astype(np.int64)
        ends = np.cumsum([len(c[0]) for c in own])
        cells = [pack(n[at[e - len(c[0]) : e]].astype(np.uint64)) for e, c in zip(ends, own, strict=True)]
        lists = {k: pa.array([None] * len(own) + [v[n > 0]], pa.list_(pa.int64())) for k, v in (("key", words), ("n", n))}
        part = pa.array([x.column("part")[0].as_py()] * (len(own) + 1), pa.int64())
        return pa.table({"part": part, "chunk": pa.concat_arrays([x.column("chunk").combine_chunks(), pa.nulls(1, pa.int64())]), "cell": pa.array([*cells, None], pa.binary()), **lists})

    cells = encoded.select("chunk", "text", "held").mapInArrow(send, "part bigint, chunk bigint, cell binary")
    return cells.groupBy("part").applyInArrow(merge, "part bigint, chunk bigint, cell binary, key array<bigint>, n array<bigint>")


def _cells(encoded: DataFrame, length: int, shared: Broadcast, bits: Broadcast) -> DataFrame:
    """(part, chunk, cell): a chunk's pairs in a part: the suffixes of contexts, their oldest words, their
    numbers of pairs, followers and training counts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = shared.value

        def sent(number: int, text: bytes, held):
            chunk = Chunk(text, held)
            x = _pairs(chunk, length, bits.value, known, known.codes(chunk.words))
            n = np.bincount(x.pair[chunk.train[x.there]], minlength=len(x.context)).astype(np.uint64)
            edges, parts, cells = _edges(x.part), [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = _edges(x.context[a:b])
                names = x.context[a:b][own[:-1]]
                parts.append(int(x.part[a]))
                cells.append(pack(x.suffixes[names], x.oldest[names], np.diff(own).astype(np.uint64), x.code[a:b], n[a:b]))
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([number] * len(parts), pa.int64()), pa.array(cells, pa.binary())], names=["part", "chunk", "cell"])

        for batch in batches:
            for number, text, held in zip(*(batch.column(i) for i in range(3)), strict=True):
                yield sent(number.as_py(), text.as_py(), held.values.to_numpy(zero_copy_only=False))
        give_back()

    return encoded.select("chunk", "text", "held").mapInArrow(run, "part bigint, chunk bigint, cell binary")


MERGED = "part bigint, chunk bigint, cell binary, own binary, s array<bigint>, total array<bigint>, several array<bigint>, kinds array<bigint>, next array<bigint>, asked array<bigint>"


def _merged(cells: DataFrame, length: int, shared: Broadcast) -> DataFrame:
    """The sums of the cells of a part. With a chunk: the counts of its pairs, 0 for those under two, and its
    contexts as places in s (own). Without: the pairs that count two or more, and of each context (s) its
    occurrences, and how often and how many followers stand there twice or more; keys of frequent
    sequences; followers that aren't held."""

    def run(x):
        import numpy as np
        import pyarrow as pa

        known, rows = shared.value, x.num_rows
        cells = [unpack(v.as_py()) for v in x.column("cell")]
        ends, tops = np.cumsum([len(c[4]) for c in cells]), np.cumsum([len(c[0]) for c in cells])
        suffix, oldest, counts, code, count = (np.concatenate([c.pop(0) for c in cells]) for _ in range(5))
        counts = counts.astype(np.int64)
        power = np.uint64(pow(STEP, length - 1, 1 << 64))
        s, first, at = _distinct((suffix.view(np.uint64) + _mixed(known.hashes(oldest)) * power).view(np.int64))
        # Contexts have their order in the cells.
        order = np.lexsort((oldest[first], suffix[first]))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        s, suffix, at = s[order], suffix[first][order], rank[at]
        w, _, word = _distinct(code)
        del code
        key = np.repeat(at, counts).astype(np.int64)
        key *= len(w)
        key += word
        key, _, pair = _distinct(key)
        n = np.bincount(pair, count).astype(np.int64)
        context, word = key // len(w), key % len(w)
        del key, count, counts
        total = np.bincount(context, n, len(s)).astype(np.int64)
        keeps = (n >= 2) & (w[word] != OTHER)
        sums = np.where(keeps, n, 0).astype(np.uint64)
        answered = [pack(sums[pair[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        owned = [pack(at[a:b].astype(np.int64)) for a, b in zip([0, *tops[:-1]], tops, strict=True)]
        del pair, at, sums
        context, word, n = context[keeps], word[keeps], n[keeps]
        edges = _edges(context)
        names = context[edges[:-1]]
        several = np.bincount(context, n, len(s)).astype(np.int64)
        kinds = np.bincount(context, minlength=len(s))
        often = n >= FREQUENT
        hashes = known.hashes(w[word[often]])
        following = (s[context[often]].view(np.uint64) * np.uint64(STEP) + _mixed(hashes)).view(np.int64)[hashes != END]
        asked = w[(w < OTHER) | (w >= len(known.words))]
        asked = asked[np.isin(asked, w[word])]
        answered.append(pack(s[names], np.diff(edges).astype(np.uint64), suffix[names], w[word], n.astype(np.uint64)))
        made = {"part": pa.array([x.column("part")[0].as_py()] * (rows + 1), pa.int64()), "chunk": pa.concat_arrays([x.column("chunk").combine_chunks(), pa.nulls(1, pa.int64())])}
        made |= {"cell": pa.array(answered, pa.binary()), "own": pa.array([*owned, None], pa.binary())}
        for name, values in zip(("s", "total", "several", "kinds", "next", "asked"), (s, total, several, kinds, following, asked), strict=True):
            made[name] = pa.array([None] * rows + [values], pa.list_(pa.int64()))
        del context, word, n, keeps
        give_back()
        return pa.table(made)

    return cells.groupBy("part").applyInArrow(run, MERGED)


def _gains(merged: DataFrame, right: DataFrame, length: int, shared: Broadcast) -> DataFrame:
    """(part, cell, s, saved, most, among): the pairs of a part with the probabilities that their contexts'
    suffixes give; what the pairs of each context save over these, and how often and how many of those stand
    there that gain.

    right, by kind: own (contexts s of the part with their total and back), stay (those of the level
    below that stay), low (cells of the level below), word (total of a word s that isn't held)."""

    def run(pairs, right):
        import numpy as np
        import pyarrow as pa

        kinds = {"part": pa.int64(), "cell": pa.binary(), "s": pa.list_(pa.int64()), "saved": pa.list_(pa.float64()), "most": pa.list_(pa.int64()), "among": pa.list_(pa.int64())}
        if not pairs.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        s, counts, suffix, w, n = unpack(pairs.column("cell")[0].as_py())
        context, n = np.repeat(np.arange(len(s)), counts.astype(np.int64)), n.astype(np.float64)
        sort = np.array(right.column("kind").to_pylist(), "U4")

        def rows(kind: str):
            own = right.filter(pa.array(sort == kind))
            names = own.column("s").to_numpy()
            order = np.argsort(names)
            return names[order], own.column("total").to_numpy()[order].astype(np.float64), own.column("back").to_numpy()[order]

        def found(names, wanted):
            at = np.searchsorted(names, wanted)
            at[at == len(names)] = 0
            return at, names[at] == wanted if len(names) else np.zeros(len(wanted), bool)

        if length == 1:
            known = shared.value
            held = (w >= 0) & (w < len(known.counts))
            number = np.zeros(len(w))
            number[held] = known.counts[w[held]]
            names, more, _ = rows("word")
            at, there = found(names, w)
            there &= ~held
            number[there] = more[at[there]]
            p = (number + 1.0) / known.unit
        else:
            p = np.ones(len(n))
            stay, total, back = rows("stay")
            for cell in right.filter(pa.array(sort == "low")).column("cell").to_pylist():
                ls, lcounts, lw, ln, q = unpack(cell)
                lcontext, q = np.repeat(np.arange(len(ls)), lcounts.astype(np.int64)), q.astype(np.float64)
                at, stays = found(stay, ls)
                if len(stay):
                    q = np.where(stays[lcontext], (ln - DISCOUNT) / total[at][lcontext] + back[at][lcontext] * q, q)
                names, by = np.unique(np.concatenate([w, lw])), np.argsort(ls)
                at, there = found(ls[by], suffix)
                key = lcontext * np.int64(len(names)) + np.searchsorted(names, lw)
                place, hit = found(key, by[at][context] * np.int64(len(names)) + np.searchsorted(names, w))
                hit &= there[context]
                p[hit] = q[place[hit]]
        names, total, back = rows("own")
        at, there = found(names, s)
        saved, most, among = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(names):
            ratio = (n - DISCOUNT) / total[at][context]
            gain = n * np.log((ratio + back[at][context] * p) / p)
            saved = np.bincount(context, gain, len(s))[there]
            most = np.bincount(context, np.where(gain > GAIN, n, 0), len(s)).astype(np.int64)[there]
            among = np.bincount(context, gain > GAIN, len(s)).astype(np.int64)[there]
        cell = pack(s, counts, w, n.astype(np.uint64), p.astype(np.float32))
        made = {"part": pairs.column("part")[0].as_py(), "cell": cell, "s": s[there], "saved": saved, "most": most, "among": among}
        return pa.table({k: pa.array([v], kinds[k]) for k, v in made.items()})

    pairs = merged.where("chunk IS NULL").select("part", "cell")
    return pairs.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(run, "part bigint, cell binary, s array<bigint>, saved array<double>, most array<bigint>, among array<bigint>")


def _states(merged: DataFrame, stay: DataFrame, level: int) -> DataFrame:
    """(chunk, level, part, cell): which of a chunk's contexts in a part stay, in their order, and the
    state of those: total, several, kinds, most, among."""
    columns = ("total", "several", "kinds", "most", "among")

    def run(rows, right):
        import numpy as np
        import pyarrow as pa

        if not rows.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "cell": pa.array([], pa.binary())})
        s = next(v for v in rows.column("s") if v.is_valid).values.to_numpy()
        names = right.column("s").to_numpy()
        by = np.argsort(names)
        place = np.searchsorted(names[by], s)
        place[place == len(names)] = 0
        stays = names[by][place] == s if len(names) else np.zeros(len(s), bool)
        values = [right.column(c).to_numpy()[by] for c in columns]
        chunks, cells = [], []
        for number, own in zip(rows.column("chunk").to_pylist(), rows.column("own"), strict=True):
            if number is not None:
                at = unpack(own.as_py())[0]
                chunks.append(number)
                cells.append(pack(stays[at].astype(np.uint8), *(v[place[at[stays[at]]]].astype(np.uint64) for v in values)))
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "part": pa.array([rows.column("part")[0].as_py()] * len(chunks), pa.int64()), "cell": pa.array(cells, pa.binary())})

    left = merged.select("part", "chunk", "own", "s")
    right = stay.select("s", *columns, F.explode("parts").alias("part"))
    found = left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(run, "chunk bigint, part bigint, cell binary")
    return found.select("chunk", F.lit(-level).alias("level"), "part", "cell")


RIGHT = "part bigint, kind string, cell binary, s bigint, total bigint, back double"


def _right(df: DataFrame, kind: str, **columns) -> DataFrame:
    """df as rows of `_gains`."""
    fields = StructType.fromDDL(RIGHT).fields
    made = {"kind": F.lit(kind)} | columns
    return df.select(*(made.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def _grow(encoded: DataFrame, words: DataFrame, texts: int, shared: Broadcast, depth: int) -> tuple[DataFrame, list[Broadcast]]:
    """The tree as answers to chunks (chunk, level, part, cell): counts of pairs by level, states of
    contexts by level with a minus; and the filters of the candidates by level."""
    import numpy as np

    spark, filters = encoded.sparkSession, []
    start = [(int(x),) for x in _mixed(np.array([START], np.int64)).view(np.int64)] if texts >= FREQUENT else []
    candidates = _first_contexts(words.where((F.col("n") >= FREQUENT) & (F.col("key") != END))).unionByName(spark.createDataFrame(start, "key bigint"))
    answers = below = None
    sums_of = lambda df, *columns: df.select(F.explode(F.arrays_zip("s", *columns)).alias("x")).select("x.*").groupBy("s").agg(*(F.sum(c).alias(c) for c in columns))
    for length in range(1, depth + 1):
        filters.append(spark.sparkContext.broadcast(_bits(candidates)))
        merged = written(_merged(_cells(encoded, length, shared, filters[-1]), length, shared), f"level{length}", 64)
        sums = merged.where("chunk IS NULL")
        rows = sums.select("part", F.explode(F.arrays_zip("s", "total", "several", "kinds")).alias("x")).select("part", "x.*")
        totals = rows.groupBy("s").agg(*(F.sum(c).alias(c) for c in ("total", "several", "kinds")), F.collect_set("part").alias("parts"))
        totals = totals.where((F.col("total") >= FREQUENT) & (F.col("several") > 0))
        back = 1 - (F.col("several") - DISCOUNT * F.col("kinds")) / F.col("total")
        totals = written(totals.withColumn("back", back), f"totals{length}")
        right = _right(totals.select("*", F.explode("parts").alias("part")), "own")
        if below is None:
            asked = sums.select("part", F.explode("asked").alias("key")).join(words, "key")
            right = right.unionByName(_right(asked, "word", s=F.col("key"), total=F.col("n")))
        else:
            right = right.unionByName(below)
        gains = written(_gains(merged, right, length, shared), f"gains{length}", 64)
        stay = sums_of(gains, "saved", "most", "among").join(totals, "s").where(F.col("saved") + (F.col("total") - F.col("several")) * F.log("back") > DIVERGENCE)
        stay = written(stay.drop("saved"), f"stay{length}")
        below = _right(gains, "low", s=F.lit(None)).unionByName(_right(stay.select("*", F.explode("parts").alias("part")), "stay"))
        candidates = sums.select(F.explode("next").alias("key"))
        own = merged.where("chunk IS NOT NULL").select("chunk", F.lit(length).alias("level"), "part", "cell").unionByName(_states(merged, stay, length))
        answers = own if answers is None else answers.unionByName(own)
    return answers, filters


def _first_contexts(words: DataFrame) -> DataFrame:
    """(key) of contexts of one word."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(batch.column(0).to_numpy()).view("int64"))], names=["key"])

    return words.select("key").mapInArrow(run, "key bigint")


def _score(encoded: DataFrame, answers: DataFrame, shared: Broadcast, filters: list[Broadcast], keep: tuple[str, ...]) -> DataFrame:
    """`keep`, and per text: size, known words, and the logs of the base and the tree's probabilities.

    answers: of words (level 0) and of `_grow`."""
    elements = [StructField(c, encoded.schema[c].dataType.elementType) for c in keep]
    out = StructType([*elements, *StructType.fromDDL("size bigint, known bigint, base double, tree double").fields])

    def run(texts, right):
        import numpy as np
        import pyarrow as pa

        known = shared.value

        def answered(level: int, columns: int = 1) -> list:
            """The columns of the chunk's answers of a level, in the order of the parts."""
            cells = right.filter(pa.compute.equal(right.column("level"), level)).sort_by("part").column("cell")
            found = [unpack(c.as_py()) for c in cells]
            return [np.concatenate([np.zeros(0, np.int64), *(f[i].astype(np.int64) for f in found)]) for i in range(columns)]

        def scored(text: bytes) -> list:
            chunk = Chunk(text)
            order, _, _ = chunk.word_parts(known.parts)
            count = np.empty(len(order), np.int64)
            count[order] = answered(0)[0]
            known_words = np.add.reduceat((count > 0)[chunk.at].astype(np.int64), chunk.starts)
            fit = ((count + 1.0) / known.unit)[chunk.at]
            base, p = np.add.reduceat(np.log10(fit), chunk.starts), fit.copy()
            codes = known.codes(chunk.words)
            for length, bits in enumerate(filters, 1):
                x = _pairs(chunk, length, bits.value, known, codes)
                flags, total, several, kinds, most, among = answered(-length, 6)
                back, least = 1 - (several - DISCOUNT * kinds) / total, 1 - (most - DISCOUNT * among) / total
                states = np.where(flags > 0, np.cumsum(flags) - 1, -1)[x.entries()]
                counts = answered(length)[0]
                for i in range(0, len(x.there), SLICE):
                    there, pair = x.there[i : i + SLICE], x.pair[i : i + SLICE]
                    state = states[pair]
                    stays = state >= 0
                    there, state, n = there[stays], state[stays], counts[pair[stays]].astype(np.float64)
                    share, kept, lower = (n - DISCOUNT) / total[state], n >= 2, fit[there]
                    mixed = np.where(kept, share + back[state] * lower, lower)
                    gain = n * np.log(mixed / lower)
                    p[there] = least[state] * p[there] + np.where(kept & (gain > GAIN), share, 0.0)
                    fit[there] = mixed
                del x, states, counts
            return [chunk.sizes, known_words, base, np.add.reduceat(np.log10(p), chunk.starts)]

        made = [scored(row.as_py()) for row in texts.column("text")]
        give_back()
        columns = [np.concatenate(c) if made else [] for c in (zip(*made, strict=True) if made else [()] * 4)]
        rows = {c: pa.chunked_array([v.flatten() for v in texts.column(c).chunks], texts.schema.field(c).type.value_type) for c in keep}
        return pa.table(rows | {"size": pa.array(columns[0], pa.int64()), "known": pa.array(columns[1], pa.int64()), "base": pa.array(columns[2], pa.float64()), "tree": pa.array(columns[3], pa.float64())})

    source = encoded.select("chunk", *keep, "text")
    return source.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, out)


def _most(df: DataFrame, weight: str, bound: int) -> DataFrame:
    """The rows of df of the largest weights, `bound` at most, whole steps of weights only."""
    steps = df.groupBy(F.floor(F.log2(F.col(weight)) * 16).alias("step")).agg(F.count("*").alias("rows")).collect()
    least, rows = float("inf"), 0
    for step, count in sorted(((r.step, r.rows) for r in steps), reverse=True):
        rows += count
        if rows > bound:
            break
        least = step
    return df.where(F.floor(F.log2(F.col(weight)) * 16) >= F.lit(least))


def _held(df: DataFrame, weight: str, columns: tuple[str, ...]) -> tuple:
    """The columns of df as arrays, by falling weight."""
    import numpy as np

    rows = df.select(*columns).toArrow()
    found = [rows.column(c).to_numpy() for c in columns]
    order = np.lexsort((found[0], -found[columns.index(weight)]))
    return tuple(c[order] for c in found)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Fit on the texts whose crc32(id) mod 7 isn't 2 and score all.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score
    (the tree), log10 probabilities of the whole text and its end. Null texts count as empty: one
    token, the end. Repeated rows are counted and scored one by one. Other columns, whatever their
    names, play no part. A text of any length is scored whole. Without training texts all
    words are unknown and all probabilities are those of an empty model; of an empty table, no rows.
    """
    import numpy as np

    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), (fold(id_col, 7) == 2).alias("held"))
    encoded = written(_encode(docs, "t", ("id", "held")), "encoded", 8)
    parts = max(1, -(-encoded.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] // PART))
    counted = written(_counted(encoded, parts), "words", 64)
    words = counted.where("chunk IS NULL").select(F.explode(F.arrays_zip("key", "n")).alias("x")).select("x.key", "x.n")
    tokens, distinct, texts = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.max(F.when(F.col("key") == END, F.col("n")))).first()
    names, counts = _held(_most(words, "n", WORDS), "n", ("key", "n"))
    last = np.concatenate([_mixed(names), _mixed(np.array([START], np.int64))]).view(np.int64)
    sizes = np.append(counts, texts or 0)
    hot = sizes > PART
    known = Known(names, counts, _bits(words.where("n >= 2")), last[hot], -(-sizes[hot] // PART), parts, tokens + distinct + 1)
    shared = spark.sparkContext.broadcast(known)
    answers, filters = counted.where("chunk IS NOT NULL").select("chunk", F.lit(0).alias("level"), "part", "cell"), []
    if tokens and depth:
        tree, filters = _grow(encoded, words, texts, shared, depth)
        answers = answers.unionByName(tree)
    out = _score(encoded, answers, shared, filters, ("id", "held"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        F.col("size").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("tree").alias("score"),
    )


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every row of documents."""
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op3_lm_scores": op3_lm_scores}
ORACLES: dict[str, str] = {}
