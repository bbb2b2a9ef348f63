"""Byte-level BPE encoding and decoding over a pair occurrence index.

The words of a slice of texts that are new to the task are laid out in one sequence. An index maps
each mergeable pair to all its positions; the ranks that occur are taken in ascending order, every
position of the pair is merged, and the lists of the neighbouring pairs are updated. A merge only
creates pairs of higher rank, so each list is visited once.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from heapq import heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import Places, map_texts, table

#: Fixed value: how byte-level BPE cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers, at about 250 bytes each; then it forgets them all.
CACHE = 200_000
#: Lists of more positions are merged with array operations.
SHORT = 24
#: Bytes of text whose words are merged together.
SLICE = 1 << 22


def byte_letters() -> list[str]:
    """The character by which a vocabulary file writes each byte: printable ones stand for
    themselves, the others for 256, 257 and so on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """Encodes and decodes with a tokenizer file of the kind byte-level BPE."""

    def __init__(self, path: str) -> None:
        import numpy as np
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.rank: dict[int, int] = {}
        self.made: list[tuple[int, int, int]] = []
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[vocab[a] << 20 | vocab[b]] = r
            self.made.append((vocab[a], vocab[b], vocab[a + b]))
        # By rank: the pairs' keys; and the rank of each pair of bytes, -1 for none.
        self.pairs = Places(np.array([a << 20 | b for a, b, _ in self.made], np.int64))
        both = (self.first[:, None].astype(np.int64) << 20 | self.first[None, :]).ravel()
        self.rank_of_bytes = self.pairs.find(both)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[str, bytes] = {}

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as 32-bit integers.

        Long lists of positions are merged with array operations, short ones one by one; both work
        on the same memory. Position n stands for what is before and behind each word.
        """
        import numpy as np

        if not words:
            return []
        encoded = [w.encode() for w in words]
        raw = np.frombuffer(b"".join(encoded), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))
        n = len(raw)
        token, after, before = (array("i", bytes(4 * (n + 1))) for _ in range(3))
        tokens, nexts, lasts = (np.frombuffer(x, np.int32) for x in (token, after, before))
        tokens[:n], tokens[n] = self.first[raw], -1
        nexts[:], lasts[:] = np.arange(1, n + 2), np.arange(-1, n)
        nexts[ends - 1], lasts[0], lasts[ends[:-1]] = n, n, n
        places: dict[int, list] = {}
        active: list[int] = []

        def file(ranks, positions) -> None:
            """Put positions into the lists of their ranks."""
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
            for r, s, e in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ranks)], strict=True):
                part = positions[s:e] if e - s > SHORT else positions[s:e].tolist()
                if r not in places:
                    places[r] = []
                    heappush(active, r)
                if e - s > SHORT:
                    places[r].append(part)
                else:
                    places[r] += part

        pairs = self.rank_of_bytes[raw[:-1].astype(np.int32) * 256 + raw[1:]] if n > 1 else np.zeros(0, np.int32)
        pairs[ends[:-1] - 1] = -1
        if (at := np.flatnonzero(pairs >= 0)).size:
            file(pairs[at], at)
        rank, made = self.rank, self.made
        while active:
            r = heappop(active)
            a, b, new = made[r]
            listed = places.pop(r)
            wide = [x for x in listed if not isinstance(x, int)]
            if wide and a != b:
                p = np.unique(np.concatenate([*wide, np.array([x for x in listed if isinstance(x, int)], np.int64)]))
                p = p[tokens[p] == a]
                j = nexts[p]
                fits = tokens[j] == b
                p, j = p[fits], j[fits]
                k = nexts[j]
                tokens[p], tokens[j], nexts[p], lasts[k] = new, -2, k, p
                q = lasts[p]
                right, left = tokens[k].astype(np.int64), tokens[q].astype(np.int64)
                keys = np.concatenate([new << 20 | right[right >= 0], left[left >= 0] << 20 | new])
                ranks = self.pairs.find(keys)
                found = ranks >= 0
                if found.any():
                    file(ranks[found], np.concatenate([p[right >= 0], q[left >= 0]])[found])
                continue
            for i in sorted(set([y for x in listed for y in ([x] if isinstance(x, int) else x.tolist())] if wide else listed)):
                j = after[i]
                if token[i] != a or token[j] != b:
                    continue
                token[i], token[j] = new, -2
                k = after[i] = after[j]
                before[k] = i
                q = before[i]
                for x, at in ((new << 20 | token[k] if token[k] >= 0 else -1, i), (token[q] << 20 | new if token[q] >= 0 else -1, q)):
                    if (y := rank.get(x)) is not None:
                        if y in places:
                            places[y].append(at)
                        else:
                            places[y] = [at]
                            heappush(active, y)
        kept = tokens[:n] >= 0
        ids = tokens[:n][kept].tobytes()
        cuts = (4 * np.cumsum(kept)[ends - 1]).tolist()
        return [ids[s:e] for s, e in zip([0, *cuts], cuts, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers; special tokens in a text are themselves."""
        cut = []
        for text in texts:
            parts: list = []
            at = 0
            for m in self.cut.finditer(text) if self.cut else ():
                parts += [self.words.findall(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
                at = m.end()
            cut.append([*parts, self.words.findall(text[at:] if at else text)])
        seen = {w for parts in cut for p in parts if isinstance(p, list) for w in p}
        known = self.known
        if len(known) + len(seen) > CACHE:
            known.clear()
        new = [w for w in seen if w not in known]
        known.update(zip(new, self.merge(new), strict=True))
        return [b"".join([p if isinstance(p, bytes) else b"".join(map(known.__getitem__, p)) for p in parts]) for parts in cut]

    def decode(self, ids: list[int]) -> str:
        """The text; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One per worker process and file."""
    return Tokenizer(path)


def encode(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), round_trip: bool = False) -> DataFrame:
    """`keep` and ids, the token ids of every whole text (null counts as empty: no ids).

    With round_trip also `decoded`, the text decoded from the ids. `path` is a tokenizer file that
    the executors can read. Repeated rows are encoded one by one; a kept column named ids or decoded gives
    way to that made here; texts of any length are encoded whole; of an empty table there are no rows.
    """

    def worker():
        import numpy as np
        import pyarrow as pa

        bpe = tokenizer(path)

        def apply(texts: list) -> dict:
            made = bpe.encode([t or "" for t in texts])
            ids = np.frombuffer(b"".join(made), np.int32)
            ends = np.cumsum([0, *(len(x) // 4 for x in made)])
            out = {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))}
            if round_trip:
                out["decoded"] = pa.array([bpe.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)], pa.string())
            return out

        return apply

    return map_texts(df, text_col, worker, "ids array<int>" + ", decoded string" * round_trip, keep, SLICE)


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and decoded, the text of an array of ids (null: null)."""

    def worker():
        import pyarrow as pa

        bpe = tokenizer(path)
        return lambda lists: {"decoded": pa.array([None if x is None else bpe.decode(x) for x in lists], pa.string())}

    return map_texts(df, ids_col, worker, "decoded string", keep)


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens and the SHA-256 of ids and decoded text instead of ids and decoded."""
    return encoded.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    ).drop("ids", "decoded")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every row of documents."""
    return digests(encode(table(spark, sf_dir, "documents"), vocabulary(), round_trip=True))


QUERIES = {"op2_bpe": op2_bpe}
ORACLES: dict[str, str] = {}
