"""Chunks of documents: rule-based packing, semantic breakpoints, clamping, union and metrics.

Packing is a greedy fold over a document's paragraphs and runs as an Arrow-batched Python stage, one
document at a time. Everything that works on chunk rows stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the chunkers, in characters.
RULE_SIZE, RULE_OVERLAP = 900, 150
SMALL = 280
CLAMP_SIZE, CLAMP_OVERLAP = 6000, 180
FALLBACK_SIZE = 3000
PERCENTILE = 95

_HEADING = re.compile(r"(#{1,6})\s+(.*\S)\s*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_TABLE_ROW = re.compile(r"\s*\||\s*\[표: \d+행 × \d+열\]\s*$")
_CHUNK = "strategy string, chunk_index int, text string, char_count int, section_hint string"


def paragraphs(text: str) -> list[str]:
    """Runs of lines that aren't blank, without trailing blanks."""
    found: list[list[str]] = [[]]
    for line in text.splitlines():
        if line.strip():
            found[-1].append(line.rstrip())
        elif found[-1]:
            found.append([])
    return [p for p in ("\n".join(x).strip() for x in found) if p]


def is_table(text: str) -> bool:
    rows = [x for x in text.splitlines() if x.strip()]
    return len(rows) > 1 and all(_TABLE_ROW.match(x) for x in rows)


def strides(text: str, size: int, overlap: int) -> list[str]:
    """Windows of `size` characters, each `overlap` into the one before."""
    step = max(size - overlap, 1)
    return [p for p in (text[i : i + size].strip() for i in range(0, len(text), step)) if p]


def tail(text: str, overlap: int) -> str:
    return text[-overlap:].strip() if overlap > 0 else ""


def pieces(text: str, size: int, overlap: int) -> Iterator[str]:
    """A long paragraph as packed sentences, each piece beginning with the end of the one before;
    tables stay whole, a lone sentence over the size is cut."""
    if is_table(text):
        yield text
        return
    held = ""
    for sentence in filter(None, map(str.strip, _SENTENCE.split(text))):
        if len(held) + bool(held) + len(sentence) <= size:
            held = f"{held} {sentence}" if held else sentence
        elif held:
            yield held
            held = f"{tail(held, overlap)} {sentence}".strip()
        else:
            yield from strides(sentence, size, overlap)
    if held:
        yield held


class Packer:
    """Packs the paragraphs of one document; `heading` is the one in force. A heading is a paragraph
    of its own: one with text right below it is plain text."""

    def __init__(self, size: int, overlap: int) -> None:
        self.size, self.overlap = size, overlap
        self.heading: str | None = None
        self.parts: list[str] = []
        self.hint: str | None = None
        self.done: list[tuple[str, str | None]] = []

    def close(self) -> str:
        text = "\n\n".join(self.parts)
        if text:
            self.done.append((text, self.hint))
        self.parts = []
        return text

    def open(self, *parts: str) -> None:
        self.parts, self.hint = [p for p in parts if p], self.heading

    def add(self, paragraph: str) -> None:
        if found := _HEADING.fullmatch(paragraph):
            self.close()
            self.heading = found[2]
            self.open(paragraph)
            return
        if sum(map(len, self.parts)) + 2 * len(self.parts) + len(paragraph) <= self.size:
            self.open(*self.parts, paragraph)
            return
        before = self.close()
        if before and len(paragraph) <= self.size:
            self.open(tail(before, self.overlap), paragraph)
        else:
            self.done += [(p, self.heading) for p in pieces(paragraph, self.size, self.overlap)]


def clamped(chunks: list[tuple[str, str | None]], size: int, overlap: int) -> list[tuple[str, str | None]]:
    """Chunks over `size` cut into pieces, blank ones dropped."""
    out: list[tuple[str, str | None]] = []
    for text, hint in chunks:
        text = text.strip()
        if len(text) <= size:
            out += [(text, hint)] * bool(text)
        else:
            out += [(p, hint) for p in pieces(text, size, overlap)]
    return out


def rule_chunks(text: str, size: int = RULE_SIZE, overlap: int = RULE_OVERLAP) -> list[tuple[str, str | None]]:
    """(text, section) of a document's rule-based chunks."""
    packer = Packer(size, overlap)
    for p in paragraphs(text):
        packer.add(p)
    packer.close()
    return clamped(packer.done, 2 * size, overlap)


def first_heading(text: str) -> str | None:
    return next((m[2] for line in text.splitlines() if (m := _HEADING.fullmatch(line.strip()))), None)


@lru_cache(1 << 17)
def _bucket(token: str) -> tuple[int, float]:
    d = sha256(token.encode()).digest()
    return int.from_bytes(d[:4], "big") % 128, (1 + d[5] / 255) * (-1) ** (d[4] % 2)


def _hashes(text: str) -> list[tuple[int, float]]:
    """The buckets and weights of a sentence's tokens."""
    return [_bucket(token) for token in re.findall("[0-9A-Za-z가-힣]+", text.lower())]


def _vector(hashes: Iterable[tuple[int, float]]) -> dict[int, float]:
    """The hashed embedding of sentences, as in parchment.operators.embedding."""
    found: dict[int, float] = {}
    for bucket, weight in hashes:
        found[bucket] = found.get(bucket, 0.0) + weight
    return found


def _distances(vectors: list[dict[int, float]]) -> list[float]:
    """One less the cosine of each vector and the next."""
    squares = [sum([x * x for x in v.values()]) for v in vectors]
    found = []
    for a, b, p, q in zip(vectors, vectors[1:], squares, squares[1:], strict=False):
        norm = (p * q) ** 0.5
        found.append(1 - sum([x * b.get(k, 0.0) for k, x in a.items()]) / norm if norm else 1.0)
    return found


def breakpoints(distances: list[float], percentile: float = PERCENTILE) -> list[int]:
    """Positions whose distance is over the percentile (linear interpolation) of them all."""
    if not distances:
        return []
    ordered = sorted(distances)
    at = (len(ordered) - 1) * percentile / 100
    low = int(at)
    limit = ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low)
    return [i for i, d in enumerate(distances) if d > limit]


def semantic_chunks(text: str) -> list[tuple[str, str | None]]:
    """Sentences joined up to where neighbouring ones have least in common; tables stay whole."""
    text = text.strip()
    if not text:
        return []
    if len(text) < SMALL:
        return [(text, first_heading(text))]
    # Between rows of a table stands a character that the text doesn't have, so that no sentence ends there.
    tie = next(c for c in map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0x10FFFE))) if c not in text)
    guarded, inside = [], False
    for line in text.splitlines():
        row = bool(_TABLE_ROW.match(line))
        guarded.append((tie if inside and row else "\n" if guarded else "") + line)
        inside = row
    sentences = [s for s in _SENTENCE.split("".join(guarded)) if s.strip()]
    # A sentence is compared together with its neighbours; its tokens are hashed once.
    hashes = [_hashes(x) for x in sentences]
    vectors = [_vector(chain.from_iterable(hashes[max(0, i - 1) : i + 2])) for i in range(len(sentences))]
    cuts = breakpoints(_distances(vectors))
    joined = [" ".join(sentences[a:b]).replace(tie, "\n").strip() for a, b in zip([0, *(c + 1 for c in cuts)], [*(c + 1 for c in cuts), len(sentences)], strict=True)]
    return clamped([(x, first_heading(x)) for x in joined], CLAMP_SIZE, CLAMP_OVERLAP)


def chunk(docs: DataFrame, strategy: str = "rule_based", id_col: str = "document_id", text_col: str = "markdown") -> DataFrame:
    """(document_id, strategy, chunk_index, text, char_count, section_hint) of every document.

    Strategies: rule_based, semantic. Null and blank texts have no chunks.
    """
    split = {"rule_based": rule_chunks, "semantic": semantic_chunks}[strategy]
    source = docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("t"))
    kind = source.schema["document_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                where: list[int] = []
                rows: list[tuple[int, str, str | None]] = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    found = split(text or "")
                    where += [i] * len(found)
                    rows += [(k, x, h) for k, (x, h) in enumerate(found)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(where, pa.int64())),
                        pa.array([strategy] * len(rows), pa.string()),
                        pa.array([k for k, _, _ in rows], pa.int32()),
                        pa.array([x for _, x, _ in rows], pa.string()),
                        pa.array([len(x) for _, x, _ in rows], pa.int32()),
                        pa.array([h for *_, h in rows], pa.string()),
                    ],
                    names=["document_id", "strategy", "chunk_index", "text", "char_count", "section_hint"],
                )

    return source.mapInArrow(run, f"document_id {kind}, {_CHUNK}")


def metrics(chunks: DataFrame) -> DataFrame:
    """Per document and strategy: number of chunks, total, average (2 decimals), least, most characters."""
    n = F.col("char_count")
    return chunks.groupBy("document_id", "strategy").agg(
        F.count("*").alias("chunk_count"), F.sum(n).alias("total_characters"), F.round(F.avg(n), 2).alias("average_characters"), F.min(n).alias("min_characters"), F.max(n).alias("max_characters")
    )


def compare(chunks: DataFrame, left: str = "rule_based", right: str = "semantic") -> DataFrame:
    """What the right strategy has more than the left one, per document."""
    return compare_metrics(metrics(chunks), left, right)


def compare_metrics(m: DataFrame, left: str = "rule_based", right: str = "semantic") -> DataFrame:
    """compare() of metrics that are there already."""
    pivot = m.groupBy("document_id").pivot("strategy", [left, right]).agg(F.first("chunk_count").alias("n"), F.first("average_characters").alias("avg"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return pivot.select("document_id", (zero(f"{right}_n") - zero(f"{left}_n")).alias("chunk_count_delta"), F.round(zero(f"{right}_avg") - zero(f"{left}_avg"), 2).alias("average_characters_delta"))


def hybrid(lanes: list[tuple[str, DataFrame]]) -> DataFrame:
    """All chunks of several lanes under one numbering per document, in the lanes' order.

    Each lane has (document_id, chunk_index, text); blank texts don't take part.
    """
    united = None
    for order, (lane, df) in enumerate(lanes):
        part = df.select("document_id", F.lit(order).alias("__lane"), F.lit(lane).alias("retrieval_lane"), F.col("chunk_index").alias("__index"), F.trim("text").alias("text")).where("text <> ''")
        united = part if united is None else united.unionByName(part)
    w = Window.partitionBy("document_id").orderBy("__lane", "__index", "text")
    named = united.withColumn("chunk_index", F.row_number().over(w) - 1)
    return named.select("document_id", "retrieval_lane", "chunk_index", F.concat_ws("_", F.lit("hybrid"), "retrieval_lane", F.col("__index").cast("string")).alias("chunk_id"), "text", F.length("text").alias("char_count"))
