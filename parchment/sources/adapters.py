"""Places where an outside model or reader is plugged in, with defaults that need none."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, TypeVar

T = TypeVar("T")


class Embedder(Protocol):
    """Makes vectors of texts."""

    model_name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Answerer(Protocol):
    """Answers a question from numbered evidence; returns JSON text."""

    def answer(self, question: str, evidence: list[str]) -> str: ...


class Reader(Protocol):
    """Reads the bytes of one document into (page number, text) pairs."""

    def pages(self, content: bytes) -> list[tuple[int, str]]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """The offline embedder; its name says its size, as vectors of different sizes don't mix."""

    dimensions: int = 128

    @property
    def model_name(self) -> str:
        return f"local-deterministic-v1-{self.dimensions}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        from hashlib import sha256

        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for token in re.findall("[0-9A-Za-z가-힣]+", text.lower()):
                d = sha256(token.encode()).digest()
                v[int.from_bytes(d[:4], "big") % self.dimensions] += (1 + d[5] / 255) * (1 - 2 * (d[4] % 2))
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out


@dataclass(frozen=True)
class Options:
    """Options of an ingest run."""

    markdown_mode: str = "both"
    qa_mode: str = "hybrid"
    top_k: int = 5
    embedder: Embedder = field(default_factory=HashEmbedder)
    answerer: Answerer | None = None


RETRYABLE = frozenset([408, 409, 425, 429, 500, 502, 503, 504])


def wait_before(attempt: int, base: float, most: float, asked: float | None = None, draw: Callable[[], float] = random.random) -> float:
    """Seconds to wait: what the server asks for, else anything up to a limit that doubles each time."""
    return asked if asked is not None else draw() * min(most, base * 2**attempt)


def with_retries(call: Callable[[], T], retries: int = 3, base: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """call(), again after time-outs, lost connections and answers that say to try again."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:
            code = getattr(e, "code", getattr(e, "status_code", None))
            passing = isinstance(e, (TimeoutError, ConnectionError)) or code in RETRYABLE or (isinstance(e, OSError) and code is None)
            if not passing or attempt == retries:
                raise
            headers = getattr(e, "headers", None) or {}
            asked = headers.get("Retry-After")
            sleep(wait_before(attempt, base, most, float(asked) if asked and re.fullmatch(r"\d+(\.\d+)?", str(asked)) else None))
    raise AssertionError("not reached")


def json_answer(text: str, default: str = "summary_text") -> dict:
    """The JSON object of a model's answer: all of it, else the first {...} in it, else the text itself."""
    for candidate in (text, *re.findall(r"\{.*\}", text, re.DOTALL)):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return {default: text.strip()}


def citation_marks(answer: str, numbers: dict[int, int]) -> str:
    """An answer with its [n] marks renumbered, and those without a citation taken out."""
    kept = re.sub(r"\s*\[(\d+)\]", lambda m: f" [{numbers[int(m[1])]}]" if int(m[1]) in numbers else "", answer)
    return re.sub(r"\s+([.,;])", r"\1", kept).strip()
