"""Licence scans: Aho-Corasick finds notice phrases and identifier tags in one pass over a text's
words; a shunting-yard parser reads and evaluates the licence expressions: those behind the tags, and
that of the notices, joined by the words between them. What is evaluated gives a text's labels."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import map_texts, table

#: The base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Notice phrases of the method's own, as words.
PHRASES = {
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu general public license": "gpl",
    "gnu free documentation license": "gfdl",
    "proprietary and confidential": "proprietary",
    "may not be reproduced": "reserved",
}
TAG = "spdx license identifier"
#: How far each label speaks for a licence statement.
SURE, LIKELY = 0.9, 0.6
WEAK_LABELS = {"public-domain", "proprietary", "reserved"}

_TAGGED = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.:+-]*")
#: Identifiers of licences, and of exceptions that stand behind `with`. No other word is an operand.
KNOWN = re.compile(
    r"(mit|isc|0bsd|ncsa|zlib|unlicense|wtfpl|x11|postgresql|curl|openssl|ruby|php|vim|sleepycat|beerware)(-[a-z0-9.]+)*"
    r"|bsd-[0-9]-clause(-[a-z-]+)?|apache-[0-9.]+|afl-[0-9.]+|artistic-[0-9.]+(-[a-z0-9]+)?|bsl-1\.0|busl-1\.1|python-[0-9.]+|psf-[0-9.]+"
    r"|([al]?gpl|gfdl)-[0-9.]+(-only|-or-later|\+)?|(mpl|epl|cpl|cddl|eupl|osl|lppl|cecill|upl|ofl|oldap|odbl|odc-by|pddl)-[0-9.a-z]+(-[a-z-]+)?"
    r"|cc0-[0-9.]+|cc-(by|pddc)(-(nc|nd|sa))*(-[0-9.]+)?(-[a-z]+)?|ms-[pr]l|licenseref-[a-z0-9.-]+"
)
EXCEPTION = re.compile(r"[a-z0-9.+-]+-exception(-[a-z0-9.]+)*")
#: Identifiers and labels of licences that ask for little more than attribution.
PERMISSIVE = re.compile(r"mit(-.*)?|isc|0bsd|bsd(-.*)?|apache(-.*)?|zlib|unlicense|cc0(-.*)?|cc-by(-[0-9.]+)?|postgresql|python-.*|bsl-1\.0|public-domain")
#: Words that may stand between two notices that `or` joins.
_BETWEEN = frozenset(b"or and the a an either under terms of license licenses licence version v1 v2 v3 1 2 3 0 20 30 40 4 1.0 your option at any later".split())
_BINDS = {"or": 1, "and": 2, "with": 3}
#: ASCII to the letters of words: A-Z lower-case, everything else but a-z and 0-9 a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def to_postfix(text: str) -> list[str]:
    """The licence expression at the beginning of a text in postfix order (shunting-yard).

    Operands are known identifiers, behind `with` those of exceptions. The expression ends where no
    operator or operand can follow, and before an operator that a word of another kind follows; a dangling
    operator or an open parenthesis makes it empty, as does a text that doesn't begin with an expression.
    """
    return _postfix([x.lower().rstrip(".") for x in _TOKEN.findall(text)], lambda x: KNOWN.fullmatch(x) is not None)


def _postfix(tokens: list[str], known) -> list[str]:
    out: list[str] = []
    stack: list[str] = []
    operand, kind = True, known  # whether an operand is expected next, and of which kind
    for token, following in zip(tokens, [*tokens, None][1:], strict=True):
        if token == "(" and operand:
            stack.append(token)
        elif operand and token not in _BINDS and kind(token):
            out.append(token)
            operand, kind = False, known
        elif not operand and token in _BINDS:
            kind = EXCEPTION.fullmatch if token == "with" else known
            if following is not None and following != "(" and not kind(following):
                break
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif not operand and token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
    if operand or "(" in stack:
        return []
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[bool | None, set[str]]:
    """(permissive, labels) of an expression: whether permissive licences alone can satisfy it,
    and the licences it names; None if it is empty.

    `or` needs one side, `and` both; `with` grants an exception to the licence on its left and
    changes nothing else, and the exception is no licence.
    """
    stack: list[tuple[bool, set[str]]] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append((bool(PERMISSIVE.fullmatch(token)), {token}))
            continue
        (right, more), (left, names) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, names))
        else:
            stack.append((left or right if token == "or" else left and right, names | more))
    return stack[0] if stack else (None, set())


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {**PHRASES, **BASE_PHRASES}:
        found.add_word(f" {phrase} ", (phrase, PHRASES.get(phrase) or BASE_PHRASES[phrase], phrase in BASE_PHRASES))
    found.add_word(f" {TAG} ", (TAG, None, False))
    found.make_automaton()
    return found


def notices(places: list[dict], own: list[bytes]) -> list[str]:
    """The expression of a text's notices in postfix order: the longest phrases, in order, joined by
    `or` where that and words such as "the" are all that stands between two, else by `and`."""
    tokens: list[str] = []
    end = -1
    for p in sorted(places, key=lambda p: (p["first"], -len(p["phrase"].split()))):
        last = p["first"] + len(p["phrase"].split())
        if last <= end:
            continue
        if tokens:
            between = own[end : p["first"]] if p["first"] - end <= 12 else [b""]
            tokens.append("or" if b"or" in between and _BETWEEN.issuperset(between) else "and")
        tokens.append(p["label"])
        end = last
    return _postfix(tokens, lambda x: True)


def scan_text(text: str | None, phrases) -> dict:
    """The places (label, first word, base), expressions and labels of one text."""
    own = words(text)
    line = f" {b' '.join(own).decode('utf-8', 'surrogatepass')} "
    places, tagged, at, counted = [], False, 0, 0
    hits = sorted((end - len(phrase) - 1, phrase, label, base) for end, (phrase, label, base) in phrases.iter(line))
    for start, phrase, label, base in hits:
        counted += line.count(" ", at, start)
        at = start
        if label is None:
            tagged = True
            continue
        places.append({"label": label, "phrase": phrase, "first": counted, "base": base})
    found = [to_postfix(m[1]) for m in _TAGGED.finditer(text or "")] if tagged else []
    labels, expressions = {p["label"] for p in places if p["base"]}, []
    for postfix in [*found, notices(places, own)]:
        if postfix:
            permissive, names = evaluate(postfix)
            expressions.append({"postfix": " ".join(postfix), "permissive": permissive})
            labels |= names
    return {"n_words": len(own), "places": places, "expressions": expressions, "labels": sorted(labels)}


def scan(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_words, places, expressions, labels (sorted) and score of every whole text.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.
    Overlapping phrases all count. Expressions are those of the tags and then that of the notices; labels
    are the licences that these name, and those of the base phrases. The score is one minus the product
    of the doubts that the distinct labels leave. Null and empty texts have no words, places or
    labels and score zero. Repeated rows are scanned one by one; a kept column named like one that is made
    here gives way to it. Texts of any length are scanned whole; of an empty table there are no rows.
    """
    place = "struct<label:string,phrase:string,first:bigint,base:boolean>"
    expression = "struct<postfix:string,permissive:boolean>"

    def worker():
        import pyarrow as pa

        phrases = automaton()
        kinds = {
            "n_words": pa.int64(),
            "places": pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("first", pa.int64()), ("base", pa.bool_())])),
            "expressions": pa.list_(pa.struct([("postfix", pa.string()), ("permissive", pa.bool_())])),
            "labels": pa.list_(pa.string()),
        }

        def apply(texts: list) -> dict:
            rows = [scan_text(t, phrases) for t in texts]
            return {k: pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()}

        return apply

    found = map_texts(df, text_col, worker, f"n_words bigint, places array<{place}>, expressions array<{expression}>, labels array<string>", keep)
    doubt = F.aggregate("labels", F.lit(1.0), lambda a, x: a * F.when(x.isin(*WEAK_LABELS), 1 - LIKELY).otherwise(1 - SURE))
    return found.withColumn("score", F.lit(1.0) - doubt)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every row of documents; no labels: empty strings. Beside them the expressions
    in postfix order, and whether permissive licences alone can satisfy them all (none: null)."""
    base = F.filter("places", lambda p: p["base"])
    first = F.transform(base, lambda p: p["first"])
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.array_join(F.transform("expressions", lambda x: x["postfix"]), ";").alias("expressions"),
        F.when(F.size("expressions") > 0, F.forall("expressions", lambda x: x["permissive"])).alias("permissive"),
    )


QUERIES = {"op7_licenses": op7_licenses}
ORACLES: dict[str, str] = {}
