"""Licence scans against brute force, and the expression parser."""

import re

import pytest

from parchment.llm import licenses

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    w = WORD.findall(lower(text))
    places = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = licenses.op7_licenses(spark, DATA).collect()
    assert len(got) == len(docs) and sum(r.n_base for r in got) > 0
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_query_labels_and_scores_against_brute_force(spark):
    """All phrases by comparing words, without those within longer ones but for the base; each label's
    doubt is the rest of its certainty."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    phrases = {p: (label, False) for p, label in licenses.PHRASES.items()} | {p: (label, True) for p, label in licenses.BASE_PHRASES.items()}
    found = 0
    for r in licenses.op7_licenses(spark, DATA).collect():
        w = WORD.findall(lower(docs[r.doc_id]))
        places = [(i, i + len(p.split()), *phrases[p]) for p in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        longest = [x for x in places if not any(o[0] <= x[0] and x[1] <= o[1] and o[:2] != x[:2] for o in places)]
        labels = {x[2] for x in longest} | {x[2] for x in places if x[3]}
        doubt = 1.0
        for x in labels:
            doubt *= 1 - (licenses.LIKELY if x in licenses.WEAK_LABELS else licenses.SURE)
        assert r.labels == ",".join(sorted(labels)) and r.score == pytest.approx(1 - doubt)
        assert (r.permissive is None) == (not places)
        found += bool(labels)
    assert found > 0


@pytest.mark.parametrize(
    ("text", "postfix", "permissive", "names"),
    [
        ("MIT", "mit", True, "mit"),
        ("GPL-3.0-only OR Apache-2.0 AND BSD-3-Clause", "gpl-3.0-only apache-2.0 bsd-3-clause and or", True, "apache-2.0 bsd-3-clause gpl-3.0-only"),
        ("(MIT OR Apache-2.0) AND GPL-2.0-only */", "mit apache-2.0 or gpl-2.0-only and", False, "apache-2.0 gpl-2.0-only mit"),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0 or MIT.", "gpl-2.0-or-later classpath-exception-2.0 with mit or", True, "gpl-2.0-or-later mit"),
        ("MIT AND", "", None, ""),
        ("(MIT", "", None, ""),
        (") MIT", "", None, ""),
        ("", "", None, ""),
        ("MIT this is prose", "mit", True, "mit"),
        (" AND ".join(["(MIT OR ISC)"] * 40), " ".join(["mit isc or", *["mit isc or and"] * 39]), True, "isc mit"),
    ],
)
def test_expressions(text, postfix, permissive, names):
    found = licenses.to_postfix(text)
    assert " ".join(found) == postfix
    got, labels = licenses.evaluate(found)
    assert got is permissive and " ".join(sorted(labels)) == names


def test_places_nulls_repeats_and_extra_columns(spark):
    texts = ["CC-BY cc by CC,BY", None, "", "All Rights\nreserved. GENERAL public-license", "x" * 90_000 + " cc by", "école cc by-nc 4.0", "// SPDX-License-Identifier: MIT OR (Apache-2.0 AND ISC)\ncode", "accc by cc byx"]
    df = spark.createDataFrame([(None if i == 1 else i // 2, t, "z") for i, t in enumerate(texts * 2)], "doc_id bigint, text string, labels string")
    got = licenses.scan(df, keep=("doc_id", "text")).collect()
    assert len(got) == len(texts) * 2
    for r in got:
        own = [p.first for p in r.places if p.base]
        assert (r.n_words, len(own), min(own, default=None), max(own, default=None)) == brute(r.text)[:4]
    by = {r.text: r for r in got}
    assert by[texts[6]].labels == ["apache-2.0", "isc", "mit"] and by[texts[6]].expressions[0].permissive
    assert by[texts[5]].labels == ["cc-by", "cc-by-nc"] and by[texts[7]].labels == [] and by[None].score == 0
    assert licenses.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "postfix"),
    [
        ("MIT or see LICENSE", "mit"),
        ("MIT and some other text", "mit"),
        ("see file", ""),
        ("mit with some changes", "mit"),
        ("GPL-2.0+ OR LicenseRef-own-1", "gpl-2.0+ licenseref-own-1 or"),
        ("CC-BY-SA-4.0", "cc-by-sa-4.0"),
    ],
)
def test_prose_is_no_licence(text, postfix):
    assert " ".join(licenses.to_postfix(text)) == postfix


def test_notices_are_an_expression_that_is_evaluated():
    phrases = licenses.automaton()
    cases = {
        "Licensed under the MIT license or the Apache License, version 2.0": ("mit apache or", True, ["apache", "mit"]),
        "MIT license, or at your option any later GNU General Public License": ("mit gpl or", True, ["gpl", "mit"]),
        "MIT license for code. All rights reserved for pictures.": ("mit reserved and", False, ["mit", "reserved"]),
        "cc by-sa 4.0": ("cc-by-sa", False, ["cc-by", "cc-by-sa"]),
        "no notice": (None, None, []),
    }
    for text, (postfix, permissive, labels) in cases.items():
        got = licenses.scan_text(text, phrases)
        found = got["expressions"][0] if got["expressions"] else {"postfix": None, "permissive": None}
        assert (found["postfix"], found["permissive"], got["labels"]) == (postfix, permissive, labels), text
