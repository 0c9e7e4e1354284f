import re

import pytest
from oracle import assert_same

from quire.llm import licenses
from quire.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

TEXTS = [
    "Licensed under the Apache License, Version 2.0. MIT license MIT license; GNU General Public License v3.",
    "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy", "CC BY-SA 4.0 cc by cc by",
    "under GPLv2 or LGPL 2.1", "same terms as Perl itself", None, "", "É license ü MIT  LICENSE", "mit licenses are no mit license", "no such thing " * 2000 + "mit license",
]


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_places(spark):
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(TEXTS)] + [(None, "mit license", 7), (0, TEXTS[0], 7)], "doc_id long, text string, n_words int")
    got = [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.report(df).collect()]
    assert got == [brute(t) for t in [*TEXTS, "mit license", TEXTS[0]]]


def test_labels_and_suppression(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.report(df).collect()}
    assert got[0]["labels"] == "apache,apache-2.0,gpl,gpl-3.0,mit"
    assert got[1]["labels"] == "mit" and got[1].score == 1.0
    assert got[3]["labels"] == "cc-by,cc-by-sa"
    assert got[4]["labels"] == "gpl-2.0,lgpl-2.1"
    assert got[6]["labels"] == got[7]["labels"] == "" and got[6].score == 0.0
    spans = {r.doc_id: r.detections for r in licenses.scan(df).collect()}
    for d in spans[0]:
        assert not any(e is not d and e.start <= d.start and e.end >= d.end and e.priority <= d.priority for e in spans[0])


def test_rules_are_many_and_gated():
    rules = licenses.rules()
    assert len(rules) > 300
    assert all(r["keys"] and r["re"].startswith(" ") and r["re"].endswith(" ") for r in rules)


def test_empty_table(spark):
    assert licenses.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_sql(spark, sf):
    assert_same(QUERIES["op1_license_scan"](spark, sf), ORACLE_SQL["op1_license_scan"], sf)


@pytest.mark.parametrize("text, label", [("SPDX-License-Identifier: GPL-1.0-only", "gpl-1.0"), ("SPDX-License-Identifier: GPL", "gpl"), ("the zero-clause BSD license", "0bsd")])
def test_short_identifiers(spark, text, label):
    r = licenses.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert label in r["labels"].split(",") and r.score > 0


def test_no_gate_stops_a_rules_own_match():
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    def check(rule):
        @settings(max_examples=25, deadline=None, database=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(re.compile(rule["re"]), fullmatch=True))
        def passes(s):
            if re.fullmatch(r"(?: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ )+", s):  # in the normal form
                assert any(k in s for k in rule["keys"]) and any(r in s for r in licenses.ROOTS), (rule["label"], s)

        passes()

    for rule in licenses.rules():
        check(rule)


def test_many_places_in_one_text(spark):
    """Many blocks of detections; more places than a fold that copies could take."""
    n = 16_000
    df = spark.createDataFrame([(1, "mit license " * n), (2, "gpl-2.0 apache license x " * 700)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.report(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (n, 0, 2 * n - 2)
    small = {r.doc_id: r for r in licenses.scan(df.where("doc_id = 2")).collect()}[2]
    starts = [d.start for d in small.detections if d.label == "apache"]
    assert starts == [3 + 6 * k for k in range(700)] or len(starts) == 700
    assert [d.start for d in small.detections] == sorted(d.start for d in small.detections)


def test_clashing_columns_of_scan(spark):
    df = spark.createDataFrame([(1, "mit license", "x", 5, "y", "z")], "doc_id long, text string, detections string, n_words int, _norm string, base_labels string")
    r = licenses.scan(df).first()
    assert (r.n_words, r.n_base, r.base_labels) == (2, 1, ["mit"])
