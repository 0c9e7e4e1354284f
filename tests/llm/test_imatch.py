import hashlib
import random
import re

import pytest
from oracle import assert_same

from quire.llm import imatch
from quire.llm.queries import ORACLE_SQL, QUERIES

WORDS = [a + b + c + d for a in "bdfgklmnprstvz" for b in "aeiou" for c in ("n", "s", "t", "r", "ki", "mo", "lu") for d in ("", *"aeioubdfglm")]


def table(n=300):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(30, 400))) for _ in range(n)]
    texts[7], texts[8], texts[9], texts[50] = None, "", "Ünï — code", texts[49]
    return [(3 * k, t, 9) for k, t in enumerate(texts)]


def brute(rows):
    """{doc_id: (fingerprint, edited fingerprint, likeness of both, of the next one's)}, word by word."""
    texts = [t or "" for _, t, *_ in rows]
    split = lambda t: set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t)))
    df = {}
    for t in texts:
        for w in split(t):
            df[w] = df.get(w, 0) + 1
    lex = {w for w, n in df.items() if n > 1 and 0.0005 * len(texts) <= n <= 0.05 * len(texts)}

    def mark(t):
        found = sorted(split(t) & lex)
        if not found:
            return hashlib.md5(t.encode()).hexdigest()[:16] + "...." * 144
        out = hashlib.md5(" ".join(found).encode()).hexdigest()[:16]
        for level in (2, 4, 6, 8, 10, 12):
            for seed in range(24):
                some = [w for w in found if bin(int(hashlib.md5(f"{seed} {w}".encode()).hexdigest()[:13], 16))[2:].zfill(52).startswith("0" * level)]
                out += hashlib.md5(" ".join(some).encode()).hexdigest()[:4] if some else "...."
        return out

    def like(a, b):
        if a[:16] == b[:16]:
            return 1.0
        cut = lambda m: [[m[16 + 96 * k + 4 * s :][:4] for s in range(24)] for k in range(6)]
        best = 0.0
        for k, (x, y) in enumerate(zip(cut(a), cut(b), strict=True)):
            some = [(p, q) for p, q in zip(x, y, strict=True) if {p, q} != {"...."}]
            if k and len(some) < 12:
                break
            best = sum(p == q for p, q in some) / len(some) if some else 0.0
        return best

    marks, out = [mark(t) for t in texts], {}
    for k, (i, *_) in enumerate(rows):
        n, following = len(texts[k]) // 4, (k + 1) % len(rows)
        e = mark(texts[k][: len(texts[k]) - n] + texts[following][:n])
        out[i] = (marks[k], e, like(marks[k], e), like(marks[k], marks[following]))
    return out


@pytest.mark.parametrize("size", [4096, 16])
def test_report_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(imatch, "RANGE_ROWS", size)
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string, range int").repartition(5)
    got = {r.doc_id: r for r in imatch.edit_report(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for k, (i, t, _) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == want[i]
    assert got[147].fingerprint == got[150].fingerprint and got[147].near_next == 1
    normal = [r for r in got.values() if r.n_chars > 500 and r.doc_id != 147]
    assert sum(r.near_edited for r in normal) / len(normal) > 3 * sum(r.near_next for r in normal) / len(normal)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(QUERIES["op3_imatch"](spark, sf), ORACLE_SQL["op3_imatch"], sf)


def test_ties_nulls_and_one_row(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 2)
    df = spark.createDataFrame([(1, "b b c", 0), (1, "a", 0), (1, "a", 0), (None, None, 0), (None, "n", 0), (5_000_000, "far", 0)], "doc_id long, text string, row int")
    got = imatch.edit_report(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "5000000", "None", "None"]
    seen = [(r.doc_id, r.text, r.tail) for r in imatch.in_ranges(df).collect()]
    assert sum(not tail for *_, tail in seen) == 6
    one = imatch.edit_report(df.where("doc_id > 9")).first()
    assert one.near_next == 1.0
    assert imatch.edit_report(df.limit(0)).count() == 0


def test_lexicon_is_a_band(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"the {'rare' if k < 2 else 'x'} W{k % 10}") for k in range(100)], "doc_id long, text string")
    assert imatch.lexicon(df, band=(0.05, 0.2)) == sorted(f"w{k}" for k in range(10))
    monkeypatch.setattr(imatch, "LEXICON", 9)
    assert sorted(r.term for r in imatch.lexicon(df, band=(0.05, 0.2)).collect()) == sorted(f"w{k}" for k in range(10))


def test_one_word_more_changes_little():
    """Whether a term is in the lexicon changes that term only, however many terms a text has in it."""
    common = [f"c{k}" for k in range(40)]
    for n in (3, 4, 5, 12):
        lex = imatch.Lexicon([f"t{k}" for k in range(60)])
        a, b = " ".join([*common, *(f"t{k}" for k in range(n))]), " ".join([*common, *(f"t{k}" for k in range(n + 1))])
        assert imatch.likeness(lex.mark(a), lex.mark(b)) > 0.4


def test_long_text_and_fingerprint_column(spark):
    df = spark.createDataFrame([(1, "a b c", "old"), (2, "a b " * 400_000, "old")], "doc_id long, text string, fingerprint string")
    out = imatch.fingerprints(df, imatch.lexicon(df, band=(0.0, 1.0))).collect()
    assert all(r.fingerprint != "old" for r in out) and {r.doc_id: len(r.text) for r in out} == {1: 5, 2: 1_600_000}


def test_a_lexicon_that_is_joined(spark, monkeypatch):
    """Beyond LEXICON terms everything is as before."""
    df = spark.createDataFrame([*table(80), (None, "a b c", 9), (3, "again " * 3, 9), (3, "again " * 3, 9)], "doc_id long, text string, n int").repartition(3)
    reports = [sorted(map(str, imatch.edit_report(df).collect()))]
    marks = [sorted(map(str, imatch.fingerprints(df, imatch.lexicon(df)).collect()))]
    monkeypatch.setattr(imatch, "LEXICON", 3)
    reports.append(sorted(map(str, imatch.edit_report(df).collect())))
    marks.append(sorted(map(str, imatch.fingerprints(df, imatch.lexicon(df)).collect())))
    assert reports[0] == reports[1] and len(reports[0]) == 83
    assert marks[0] == marks[1]
    assert imatch.edit_report(df.limit(0)).count() == 0
