import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from quire.llm import alignment
from quire.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def encodings(texts):
    """(a ids, a ends, b ids, b ends) of each text by the libraries; None where a side does not spell out the text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = alignment._byte_level()
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        e, p = a.encode(" " + t, add_special_tokens=False), b.encode(t)
        ab = [bytes(byte[c] for c in x) for x in e.tokens]
        bb = [bytes([int(x[3:5], 16)]) if b.is_byte(i) else x.replace("▁", " ").encode() for i, x in ((i, b.id_to_piece(i)) for i in p)]
        raw = (" " + t).encode()
        out.append((e.ids, list(np.cumsum([*map(len, ab)])), p, list(np.cumsum([*map(len, bb)]))) if b"".join(ab) == raw == b"".join(bb) else None)
    return out


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha, string) by the contract's words."""
    coded = encodings(texts)
    links = [[(x, y) for x, p in zip(c[0], c[1], strict=True) for y, q in zip(c[2], c[3], strict=True) if p == q] if c and len(c[0]) < 3000 else fast_links(c) for c in coded]
    count = Counter(p for ls in links for p in ls)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for c, ls in zip(coded, links, strict=True):
        if not c:
            out.append((0, 0, 0, 0, 0, 0, "", ""))
            continue
        cuts = sorted(set(c[1]) & set(c[3]))
        parts, i, j = [], 0, 0
        for cut in cuts:
            x, y = [], []
            while i < len(c[0]) and c[1][i] <= cut:
                x.append(str(c[0][i]))
                i += 1
            while j < len(c[2]) and c[3][j] <= cut:
                y.append(str(c[2][j]))
                j += 1
            parts.append(",".join(x) + "|" + ",".join(y))
        s = ";".join(parts)
        out.append((len(c[0]), len(c[2]), len(cuts), len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(s.encode()).hexdigest(), s))
    return out


def fast_links(c):
    if not c:
        return []
    at = dict(zip(c[3], c[2], strict=True))
    return [(x, at[p]) for x, p in zip(c[0], c[1], strict=True) if p in at]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows(df):
    return [(r.doc_id, *(r[n] for n in NAMES)) for r in df.collect()]


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, *x[:-1]) for (i, _), x in zip(docs, brute([t for _, t in docs]), strict=True)]
    assert sorted(rows(QUERIES["op12_token_alignment"](spark, SF))) == sorted(want)


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b   c\n\n d\t e", "x\r\ny;\r\n z;\r w;\r", "a\xa0 b\xa0  c \xa0d", "\x0b\x0c\x85  　  x",
    "<|endoftext|> <s>a</s> <unk> <0x0A>", "a▁b", "中文テスト ภาษาไทย é é ﬁ", "\U0001f600\U0001f600 ok", "\x00\x01\x1c\x1d b", "don't we'll 'S", "z" * 3000, "ab12 " * 900, "   \n  ", "{\r\n\t}\r",
]


def test_odd_texts(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    want = brute(ODD)
    assert sorted(rows(alignment.digests(df, A, B))) == [(i, *x[:-1]) for i, x in enumerate(want)]
    got = {r.doc_id: r.groups for r in alignment.groups(df.withColumn("end", F.lit(1)), A, B).collect()}
    for i, x in enumerate(want):
        assert ";".join(",".join(map(str, g.a_ids)) + "|" + ",".join(map(str, g.b_ids)) for g in got[i]) == x[-1]
        if got[i]:
            assert got[i][-1].end == len(ODD[i].encode()) + 1
            assert [g.end for g in got[i]] == sorted({g.end for g in got[i]})


def test_rows_and_columns(spark):
    data = [(1, "a b", 0), (1, "a b", 0), (None, "c", 0), (None, None, 0), (2, "long " * 3000, 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, block int").withColumns({"pairs": F.lit(1), "id": F.lit("x"), "n_a": F.lit(1)}).repartition(3)
    want = [(d[0], *x[:-1]) for d, x in zip(data, brute([d[1] for d in data]), strict=True)]
    assert sorted(rows(alignment.digests(df, A, B)), key=str) == sorted(want, key=str)
    assert alignment.digests(df.limit(0), A, B).count() == 0
    assert alignment.digests(df.where("text IS NULL"), A, B).collect()[0].n_links == 0
    assert alignment.groups(df.limit(0), A, B).count() == 0


def test_gaps_against_overlaps():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        a, b = (np.sort(np.r_[rng.choice(np.arange(1, n), rng.integers(0, n), False), n]) if n > 1 else np.array([1]) for _ in range(2))
        assert np.flatnonzero(alignment.unspanned(a, b)).tolist() == [k for k, e in enumerate(b) if e in set(a.tolist())]


def test_units_are_forgotten(monkeypatch):
    monkeypatch.setattr(alignment, "UNITS", 5)
    units = alignment.Units(A, B)
    texts = ["a b c d", "e f g h i j", "a b", None, "▁"]
    for _ in range(2):
        for t in texts:
            s = alignment.Slice(units, [t, t])
            assert [x.decode() for x in s.spelt()] == [x[-1] for x in brute([t, t])]


def test_the_unit_pattern_loses_nothing():
    for t in ODD:
        assert "".join(alignment.UNIT.findall(" " + (t or ""))) == " " + (t or "")
