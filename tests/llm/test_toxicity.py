import random

from quire.llm import toxicity

BAD = ["moron", "idiot", "stupid", "trash"]
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ro", "si", "ta") for b in ("ban", "den", "fol", "gur", "kim", "lor", "mes", "pat", "ran", "sel")]


def corpus(n=600):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(WORDS, k=rng.randint(5, 80))
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        docs.append((i, " ".join(w), "en"))
        labels.append((i, toxic))
    return docs, labels


def tables(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (None, "idiot", "en"), (9000, None, "en"), (9001, "", "en")], "doc_id long, text string, score string")
    return d, spark.createDataFrame([*labels, (None, 1), (9000, None), (5, labels[5][1])], "doc_id long, toxic int")


def test_held_out(spark):
    d, l = tables(spark)
    got = {r.doc_id: r for r in toxicity.held_out_report(d, l).collect()}
    truth = {r.doc_id: r.toxic for r in l.collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 9000]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    assert not got[None].held_out and got[9000].score == got[9001].score and got[9000].predicted == 0


def test_deobfuscation(spark):
    d, l = tables(spark)
    model = toxicity.fit(d, l, held=None)
    for text in ("you m0r0n", "what an 1d10t!", "stuuuupid", "s t u p i d", "t-r-a-s-h", "(trash)", "$tupid", "you i d i o t."):
        assert model.score(text) >= toxicity.THRESHOLD, text
    for text in ("baban 12 kefol", "lomes 2024-01-01 a b c d e", "", None, "555-3280 ronden", "1. 2. 3. 4.", "x" * 100_000, "a " * 20_000):
        assert model.score(text) < toxicity.THRESHOLD, text


def test_without_labels(spark):
    d, l = tables(spark)
    assert {r.score < 0.01 for r in toxicity.held_out_report(d, l.limit(0)).collect()} == {True}
    assert toxicity.held_out_report(d.limit(0), l).count() == 0
    out = toxicity.score(d, toxicity.fit(d, l.where("toxic = 1"), held=None))
    assert out.columns == ["doc_id", "text", "score"] and out.where("score > 0.9").count() == d.count()


def test_held_labels_are_not_learned(spark):
    d, l = tables(spark)
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = l.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: sorted((str(r.doc_id), r.score) for r in toxicity.held_out_report(d, x).collect())
    assert score(l) == score(flipped)


def restorer():
    grams = toxicity.trigrams({w: 20 for w in [*BAD, *WORDS, "scum", "well", "he", "is", "really"]})
    return toxicity.Restorer(toxicity.CharModel(dict(zip(grams.column(0).to_pylist(), grams.column(1).to_pylist(), strict=True))))


def test_spaced_words_are_found_wherever_they_stand():
    forms = ['he is s c u m, really', "s c u m.", '"m o r o n"', '"m.o.r.o.n"', "well\u2014m.o.r.o.n", "-m-o-r-o-n-", "[m_o_r_o_n]", "m*o*r*o*n,", "s.c.u.m", "well s~c~u~m, is", "[s c u m]"]
    forms += ["m    o    r    o    n", "well m\to\tr\to\tn", "s\nc\nu\nm", "m/o/r/o/n", "m, o, r, o, n", "s·c·u·m", "m o  r   o n", "m -- o -- r -- o -- n", "s,c,u,m", "m____o____r____o____n", "s\u2003c\u2003u\u2003m"]
    restore = restorer()
    for text in forms:
        assert {"scum", "moron"} & restore.words(text), text
    rng = random.Random(8)
    signs = "amo1!*._-~,\"( \u2014\u00e9\n/"
    for text in [*forms, *("".join(rng.choices(signs, [3, 3, 3, 1, 1, 1, 3, 1, 2, 1, 1, 1, 1, 9, 1, 1, 2, 2], k=rng.randint(1, 30))) for _ in range(20_000))]:
        assert restore.words(text) == {w for _, read in restore.pieces(text) for w in read}, text


def test_long_tokens_are_restored():
    restore = restorer()
    for token in ("m" + "o" * 60 + "ron", "m" + "o" * 700 + "ron", "m" + "0" * 60 + "r0n", "m" + "0" * 500 + "r" * 300 + "0n", "$" * 400 + "tup1d", "m0r0n/" * 80 + "1d10t"):
        assert {"moron", "stupid"} & restore.words(token), token
    assert {"moron", "idiot"} <= restore.words("m0r0n-" * 80 + "1d10t")
    assert len(toxicity.lattice("m" + "0" * 500 + "r0n", False)) == 5
    assert len(restore.words("ab1c" * 50_000)) >= 1


def char_model():
    grams = {}
    words = {w: 3 for w in WORDS} | {w: 40 for w in BAD}
    batch = toxicity.trigrams(words)
    for g, c in zip(batch["gram"].to_pylist(), batch["count"].to_pylist(), strict=True):
        grams[g] = grams.get(g, 0) + c
    return toxicity.CharModel(grams)


def test_viterbi_finds_the_best_of_all_readings():
    """Every path through a lattice is scored by itself."""
    from itertools import product

    model = char_model()

    def cost(letters):
        s, at = 0.0, "  "
        for x in letters:
            y = toxicity.shape(x)
            if y == " " and at[1] == " ":
                return None
            s += model.log(at + y)
            at = at[1] + y if y != " " else "  "
        return s + (model.log(at + " ") if at[1] != " " else 0.0)

    for token, spaced in (("m0r0n", False), ("1d10t", False), ("stt*pid", False), ("tr4sh!", False), ("mmoorrron", False), ("moron", True), ("1d1", True)):
        paths = []
        for path in product(*toxicity.lattice(token, spaced)):
            s = cost("".join(p[0] for p in path))
            if s is not None:
                paths.append((s - sum(p[1] for p in path), "".join(p[0] for p in path)))
        best = max(paths)[0]
        got = toxicity.decode(token, model, spaced)
        assert any(abs(s - best) < 1e-9 and text == got for s, text in paths), token


def test_words_are_those_of_pieces():
    restore = toxicity.Restorer(char_model())
    cases = {
        '"m.o.r.o.n"': "moron", '"s-t-u-p-i-d"': "stupid", '"s t u p i d"': "stupid", "(i d i o t)": "idiot", "(m.o.r.o.n)": "moron", "[m0r0n]": "moron", "i.d.i.o.t!!": "idiot", "m  o  r  o  n": "moron",
        "well—m.o.r.o.n": "moron", "-m-o-r-o-n-": "moron", "m" + "o" * 300 + "ron": "moron", "he is t r a s h, really": "trash",
    }
    for text, word in cases.items():
        words = restore.words(text)
        assert word in words, text
        assert words == {w for _, read in restore.pieces(text) for w in read}, text
    assert any(w.startswith("moron") and len(w) == 75 for w in restore.words("m0r0n" + "abcdefg" * 10))


def test_repeated_documents_and_labels_of_absent_ones(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame([*docs, *docs[:80]], "doc_id long, text string, lang string")
    l = spark.createDataFrame([*labels, *((70_000 + k, 1) for k in range(500))], "doc_id long, toxic int")
    model = toxicity.fit(d, l, held=None)
    assert {w for w in BAD if w in model.weights} == set(BAD)
    assert sum((model.score(t) >= toxicity.THRESHOLD) == bool(y) for (_, t, _), (_, y) in zip(docs, labels, strict=True)) >= 0.99 * len(docs)


def test_all_telling_features_are_kept(spark):
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    texts = [" ".join(a + j + b for a in start for j in "abcdefghij" for b in names) for start in ("xv", "qz")]
    rows = [(k, texts[k % 2]) for k in range(208)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    l = spark.createDataFrame([(k, k % 2) for k in range(208)], "doc_id long, toxic int")
    assert len(toxicity.fit(d, l, held=None).weights) > 2_000
