import numpy as np
import public_tokenizers
import pytest

from quire.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lat():
    return langid.lattices(PATH)


def segmentations(text, vocab, unknown):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        piece = vocab.get(text[:k], unknown if k == 1 else None)
        if piece is not None:
            for rest in segmentations(text[k:], vocab, unknown):
                yield [piece, *rest]


def test_sums_over_all_segmentations(lat):
    vocab = langid.load_pieces(PATH)
    rng = np.random.default_rng(0)
    probs = rng.random((lat.size + 2, 3))
    probs[lat.none] = 0
    probs /= probs.sum(0)
    for word in ("hello", "straße", "漢x", "łąk", "q"):
        every = list(segmentations(langid.MARK + word, vocab, lat.unknown))
        want = np.log(sum(np.prod(probs[s], axis=0) for s in every))
        assert np.allclose(lat.likelihoods([word], probs)[0], want)
        counts = np.zeros((lat.size + 2, 1))
        lat.expectations([word], np.full((1, 1), 2.0), counts)
        p = np.array([lat.size ** -float(len(s)) for s in every])
        expect = np.zeros(lat.size + 2)
        for s, share in zip(every, p / p.sum(), strict=True):
            np.add.at(expect, s, 2.0 * share)
        assert np.allclose(counts[:, 0], expect)


def test_long_words_stay_finite(lat):
    probs = np.full((lat.size + 2, 2), 1.0 / lat.size)
    probs[lat.none] = 0
    assert np.isfinite(lat.likelihoods(["ab" * 4000, "é漢" * 4000], probs)).all()
    counts = np.zeros((lat.size + 2, 1))
    lat.expectations(["ab" * 1000], np.ones((1, 1)), counts)
    assert np.isfinite(counts).all()


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, "the house", "en"), (10_001, None, "en"), (10_002, "12 !?", "en"), (10_003, "", None), (10_003, "", None)], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").unionByName(odd)
    got = langid.held_out_report(rows, PATH).collect()
    assert len(got) == rows.count()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id and r.doc_id > 10_000)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.held_out_report(df, PATH).first().lang_pred == "und"
    assert langid.held_out_report(df.limit(0), PATH).count() == 0


def test_only_letters_count(spark):
    train = [(k, "the house and the garden" if k % 2 else "das haus und der garten", "en" if k % 2 else "de") for k in range(40)]
    odd = ["½", "²", "Ⅷ", "①", "٣ 12", "_", "½²Ⅷ①"]
    df = spark.createDataFrame([*train, *((1000 + k, t, None) for k, t in enumerate(odd)), (2000, "haus²garten Ⅷ", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.held_out_report(df, PATH).collect()}
    assert all(got[1000 + k].lang_pred == "und" and got[1000 + k].score == 0 for k in range(len(odd)))
    assert got[2000].lang_pred == "de"
    assert langid.words("x²y Straße") == ["x", "y", "straße"] and langid.words("ªb") == ["ªb"]


def test_long_words_by_chunks(lat, monkeypatch):
    rng = np.random.default_rng(3)
    probs = rng.random((lat.size + 2, 3)) ** 4
    probs[lat.none] = 0
    probs /= probs.sum(0)
    word = "".join(rng.choice(list("abcdefghijklmnoprstuwzäé漢"), 700))
    want, counts, got = lat.likelihoods([word], probs)[0], np.zeros((lat.size + 2, 1)), np.zeros((lat.size + 2, 1))
    lat.expectations([word], np.ones((1, 1)), counts)
    for chunk in (7, 64, 5_000):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert np.allclose(lat.long_likelihood(word, probs), want)
        got[:] = 0
        lat.long_expectations(word, np.ones(1), got)
        assert np.allclose(got, counts)


def test_a_word_of_a_million_letters(lat):
    import tracemalloc

    probs = np.full((lat.size + 2, 2), 1.0 / lat.size)
    probs[lat.none] = 0
    tracemalloc.start()
    assert np.isfinite(lat.likelihoods(["thehouse" * 125_000], probs)).all()
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()
