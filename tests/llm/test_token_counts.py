import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import token_counts
from quire.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def by_library(texts, path=PATH):
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_query_against_the_library(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((i, len(t.encode()), n, n > 2048) for (i, t), n in zip(docs, by_library([t for _, t in docs]), strict=True))
    got = sorted(tuple(r) for r in QUERIES["op13_token_counts"](spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    assert got == want


ODD = [
    "", " ", "\n\t ", "a", "A  b c\u0085d\x1ce f​g", "<|startoftext|>Hello<|endoftext|> x<|endoftext|>", "<|STARTOFTEXT|>", "É é ́x", "don't DON'T we'll 'sx",
    "12ab3 ²½", "İstanbul ΣΣ σΣ", "中文 ภาษา \U0001f600\U0001f600", "x" * 5000, "ab " * 4000, "!?" * 3000, "\x00\x01 ﻿", "trailing \n",
]


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.counts(df, PATH).collect()}
    assert [got[i] for i in range(len(ODD))] == by_library(ODD)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_tokenizers_that_keep_white_space(spark, name):
    path = public_tokenizers.path(name)
    texts = ["a b", "a b", "a  b", "word", "", " ", "x y\n\n  z", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.counts(df, path).collect()}
    assert [got[i] for i in range(len(texts))] == by_library(texts, path)


def test_normalised_content(spark):
    blanks = "".join(map(chr, token_counts.WHITE_SPACE))
    texts = ["a b", " a  b\n", "a\tb", "a \u2003 b", f"{blanks}a{blanks}b{blanks}", "a\u00a0b", "a\n\n b"]
    df = spark.createDataFrame([(t,) for t in [*texts, "ab", "", None, " \n"]], "t string")
    assert [r.n for r in df.select(token_counts.normalised(F.col("t"), PATH).alias("n")).collect()] == ["a b"] * len(texts) + ["ab", "", "", ""]


def test_rows_and_columns(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "a  b ", "x"), (1, "c", "x"), (None, "c", "x"), (None, None, "x"), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").withColumn("n_tokens", F.lit("z"))
    want = [(1, 3, 2, False), (1, 3, 2, False), (1, 5, 2, False), (1, 1, 1, False), (None, 1, 1, False), (None, 0, 0, False), (2, 0, 0, False)]
    assert sorted((tuple(r) for r in token_counts.counts(df, PATH).collect()), key=str) == sorted(want, key=str)
    assert token_counts.counts(df.limit(0), PATH).count() == 0


def test_only_misses_are_encoded(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    asked = []
    real = token_counts.encoded

    def spy(texts, path):
        asked.append(sorted(r.text for r in texts.collect()))
        return real(texts, path)

    monkeypatch.setattr(token_counts, "encoded", spy)
    df = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c")], "doc_id long, text string")
    token_counts.counts(df, PATH, cache).collect()
    more = df.unionByName(spark.createDataFrame([(4, " c "), (5, "d e f"), (6, "d e f")], "doc_id long, text string"))
    got = {r.doc_id: r.n_tokens for r in token_counts.counts(more, PATH, cache).collect()}
    assert asked == [["a b", "c"], ["d e f"]]
    assert got == {1: 2, 2: 2, 3: 1, 4: 1, 5: 3, 6: 3}
    # Another tokenizer's counts are its own; the cache's stored counts are what is used.
    token_counts.counts(df, public_tokenizers.path("byte_bpe_50k.json"), cache)
    assert asked[-1] == ["a  b", "a b", "c"]
    held = spark.read.parquet(cache)
    assert held.select("version").distinct().count() == 2 and held.count() == 6
    held.where(F.col("n_tokens") == 3).withColumn("n_tokens", F.lit(1).cast("long")).write.mode("append").partitionBy("version").parquet(cache)
    assert {r.n_tokens for r in token_counts.counts(more.where("doc_id >= 5"), PATH, cache).collect()} == {1}


def test_a_hot_digest_is_split(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    got = token_counts.counts(df, PATH)
    assert got.count() == 2000
    assert got.where("doc_id % 3 = 0").select("n_tokens").distinct().collect()[0][0] == 2


@pytest.mark.parametrize("path", [PATH])
def test_words_are_forgotten(path, monkeypatch):
    monkeypatch.setattr(token_counts, "WORDS", 3)
    counter = token_counts.WordCounts(path)
    texts = ["a b c", "c d e f g", "a", "long" * 60 + " a"]
    assert [counter.total(t) for t in texts] == by_library(texts)
    assert len(counter.known) <= 5
