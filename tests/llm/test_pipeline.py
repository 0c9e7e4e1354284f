import corpus_pipeline as cp
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_probminhash import brute as classes
from test_rlz import brute as cut

from quire.llm import bpe, mixing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in cp.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
        seen[-1].count()
    clean, single, short, mixed, coded = seen[1:]
    for df in seen[1:-1]:
        assert df.schema.fieldNames() == docs.schema.fieldNames()
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"), held=None)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if model.score(r.text) < toxicity.THRESHOLD}
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert {r.doc_id for r in single.collect()} == set(classes(rows).values())
    want = cut([(r.doc_id, r.text) for r in single.collect()])
    for r in short.collect():
        assert r.text.encode().split() == want[r.doc_id] and r.n_chars == len(r.text)
    taken = {r.doc_id: r.taken for r in mixing.taken(short).collect()}
    size = F.regexp_count("text", F.lit(mixing.WORD))
    got = {r.doc_id: r.s for r in mixed.groupBy("doc_id").agg(F.sum(size).alias("s")).collect()}
    assert got == {i: n for i, n in taken.items() if n} and mixed.count() > 0
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert sorted((r.doc_id, tuple(r.token_ids)) for r in coded.collect()) == sorted((r.doc_id, tuple(enc.encode_ordinary(r.text))) for r in mixed.collect())


def test_run(spark):
    assert cp.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Null ids, repeated rows, null and empty texts, more columns."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text, "a", 1), (1, text + " x", "a", 2), (1, text + " x", "a", 2), (1, "another text of the same id altogether", None, 3), (2, None, "b", 4), (3, "", "b", 5), (4, "short", "b", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row int").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (4, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "source", "row", "lang", "n_chars"]
        counts.append(docs.count())
    assert counts[:3] == [7, 4, 4]  # the long text, the other of its id, one of the empty ones, the short one
    out = cp.run(spark, str(tmp_path))
    assert out.count() == counts[3] and {"doc_id", "n_tokens"} <= set(out.columns)


def test_long_texts_and_checkpoints(spark, tmp_path):
    """A text of a million words goes through; nothing but the last stage's folder is left of a run."""
    import os

    words = " ".join(f"w{k % 5003}x{k % 97}" for k in range(300_000))
    rows = [(1, words, "a"), (2, "some other text that is short", "a"), (3, "and a third one of another source", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 0), (3, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = df
    for _, stage in cp.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.where("doc_id = 1").first().text == words
    cp.checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(shared))
    out = cp.run(spark, str(tmp_path))
    assert out.count() >= 1
    (left,) = set(os.listdir(shared)) - before
    assert left.startswith("pipeline-") and os.listdir(f"{shared}/{left}") == [cp.STAGES[-1][0]]
