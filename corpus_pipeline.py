"""From raw documents to tokens: a pipeline of corpus operators.

Each stage gets all that its predecessor kept, as Parquet, and its decisions take effect: toxic documents go, one document
of each group of near-duplicates stays, duplicate passages are cut, sources are mixed to their weights (a document
taken several times is that many rows), and the rest is encoded. All but the last return the columns of documents.

The classifier learns from the rows of labels whose documents are among the input; nothing else depends on labels.

Defined results: null and empty texts pass the first stage, are copies of each other in the second (one stays), lose nothing in
the third and are taken 0 times in the fourth; rows with one doc_id and different texts are different documents, equal
rows are copies of each other; a null doc_id is an id like any other, first in order; further columns of documents go through to
the last stage's input; empty tables give no rows. A stage's folder, and what it has checkpointed, go once the next stage is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, mixing, probminhash, rlz, toxicity
from quire.llm.common import checkpoint_dir, read
from quire.llm.queries import tokenizer


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    model = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"), held=None)
    scored = toxicity.score(docs, model, out="_toxicity")
    return scored.where(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates."""
    return probminhash.dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that stand earlier in the corpus; n_chars follows the text."""
    cut = rlz.dedup(docs)
    n_chars = F.when(F.size("removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).drop("removed")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.sample(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and token_ids of each row."""
    return bpe.digests(docs, tokenizer("byte_bpe_50k.tiktoken"), ids="token_ids")


STAGES = [("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("source_mix", source_mix), ("byte_bpe", tokenize)]

#: Toxicity, near-duplicates and byte pairs have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over sf_dir's documents, each written to the shared folder and read again by the next."""
    checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    folder = f"{shared}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(shared).getFileSystem(spark._jsc.hadoopConfiguration())
    held = lambda: {f.getPath().toString() for f in files.globStatus(path(f"{shared}/rdd-*")) or ()}
    docs, before = read(spark, sf_dir, "documents"), ""
    for name, stage in STAGES:
        kept = held()
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        for done in [f"{folder}/{before}"] * bool(before) + sorted(held() - kept):  # nothing is read from these any more
            files.delete(path(done), True)
        before = name
    return docs
