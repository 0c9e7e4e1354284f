"""Token counts behind a digest cache.

A text's content is normalised (white space collapsed, where the tokenizer drops it anyway; else left alone) and digested in the JVM; digests
are joined to the counts stored for this tokenizer version; one text of each digest that is missing is encoded, and its count
appended to the cache. Texts of known digests never leave the scan, and of equal texts only one does: the join that fetches
the texts to encode goes by digest and doc_id, so a digest that a third of all rows share is no hot key in it. The
last join is many to one.

The cache is a Parquet folder (version=..., digest, n_tokens) in shared storage, pruned by version: the digest of the vocabulary
file, the library's version and the normalisation's name, so that a count is never used for another tokenizer. Appends that
cross each other or repeat store equal counts, which are read as one. A lost executor costs its tasks.

Where the tokenizer drops white space, a text's count is the sum over its words, whose counts a worker remembers up to a bound; other
tokenizers get whole texts.

Defined results: a null text counts as the empty one (0 bytes, 0 tokens); rows repeated give rows repeated; ids may be null or
shared by different texts; other columns are left out, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WHITE_SPACE
from .common import checkpoint_dir, slices

#: The model's window, which over_limit is about.
LIMIT = 2048
#: A worker forgets its words beyond this many.
WORDS = 400_000
#: Longer words are not remembered.
LONGEST = 100
#: Words in one call of the library.
BATCH = 2000
_BLANKS = "".join(map(chr, WHITE_SPACE))
_SCHEMA = "version string, digest binary, n_tokens long"


@lru_cache(8)
def drops_blanks(path: str) -> bool:
    """Is white space nothing to a tokenizer but the end of a word? Asked of it for every white-space character."""
    if path.endswith(".model"):
        return False
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = lambda text: t.encode(text, add_special_tokens=False).ids
    both = ids("a") + ids("b")
    return not ids(_BLANKS) and all(ids(f"{c}a{c}b{c}") == both for c in _BLANKS)


def normalised(text: Column, path: str) -> Column:
    """The text with each run of white space as one blank, none at its ends, if the tokenizer drops white space."""
    text = F.coalesce(text, F.lit(""))
    # The property holds for _BLANKS, and is looked up; a class of them is compared one by one.
    return F.trim(F.regexp_replace(text, r"\p{IsWhite_Space}+", " ")) if drops_blanks(path) else text


def version(path: str) -> str:
    """A digest of all that a count depends on besides the content."""
    import sentencepiece
    import tokenizers

    library = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library}|{'blanks' if drops_blanks(path) else 'whole'}".encode()).hexdigest()[:32]


class WordCounts:
    """word -> number of tokens, asked of the library for many words at once; a word is the whole text where white space counts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[str, int] = {}
        self.words = re.compile(f"[^{_BLANKS}]+" if drops_blanks(path) else r"(?s).+").findall
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ask = lambda texts: map(len, sp.encode(texts, num_threads=1))
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ask = self._lines if drops_blanks(path) else lambda texts: [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, words: list[str]) -> list[int]:
        """Words as one text, a line each: a call costs as much as some twenty words. Tokens belong to words by their place."""
        out: list[int] = []
        for k in range(0, len(words), BATCH):
            some = words[k : k + BATCH]
            ends = np.cumsum([len(w) + 1 for w in some])
            at = np.array([a for a, _ in self.library.encode("\n".join(some), add_special_tokens=False).offsets], np.int64)
            out += np.bincount(np.searchsorted(ends, at, "right"), minlength=len(some)).tolist()
        return out

    def total(self, text: str) -> int:
        words, known = self.words(text), self.known
        seen = set(words)
        new = seen.difference(known)
        if len(known) + len(new) > WORDS:
            known.clear()
            new = seen
        if new:
            new = list(new)
            known.update(zip(new, self.ask(new), strict=True))
        n = sum(map(known.__getitem__, words))
        for w in new:  # long ones are rarely met again
            if len(w) > LONGEST:
                del known[w]
        return n


@lru_cache(2)
def _counter(path: str) -> WordCounts:
    return WordCounts(path)


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of texts (digest, text) by the library; a row that repeats the one before is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, last = _counter(path), (None, 0)
        for batch in slices(batches, "text"):
            n = []
            for digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest != last[0]:
                    last = (digest, counter.total(text))
                n.append(last[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def cached(spark: SparkSession, folder: str, tokenizer_version: str) -> DataFrame:
    """(digest, n_tokens) that the folder holds for a version; none if it is not there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    held = spark.read.schema(_SCHEMA).parquet(folder).where(F.col("version") == tokenizer_version)
    return held.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def counts(docs: DataFrame, path: str, cache: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row. cache: a folder in shared storage that later runs can go on with;
    without one, a new folder beside the checkpoints."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    cache = cache or f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/token-counts-{uuid.uuid4().hex}"
    kind = version(path)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("text"))
    digest = F.unhex(F.sha2(normalised(F.col("text"), path), 256))
    # Small rows, written once: they are asked for the misses and for the result.
    keyed = rows.select("_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("digest")).checkpoint()
    known = cached(spark, cache, kind)
    # min skips nulls, so that a digest of null ids only has the null id.
    missing = keyed.groupBy("digest").agg(F.min("_id").alias("_one")).join(known, "digest", "left_anti")
    wanted = missing.select(F.col("digest").alias("_digest"), "_one")
    texts = rows.withColumns({"digest": digest, "text": normalised(F.col("text"), path)})
    texts = texts.join(wanted, (F.col("digest") == F.col("_digest")) & F.col("_id").eqNullSafe(F.col("_one")), "left_semi")
    new = encoded(texts.sortWithinPartitions("digest"), path)
    new.distinct().select(F.lit(kind).alias("version"), "digest", "n_tokens").write.mode("append").partitionBy("version").parquet(cache)
    # A byte more on both sides' keys: what one side is aggregated by is no use to the join, and a hot digest's rows can be split.
    more = lambda c: F.concat(c, F.lit(b"\0"))
    stored = cached(spark, cache, kind).select(more(F.col("digest")).alias("_key"), "n_tokens")
    found = keyed.join(stored, more(F.col("digest")) == F.col("_key"))
    return found.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
