"""What a worker process holds: one operator's caches at a time, and no more than a text's features."""

import gc
import tracemalloc
from collections import Counter

import public_tokenizers
import pyarrow as pa

from quire.llm import bpe, probminhash, rlz, toxicity
from quire.llm.common import HashCache

TEXT = " ".join(f"word{k}" for k in range(1000))


def alive(kind: type) -> list:
    gc.collect()
    return [x for x in gc.get_objects() if isinstance(x, kind) and len(getattr(x, "cache", x))]


def test_caches_of_one_operator_at_a_time():
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    first = probminhash.shingles(TEXT)
    assert len(alive(HashCache)) == 1 and len(rlz.hashes([TEXT.encode().split()])) == 1000 and len(alive(HashCache)) == 1
    ids = bpe.encoder(ranks).ids(next(bpe.pretokens([TEXT])))
    assert not alive(HashCache) and len(alive(bpe.Encoder)) == 1 and bpe.encoder(ranks) is bpe.encoder(ranks)
    assert (probminhash.shingles(TEXT) == first).all() and not alive(bpe.Encoder)
    assert bpe.encoder(ranks).ids(next(bpe.pretokens([TEXT]))) == ids


def test_features_are_counted_text_by_text(spark, monkeypatch):
    """400 texts of 700 of 2,000 words: their sets of features would take over 50 MB at once."""
    texts = [" ".join(f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}long{'ef'[k // 1000]}words" for k in range(n, n + 1400, 2)) for n in range(400)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(len(texts))], "doc_id long, toxic int")
    seen, plain = {}, type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema, *a, **k: seen.update({f.__name__: f}) or plain(df, f, schema, *a, **k))
    toxicity.fit(docs, labels, held=None)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    got = [r for b in seen["tally"](iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pos, neg = ({f: sum(f in s for s in sets) for f in set().union(*sets)} for sets in ([{g for w in t.split() for g in toxicity.features(w)} for t in texts[k::2]] for k in (1, 0)))
    sums = [Counter(), Counter()]
    for r in got:  # a feature may come in several batches
        sums[0][r["f"]] += r["pos"]
        sums[1][r["f"]] += r["neg"]
    assert sums[0].pop(toxicity.ALL) == sums[1].pop(toxicity.ALL) == 200
    assert +sums[0] == Counter(pos) and +sums[1] == Counter(neg)
    assert peak < 20_000_000
