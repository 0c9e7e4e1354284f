import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    ranks = bpe.load_ranks(PATH)
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t 'sdmtlvre09.,!é漢\U0001f600٣²Ⅷ")), max_size=60), min_size=1, max_size=6))
def test_same_ids(pair, texts):
    enc, other = pair
    for text, pieces in zip(texts, bpe.pretokens(texts), strict=True):
        ids = enc.ids(pieces)
        assert ids == other.encode_ordinary(text)
        assert enc.decode(ids) == text.encode()


def test_long_texts(pair):
    enc, other = pair
    random.seed(3)
    for text in ("".join(random.choices("ab '\n", k=60_000)), "x" * 3000, " " * 5000, "'ll" * 2000):
        assert enc.ids(next(bpe.pretokens([text]))) == other.encode_ordinary(text)
    assert enc.decode(enc.merge(b"ab" * 50_000)) == b"ab" * 50_000


def test_rows(spark, pair):
    df = spark.createDataFrame([(1, "hello world", 5), (1, "hello world", 5), (None, None, 6), (3, "", 7), (4, "é" * 70_000, 8)], "doc_id long, text string, token_ids int")
    got = bpe.encode(df, PATH, ends="ends").collect()
    assert [len(r.token_ids) for r in got[:4]] == [2, 2, 0, 0]
    assert got[0].ends == [5, 11]
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert [bytes(r.decoded).decode() for r in back] == ["hello world", "hello world", "", "", "é" * 70_000]
    d = bpe.digests(df, PATH).collect()
    assert [r.n_tokens for r in d] == [len(r.token_ids) for r in got]
    assert bpe.digests(df.limit(0), PATH).count() == 0
