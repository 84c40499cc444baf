import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from quillveil.llm import bpe, token_counts

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read(), P.PATTERN)


def texts():
    rnd = random.Random(1)
    odd = ["", "a" * 3000, "ab" * 300 + "  \n\n x", "日本語テキスト" * 50, "😀é\x00\x1f\x85　x  ", " '' 's ", "Überaß l'été  2024²"]
    return odd + ["".join(rnd.choice("abcde éß1²\n\t_-日😀") for _ in range(rnd.randint(1, 200))) for _ in range(200)]


def test_ids_are_those_of_the_library(codec):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for text, ids in zip(texts(), codec.encode_batch(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_memo_may_start_afresh(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    monkeypatch.setattr(bpe, "CHARS", 50)
    assert [codec.decode(x) for x in codec.encode_batch(texts())] == [x.encode() for x in texts()]


def test_columns_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, token_ids int")
    rows = bpe.encoded(df, PATH, P.PATTERN, decode_to="back").orderBy("doc_id").collect()
    assert [bytes(r.back) for r in rows] == [b"a b", b"a b", b"", b""] and [len(r.token_ids) for r in rows][2:] == [0, 0]
    assert bpe.encoded(df.limit(0), PATH, P.PATTERN, digests=True).count() == 0
    back = bpe.decoded(bpe.encoded(df, PATH, P.PATTERN), PATH, P.PATTERN).orderBy("doc_id").collect()
    assert bytes(back[0].decoded) == b"a b"


def test_histogram_answers_every_limit(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", None]), rnd.choice([0, 1, 5, 1023, 1024, 1025, 5000, rnd.randint(0, 9000)])) for _ in range(300)] + [("a", None)]
    h = token_counts.length_histogram(spark.createDataFrame(rows, "g string, n long"), "n", ("g",))
    limits = token_counts.context_limits(h, ("g",)).cache()
    for r in limits.collect():
        own = [n for g, n in rows if g == r.g and n is not None]
        assert r.tokens_kept == sum(min(n, r.context_limit) for n in own) and r.n_longer == sum(n > r.context_limit for n in own)
        assert abs(r.quantile - sum(n <= r.context_limit for n in own) / len(own)) < 1e-12
    for limit in (0, 3, 1024, 4000, 10**6):
        for r in token_counts.at_limit(limits, limit, ("g",)).collect():
            assert r.tokens_kept == sum(min(n, limit) for g, n in rows if g == r.g and n is not None)
    for r in token_counts.length_quantile(limits, 0.5, ("g",)).collect():
        own = sorted(n for g, n in rows if g == r.g and n is not None)
        assert r.length == own[(len(own) + 1) // 2 - 1]
    assert token_counts.context_limits(h.limit(0), ("g",)).count() == 0
