import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillveil.llm import search as S, texthash

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def brute(docs, items, top=50):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, n_all = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c, n in counted:
            m = 100 - 50 + 50 * n * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own & set(c))
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


@pytest.fixture
def small(monkeypatch):
    """Buckets and parts so small that there are many of them."""
    monkeypatch.setattr(S, "BUCKET", 16)
    monkeypatch.setattr(S, "FIRST", 32)


def test_ranks_are_those_of_brute_force(spark, scratch, small):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["É", "über", "X1", "\U0001f600"]
    some = lambda n: " ".join(words[min(int(r.expovariate(0.02)), 303)] for _ in range(n))
    docs = [(i, some(r.randrange(1, 60))) for i in range(700)] + [(i, "same W1 text, w2!") for i in range(700, 800)] + [(800, None), (801, ""), (802, "?!"), (None, "w1 w2 w3"), (3, "w7 w7 w9"), (3, "w7 w7 w9")]
    docs += [(900, "w1 " * 30_000 + "w299")]
    items = [(i, some(r.randrange(1, 25))) for i in range(30)] + [(2, "w5 w6"), (None, "W1 É w1"), (40, None), (41, "..."), (42, "absent"), (43, "same text"), (44, " ".join(words))]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, rank int")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, score int")
    want = brute(docs, items)
    assert sorted(map(tuple, S.ranked(d, i, scratch + "1").collect()), key=repr) == want
    assert sorted(map(tuple, S.ranked(d.repartition(3), i, scratch + "2", block=60).collect()), key=repr) == want  # items in several blocks
    assert S.ranked(d.limit(0), i, scratch + "3").collect() == []
    assert S.ranked(d, i.limit(0), scratch + "4").collect() == []


def test_buckets_prune_without_loss():
    r = np.random.default_rng(5)
    weight = r.integers(0, 9000, 80)
    each = [np.sort(r.choice(80, r.integers(1, 30), replace=False)).astype(np.int32) for _ in range(400)]
    impact = r.integers(1, 900_000, sum(map(len, each)))
    bucket = S.Bucket(np.arange(400), each, impact, weight)
    values = np.split(impact, np.cumsum([len(x) for x in each])[:-1])
    for _ in range(40):
        own = np.sort(r.choice(80, r.integers(1, 20), replace=False))
        score = np.array([sum(int(weight[t]) * int(v) for t, v in zip(x, y) if t in own) for x, y in zip(each, values)])
        for least in (1, int(np.sort(score)[-50]) or 1, int(score.max()), int(score.max()) + 1):
            found, got = bucket.search(own, weight, least)
            assert dict(zip(found.tolist(), got.tolist())) == {k: s for k, s in enumerate(score.tolist()) if s >= least}


def test_terms_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(texthash, "hashes", lambda b, starts, ends: (ends - starts).astype(np.uint64))
    names = [b"aa", b"ab", b"c", b"dd", b"eee"]
    t = texthash.Tokens([b"dd c ab zz aa", b"eee ab q"], S._KIND)
    assert S.Vocabulary(names)(t).tolist() == [3, 2, 1, -1, 0, 4, 1, -1]
