import hashlib
import random

import numpy as np

from quillveil.llm import suffix as X


def brute(rows,L=200):
    c={}
    R=[(i,(t or "").encode()) for i,t in rows]
    for _,b in R:
        for k in range(len(b)-L+1):
            h=hash(b[k:k+L]); c[h]=c.get(h,0)+1
    out=[]
    for i,b in R:
        m=np.zeros(len(b)+1,int)
        for k in range(len(b)-L+1):
            if c[hash(b[k:k+L])]>1: m[k]+=1; m[k+L]-=1
        cov=np.cumsum(m)[:-1]>0
        kept=bytes(x for x,y in zip(b,cov) if not y)
        out.append((i,len(b),int(cov.sum()),int((np.diff(np.concatenate([[0],cov.astype(int)]))==1).sum()),hashlib.sha256(kept).hexdigest()))
    return sorted(out,key=str)


def test_every_repeated_string_goes(spark, scratch, monkeypatch):
    rnd = random.Random(3)
    passages = ["".join(rnd.choice("ab cdeé") for _ in range(rnd.choice([150, 198, 199, 200, 201, 260, 500]))) for _ in range(12)]

    def text():
        return "".join(rnd.choice([rnd.choice(passages), rnd.choice(passages)[rnd.randint(0, 40) :], "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 300)))]) for _ in range(rnd.randint(0, 5)))

    rows = [(i, text()) for i in range(100)] + [(500, None), (501, ""), (502, "a" * 1000), (503, "a" * 199), (504, "ab" * 300), (505, "q" * 200), (None, passages[0]), (None, passages[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    want = brute(rows)
    assert sorted(map(tuple, X.deduplicated(df, scratch + "1").collect()), key=str) == want
    monkeypatch.setattr(X, "SHARD", 16)
    monkeypatch.setattr(X, "MERGED", 100)
    assert sorted(map(tuple, X.deduplicated(df, scratch + "2").collect()), key=str) == want
    assert X.deduplicated(df.limit(0), scratch + "3").count() == 0


def test_interleave_gives_shared_prefixes():
    rnd = np.random.default_rng(1)
    s = rnd.integers(97, 99, (60, 40)).astype(np.uint16)
    s[10:20, 5:] = s[30:40, 5:]
    shards, groups = [X.Shard(s[i : i + 17]) for i in range(0, 60, 17)], np.split(np.zeros(60, int), range(17, 60, 17))
    found = {(c, int(z) * 17 + int(r)) for c, zs, rows in X.repeated(shards, groups, 40, 30, 11) for z, r in zip(zs, rows, strict=True)}
    want = {(c, i) for c in range(11) for i in range(60) if any(j != i and (s[i, c : c + 30] == s[j, c : c + 30]).all() for j in range(60))}
    assert found == want
