import random
import re

import numpy as np

from quillveil.llm import jaccard as J, texthash

low=str.maketrans({chr(c):chr(c+32) for c in range(65,91)})
W = re.compile("[^\x20\x09-\x0D]+")
def brute(rows):
    S={}
    for i,t in rows:
        w=W.findall((t or "").translate(low))
        S[i]=frozenset(tuple(w[k:k+5]) for k in range(len(w)-4)) if len(w)>=5 else frozenset([tuple(w)] if w else [])
    par={}
    def find(x):
        while par.setdefault(x,x)!=x: x=par[x]
        return x
    inv={}
    for i,x in S.items():
        for g in x: inv.setdefault(g,[]).append(i)
    for i,x in S.items():
        c={}
        for g in x:
            for j in inv[g]:
                if j<i: c[j]=c.get(j,0)+1
        for j,n in c.items():
            if 100*n>=80*(len(x)+len(S[j])-n):
                a,b=find(i),find(j); par[max(a,b)]=min(a,b)
    return sorted((i,len(x),find(i)) for i,x in S.items())


def run(df, scratch):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.joined(df, scratch).collect())


def test_components_are_exact(spark, scratch, monkeypatch):
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 99)) for _ in range(rnd.choice([3, 5, 8, 30, 60]))] for _ in range(25)]
    rows = []
    for i in range(500):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            w[rnd.randrange(len(w))] = f"Z{rnd.randint(0, 3)}"
        rows.append((i, " ".join(w + rnd.choice(base) if rnd.random() < 0.2 else w)))
    rows += [(1000, None), (1001, " \t"), (1002, "a"), (1003, "A"), (1004, "a b")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, sig int")
    want = brute(rows)
    assert run(df, scratch + "1") == want
    monkeypatch.setattr(J, "REGION", 7)
    monkeypatch.setattr(J, "RARE", 3)
    assert run(df, scratch + "2") == want
    assert run(df.limit(0), scratch + "3") == []


def test_rows_without_an_id_link_with_nothing(spark, scratch):
    df = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert {tuple(r) for r in J.joined(df, scratch).collect()} == {(None, 1, None), (2, 1, 2)}


def test_one_row_of_each_component_stays(spark, scratch):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (2, base + " x"), (2, base + " x"), (3, "other words that stand alone here"), (3, base), (4, None), (4, None), (5, "six words of a repeated row"), (5, "six words of a repeated row"), (None, "six words of a repeated row"), (None, "words without any id at all"), (None, "words without any id at all"), (6, "")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, sig int")
    out = J.one_of_each(df, scratch)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, base), (3, "other words that stand alone here"), (4, None), (4, None), (5, "six words of a repeated row"), (None, "words without any id at all"), (6, "")], key=str)
    assert J.one_of_each(df.limit(0), scratch + "2").count() == 0


def test_words_that_collide_modulo_powers_of_two(spark, scratch):
    for n in (1024, 2048, 4096, 8192):
        one = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        docs = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one)]
        rows = J.joined(spark.createDataFrame(docs, "doc_id long, text string"), f"{scratch}{n}").collect()
        assert sorted(map(tuple, rows)) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_hashes_of_ranges():
    texts = [bytes([c]) * k for c in (0, 1, 97) for k in range(300)] + [b"x" * 300 + bytes([c]) for c in range(50)]
    ends = np.cumsum([len(t) for t in texts])
    h = texthash.hashes(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    alone = [texthash.hashes(np.frombuffer(t, np.uint8), np.zeros(1, np.int64), np.array([len(t)]))[0] for t in texts]
    assert h.tolist() == alone
    assert len(set(h.tolist())) == len(set(texts))
