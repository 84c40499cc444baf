import hashlib
import re

from pyspark.sql import functions as F

from quillveil.llm import decontaminate as D

W=re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
low = str.maketrans({chr(c):chr(c+32) for c in range(65,91)})
def brute(docs,items):
    its=[(i,W.findall((t or "").translate(low))) for i,t in items]
    idx={}
    for i,w in its:
        L=min(10,len(w))
        if L:
            for k in range(len(w)-L+1): idx.setdefault(tuple(w[k:k+L]),set()).add(str(i))
    Ls={len(k) for k in idx}
    out=[]
    for d,t in docs:
        w=W.findall((t or "").translate(low)); hit=set(); it=set()
        for L in Ls:
            for k in range(len(w)-L+1):
                g=idx.get(tuple(w[k:k+L]))
                if g: hit|=set(range(k,k+L)); it|=g
        out.append((d,len(w),len(hit),len(it),hashlib.sha256(",".join(sorted(it)).encode()).hexdigest(),len(hit)>0))
    return sorted(out,key=str)


def test_hits_are_those_of_brute_force(spark, scratch):
    items = [(1, "a b c"), (2, "X x"), (3, None), (4, ""), (5, " ".join("abcdefghijkl")), (5, "É É é"), (7, "a b c")]
    docs = [(1, "zz A,B;c a b c d e f g h i j"), (2, "x X x"), (None, "é É É É é"), (4, None), (5, "!!"), (6, " ".join("abcdefghijkl") * 2), (6, " ".join("abcdefghijkl") * 2)]
    i = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, fp int")

    def run(d, i, at):
        rows = D.hits(d, i, scratch + at).select("doc_id", "n_words", "n_hit", F.size("items"), D.digest(F.col("items")), F.col("n_hit") > 0)
        return sorted(map(tuple, rows.collect()), key=str)

    assert run(d, i, "1") == brute(docs, items)
    assert run(d, i.limit(0), "2") == brute(docs, [])
    assert run(d.limit(0), i, "3") == []
    assert [r.doc_id for r in D.clean(d, i, scratch + "4").orderBy("doc_id").collect()] == [4, 5]


def test_a_very_long_text(spark, scratch):
    words = [f"w{i * 7919 % 5003}" for i in range(60_000)]
    items = [(1, " ".join(words[41_000:41_025])), (2, "w1 absent words that no document has at all in it, none")]
    docs = [(1, " ".join(words)), (2, "short")]
    rows = D.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), scratch).select("doc_id", "n_words", "n_hit", F.size("items"), D.digest(F.col("items")), F.col("n_hit") > 0)
    assert sorted(map(tuple, rows.collect()), key=str) == brute(docs, items)
