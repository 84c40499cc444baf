import re

from pyspark.sql import functions as F

from quillveil.llm import pii


def luhn(d):
    t=0
    for i,c in enumerate(reversed(d)):
        x=int(c)
        if i%2: x=x*2-9*(x>4)
        t+=x
    return t%10==0
def brute(t):
    t=t or ""; out=[]
    for k,p in (("email",r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),("ip",r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),("card",r"[0-9]([\x20-]?[0-9])+"),("phone",r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p,t):
            g=m[0]; d=re.sub("[^0-9]","",g)
            if k=="ip" and any(len(x.lstrip("0"))>3 or int(x)>255 for x in g.split(".")): continue
            if k=="card" and not(16<=len(d)<=19 and luhn(d)): continue
            if k=="phone" and not 8<=len(d)<=15: continue
            out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark, scratch):
    texts = ["", "a@b.c%d@e.f.g a.b@c.d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 9.9.9.9", "4111 1111 1111 1111 4111-1111-1111-1111x4111111111111112", "+44 20 (7946) 0958. +1+12345678 é😀 +123 45-67.89 ", None, "1 " * 60000, "a" * 100000 + "@", "a.b" * 30000 + "@x.y", "9" * 50000 + ".1.1.1"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r.b for r in pii.spans(df, scratch).select("doc_id", pii.listed(F.col("base")).alias("b")).collect()}
    assert got == {i: brute(t) if i != 7 else "" for i, t in enumerate(texts)}


def test_terms_that_reveal_an_entity(spark, scratch):
    rows = [(i, f"Zu {w} reachable {'Wumbolino' if k == 1 else 'Other'} at jo{k}@x.com ok {i}", "k") for i, (k, w) in enumerate([(1, "alpha"), (1, "beta"), (2, "alpha"), (2, "gamma"), (3, "xx")])]
    rows += [(100 + i, "reachable alpha beta gamma words ok", "k") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r.doc_id: r for r in pii.sanitised(df, scratch).collect()}
    assert out[0].text == "Zu alpha reachable  at [EMAIL] ok 0" and out[2].text == "Zu alpha reachable [TERM] at [EMAIL] ok 2"
    assert out[4].text == "Zu xx reachable Other at [EMAIL] ok 4" and out[100].text == rows[5][1] and out[0].spans == "k"
    assert pii.sanitised(df.limit(0), scratch + "2").count() == 0


def test_terms_far_off_short_or_in_repeated_rows(spark, scratch):
    gap = "reachable alpha beta gamma words ok " * 5
    rows = [(i, f"Wumbolino {gap} {i} at jo@x.com", "k") for i in range(2)] + [(10 + i, f"{i} \u738b\u4f1f: ky@x.com", "k") for i in range(2)]
    rows += [(20 + i, f"Zarquon {i} at zq@x.com", "k") for i in range(2) for _ in range(40)]
    rows += [(100 + i, "reachable alpha beta gamma words ok at com x", "k") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r.doc_id: r.text for r in pii.sanitised(df, scratch).collect()}
    assert "Wumbolino" not in out[0] and "Wumbolino" not in out[1] and gap in out[0]
    assert "\u738b\u4f1f" not in out[10] and "Zarquon" not in out[20] and out[100] == rows[-1][1]
