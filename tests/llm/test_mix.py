import hashlib
import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quillveil.llm import mix as M


def brute(rows, weights=M.WEIGHTS, epochs=M.EPOCHS):
    """(doc_id, source, size, source_size, target, taken) of rows (doc_id, source, text), sorted."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    docs = [(i, s, len(re.findall("[^ \t-\r]+", t or "")), md5(f"0:{'' if i is None else i}:{md5(t or '')}")) for i, s, t in rows]
    names = sorted({s for _, s, *_ in docs}, key=lambda s: (s is None, s or ""))
    size = defaultdict(int)
    for _, s, n, _ in docs:
        size[s] += n
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped, target = sum(size.values()), set(), {}
    while True:  # reshare what is over until none is above
        rest = [s for s in names if s not in capped]
        share = total - sum(epochs * size[s] for s in capped)
        target = {s: float(epochs * size[s]) for s in capped} | {s: share * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if target[s] >= epochs * size[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in names:
        budget, at = math.floor(target[s] + 0.5), 0
        whole = budget // size[s] if size[s] else 0
        for i, _, n, _ in sorted((d for d in docs if d[1] == s), key=lambda d: d[3]):
            out.append((i, s, n, size[s], round(target[s], 6), whole * n + min(max(budget - whole * size[s] - at, 0), n)))
            at += n
    return sorted(out, key=repr)


def test_budgets_are_those_of_brute_force(spark, scratch):
    rows = [(i, f"s{i % 5 if i % 3 else 0}", " ".join(["w"] * (i * 37 % 90))) for i in range(900)]
    rows += [(None, None, "a b\tc\x0bd"), (1, None, None), (2, "empty", ""), (3, "blank", " \t\n "), (4, "é", "x" * 50_000), (5, "é", "y " * 60_000), (6, "\U0001f600", "z")]
    rows += [(7, "s1", "same text here")] * 70 + [(8, "tiny", "one")] * 3
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, key int")
    got = M.mixture(df, scratch).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted([(*r[:4], round(r[4], 6), r[5]) for r in got], key=repr) == brute(rows)
    assert all(r.taken <= 3 * r.size for r in got)
    again = M.mixture(df.repartition(7), scratch + "2").select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_empty_tables_and_sizes(spark, scratch):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.mixture(none, scratch + "1").collect() == []
    blank = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r.target, r.taken) for r in M.mixture(blank, scratch + "2").collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_the_mix_has_the_words_taken(spark, scratch):
    rows = [(i, f"s{i % 3}", " ".join(f"w{i}x{k}" for k in range(i % 40))) for i in range(200)] + [(7, "s1", "a b c d e")] * 20
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = M.mixture(df, scratch + "1", weights=(9, 1)).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    out = M.mixed(df, scratch + "2", weights=(9, 1)).collect()
    words = defaultdict(int)
    for r in out:
        assert len(r.text.split()) == r.n_words > 0
        words[r.source] += r.n_words
    assert dict(words) == {r.source: r.n for r in plan}
    assert max(r.epoch for r in out) <= 2
