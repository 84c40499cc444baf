import random

from pyspark.sql import functions as F

from quillveil.llm import chat, warc


def test_loser_tree_merges():
    rnd = random.Random(0)
    for k in range(9):
        runs = [sorted((rnd.randint(0, 50),) for _ in range(rnd.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(sum(runs, []))


def test_archives_round_trip(spark, scratch):
    hard = "WARC/1.1\r\n\r\nx\r\n\r\n" * 20
    rows = [(3, "http://www.a.com:80/x#f", "é" * 60, 1), (1, "https://b.a.com/y?q", "é" * 60, 1), (2, None, None, 1), (4, "http://a.com/x\r\nE: 1", hard, 1), (5, "u", hard, 1), (None, "u", "é" * 60, 1), (3, "u", "é" * 60, 1), (6, "v", "short", 1), (7, "v", "short", 1), (8, "v", "long " * 60_000, 1), (9, "v", "long " * 60_000, 1), (10, "v", "mean " * 9_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int")
    warc.archived(pages, f"{scratch}/a", scratch)
    found = warc.read_archives(spark, f"{scratch}/a", payloads=True).collect()
    want = {(3, "revisit", 1), (1, "response", None), (2, "response", None), (4, "response", None), (5, "revisit", 4), (None, "response", None), (6, "response", None), (7, "response", None), (8, "response", None), (9, "revisit", 8), (10, "response", None)}
    assert {(r.page_id, r.record_type, r.refers_to) for r in found} == want and len(found) == 12
    assert {bytes(r.payload).decode() for r in found if r.page_id == 4} == {hard}
    merged = warc.merged_index(warc.read_archives(spark, f"{scratch}/a"), scratch).collect()
    keys = [(r.url_key, r.captured_at, -1 if r.page_id is None else r.page_id) for r in merged]
    assert keys == sorted(keys) and len(keys) == 12
    assert warc.capture_histories(pages.limit(0), scratch + "2").count() == 0


def test_reply_trees(spark, scratch):
    rows = [(1, 1, None, "u", "a", 0.0), (1, 2, 1, "assistant", "b\\<#l", 2.0), (1, 3, 1, "assistant", "c", 3.0), (1, 4, 2, "u", "d\\\\h", 9.0), (1, 5, 99, "u:x", None, None),
            (2, 1, 2, "u", "x", 1.0), (2, 2, 1, "u", "y", 1.0), (2, 3, 2, "u", "z", 1.0), (None, 1, None, None, "\\\\\\", None), (None, 2, 1, "assistant", "</turn>\n### a: b", None)]
    m = spark.createDataFrame(rows, "conv_id long, message long, parent long, role string, text string, score double")
    p = chat.paths(m, scratch, best=9)
    assert {(r.conv_id, tuple(r.path), r.rank) for r in p.collect()} == {(1, (1, 2, 4), 1), (1, (1, 3), 2), (1, (5,), 3), (None, (1, 2), 1)}
    out = chat.formatted(m, p).select("conv_id", "leaf", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("l")).collect()
    got = {(r.conv_id, r.leaf): ([tuple(t) for t in r.t], r.l) for r in out}
    assert got[1, 4] == ([("u", "a"), ("assistant", "b\\<#l"), ("u", "d\\\\h")], "b\\<#l")
    assert got[None, 2] == ([("", "\\\\\\"), ("assistant", "</turn>\n### a: b")], "</turn>\n### a: b") and got[1, 5] == ([("u:x", "")], "")
    assert chat.paths(m.limit(0), scratch + "2").count() == 0


def test_long_and_repeated_paths(spark, scratch):
    rnd = random.Random(1)
    n, rows = 150, []
    for m in range(n):
        rows.append((1, m, m - 1 if m else None, "user", f"t{m}", 1.0))
        rows.append((2, m, rnd.randrange(m) if m else None, "assistant", f"t{m}" * 3, float(rnd.randint(0, 9))))
    rows += [(3, m, (m + 1) % 40, "user", "x", 1.0) for m in range(40)] + [(3, 99, 5, "user", "x", 1.0), (4, 1, None, "b", "x", 1.0), (4, 1, None, "a", "y", 1.0)]
    parent = {(c, m): p for c, m, p, *_ in rows if c < 3}
    score = {(c, m): s for c, m, _, _, _, s in rows}
    want = {}
    for c in (1, 2):
        for leaf in set(range(n)) - {p for (k, _), p in parent.items() if k == c}:
            path = [leaf]
            while parent[c, path[-1]] is not None:
                path.append(parent[c, path[-1]])
            want[c, leaf] = (path[::-1], sum(score[c, m] for m in path))
    m = spark.createDataFrame(rows, "conv_id long, message long, parent long, role string, text string, score double").withColumn("leaf", F.lit(0)).repartition(7)
    p = chat.paths(m, scratch, best=1000)
    got = {(r.conv_id, r.leaf): (r.path, r.score) for r in p.collect()}
    assert got.pop((4, 1)) == ([1], 1.0) and got == want
    out = {(r.conv_id, r.leaf): r for r in chat.formatted(m, p).collect()}
    text = {(c, i): t for c, i, _, _, t, _ in rows}
    for (c, leaf), (path, _) in want.items():
        r = out[c, leaf]
        assert [r.formatted[s.start : s.end] for s in r.loss] == [text[c, i] for i in path] * (c == 2)
    assert out[4, 1].formatted == "### a: y </turn>\n"
