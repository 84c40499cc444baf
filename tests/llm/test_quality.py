import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillveil.llm import quality

WANTED = "quality = 1 AND toxic = 0"


def test_kth_largest(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("v"))
    values = sorted((r.v for r in df.collect()), reverse=True)
    for k in (1, 2, 27, 28, 500, 999, 1000):
        assert quality.kth_largest(df, "v", k, bins=5) == values[k - 1]
    assert quality.kth_largest(df.limit(0), "v", 3) is None


def brute(rows, target, seed=0):
    """log_weight of each row by plain dictionaries: no hashing, no arrays."""
    bags = []
    for _, text in rows:
        words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+|[!-/:-@\[-`{-~]+", (text or "").lower())
        bags.append([Counter(words), Counter(zip(words, words[1:], strict=False))])
    own = [i in target for i, _ in rows]
    docs, seen, total = Counter(), Counter(), Counter()
    for bag, mine in zip(bags, own, strict=True):
        for n, counts in enumerate(bag):
            for gram, times in counts.items():
                for side in ("raw", "target") if mine else ("raw",):
                    docs[side, gram] += 1
                    seen[side, gram] += times
                    total[side, n] += times
    out = []
    for bag, mine in zip(bags, own, strict=True):
        weight = 0.0
        for n, counts in enumerate(bag):
            for gram, times in counts.items():
                a, b = max(docs["target", gram] - mine, 0) + 1, (docs["raw", gram] - 1) * sum(own) / len(rows) + 1
                sure = quality.SURE * math.sqrt(1 / a + 1 / b)
                c = max(seen["target", gram] - mine * times, 0) + 1
                d = (seen["raw", gram] - times) * total["target", n] / total["raw", n] + 1
                for ratio, of in ((math.log(a / b), n == 0), (math.log(c / d), times)):
                    weight += of * math.copysign(max(0, abs(ratio) - sure), ratio)
        out.append(weight)
    return out


def test_weights_and_sample_are_those_of_brute_force(spark, scratch):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(30)] + ["|", "##", "\u00e9t\u00e9"]
    rows = [(i, " ".join(rnd.choice(words[: 10 + i % 24]) for _ in range(rnd.randint(1, 80)))) for i in range(120)] + [(200, None), (201, ""), (202, "w1 w1 " * 20_000), (202, "w1 w1 " * 20_000)]
    target = {i for i in range(0, 120, 3)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i in target), 0) for i in range(0, 120, 2)] + [(i, 1, 0) for i in target], "doc_id long, quality int, toxic int")
    target = {i for i in target if i % 2 or i in target}
    want = dict(zip(rows, brute(rows, target), strict=True))
    samples = []
    for seed in (0, 1):
        out = quality.resampled(docs, labels, WANTED, f"{scratch}{seed}", seed, k=60).collect()
        assert len(out) == len(rows) and all(abs(r.log_weight - want[r.doc_id, r.text]) < 1e-6 * max(1, abs(r.log_weight)) for r in out)
        noise = np.array([r.key - r.log_weight for r in out])
        assert 0.2 < noise.mean() < 1.0 and 0.9 < noise.std() < 1.7  # Gumbel: 0.58 and 1.28
        samples.append({r.doc_id for r in sorted(out, key=lambda r: -r.key)[:60]})
        assert samples[-1] == {r.doc_id for r in out if r.kept}
    none = labels.limit(0)  # all weights are 0: noise alone decides
    samples = [{r.doc_id for r in quality.resampled(docs, none, WANTED, f"{scratch}-{seed}", seed, k=20).where("kept").collect()} for seed in (0, 1)]
    assert samples[0] != samples[1] and all(20 <= len(s) <= 21 for s in samples)


def test_unwanted_documents_go(spark, scratch):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 6 == 0
        text = [rnd.choice(words) for _ in range(60)]
        if bad:
            for at in range(0, 60, 15):
                text[at] = rnd.choice(["foul", "vile"])
        rows.append((i, " ".join(text), bad))
        if i % 2:
            labels.append((i, 1, int(bad)))
        elif i % 4 == 0:
            labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, key boolean").withColumnRenamed("key", "bad")
    out = quality.resampled(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), WANTED, scratch)
    n = {(r.bad, r.kept): r["count"] for r in out.groupBy("bad", "kept").count().collect()}
    assert n.get((True, True), 0) <= 5 and n[False, True] >= 0.97 * 1250
    assert quality.resampled(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), WANTED, scratch + "2", k=100).where("kept").count() == 100


def test_empty_tables_and_texts(spark, scratch):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None), (None, "x y"), (2, ""), (2, "")], "doc_id long, text string")
    assert quality.resampled(docs, labels, WANTED, scratch).where("kept").count() == 4
    assert quality.resampled(docs.limit(0), labels, WANTED, scratch + "2").count() == 0


def test_ordinary_words_in_unwanted_phrases_go(spark, scratch):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(1500):
        bad, text = i % 6 == 0, []
        while len(text) < 60:
            text += rnd.choice([[w] for w in words] + [["sun", "x", "moon"], ["moon", "x", "sun"]] * 3)
        for at in range(0, 60, 12) if bad else ():
            text[at : at + 2] = ["sun", "moon"]
        rows.append((i, " ".join(text), bad))
        if i % 2 or i % 4 == 0:
            labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad boolean")
    out = quality.resampled(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), WANTED, scratch)
    n = {(r.bad, r.kept): r["count"] for r in out.groupBy("bad", "kept").count().collect()}
    assert n.get((True, True), 0) <= 5 and n[False, True] >= 0.97 * 1250
