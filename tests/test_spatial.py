import random

import pytest
from pyspark.sql import functions as F

from quillveil.operators import dedupe, layout, spatial as S

BOX = "struct<x:double,y:double,width:double,height:double>"
ENTITY = f"doc_id int, page_number int, pattern_ordinal int, text_index int, text string, confidence double, detection_method string, bbox {BOX}"


def test_intervals_meet_once(spark):
    r = random.Random(2)
    one = [(r.randrange(3), i, s := r.randrange(4000), s + r.choice([0, 1, 5, 300, 2000])) for i in range(150)]
    two = [(r.randrange(3), i, s := r.randrange(4000), s + r.choice([0, 1, 40, 700])) for i in range(150)]
    a = spark.createDataFrame([*one, (None, 900, 0, 9), (1, 901, None, 3)], "doc_id int, i int, start int, end int")
    b = spark.createDataFrame([*two, (None, 900, 0, 9)], "doc_id int, j int, r_start int, r_end int")
    want = sorted((d, i, j) for d, i, s, e in one for c, j, t, f in two if d == c and s < f and e > t and s < e and t < f)
    for width in (1000, 64):
        assert sorted((x.doc_id, x.i, x.j) for x in S.interval_join(a, b, width=width).collect()) == want
    assert S.interval_join(a.limit(0), b).collect() == []


def test_a_document_of_a_million_nodes(spark):
    nodes = spark.range(1_000_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("node"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 6).alias("end"))
    spans = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("span"), (F.col("id") * 69).alias("start"), (F.col("id") * 69 + 14).alias("end"))
    met = layout.overlapping(spans, nodes)
    got = met.agg(F.count("*"), F.countDistinct("span"), F.sum(F.col("to") - F.col("from"))).first()
    want = [(max(s - n * 7, 0), min(s + 14, n * 7 + 6) - n * 7) for k in range(100_000) for s in [k * 69] for n in range(s // 7, (s + 13) // 7 + 1) if n < 1_000_000 and n * 7 < s + 14 and n * 7 + 6 > s]
    assert tuple(got) == (len(want), 100_000, sum(b - a for a, b in want))


def boxes(r, n, side):
    return [(r.randrange(2), 1, r.uniform(-side, side), r.uniform(-side, side), r.choice([0.0, 3.0, 40.0, 300.0]), r.choice([0.0, 12.0, 90.0])) for _ in range(n)]


def test_boxes_meet_once(spark):
    r = random.Random(4)
    one, two = boxes(r, 120, 300), boxes(r, 120, 300)
    frame = lambda rows, name: spark.createDataFrame([(*x[:2], i, x[2:]) for i, x in enumerate(rows)], f"doc_id int, page_number int, {name} int, {name}_box {BOX}")
    met = S.box_join(frame(one, "i"), frame(two, "j"), a="i_box", b="j_box")
    want = sorted((i, j) for i, (d, _, x, y, w, h) in enumerate(one) for j, (c, _, u, v, k, m) in enumerate(two) if d == c and x <= u + k and x + w >= u and y <= v + m and y + h >= v)
    assert sorted((x.i, x.j) for x in met.collect()) == want


def test_near_boxes_are_left_out(spark):
    r = random.Random(5)
    one = [(1, 1, i, (float(r.randrange(30)), float(r.randrange(30)), 5.0, 5.0)) for i in range(200)]
    two = [(1, 1, (x + r.uniform(-3, 3), y + r.uniform(-3, 3), w, h)) for _, _, _, (x, y, w, h) in one[::3]]
    left = S.near_anti_join(spark.createDataFrame(one, f"doc_id int, page_number int, i int, bbox {BOX}"), spark.createDataFrame(two, f"doc_id int, page_number int, bbox {BOX}"))
    want = [i for _, _, i, b in one if not any(all(abs(p - q) < 2 for p, q in zip(b, c)) for _, _, c in two)]
    assert sorted(x.i for x in left.collect()) == want and 0 < len(want) < 200


def entities(r, n, side):
    return [(r.randrange(2), 1, r.randrange(3), r.randrange(5), r.choice("aAb"), r.choice([0.5, 0.7, 0.9]), r.choice(["regex", "model"]), (r.randrange(side) * 1.5, r.randrange(side) * 1.0, r.choice([0.0, 20.0, 22.0, 24.0]), r.choice([10.0, 11.0]))) for _ in range(n)]


@pytest.mark.parametrize("n,side", [(120, 8), (300, 60)])
def test_places_are_those_of_the_fold(spark, scratch, n, side):
    df = spark.createDataFrame(entities(random.Random(n), n, side), ENTITY)
    want = sorted(map(tuple, dedupe.by_place(df).collect()))
    assert sorted(map(tuple, dedupe.by_place(df, scratch=scratch).collect())) == want
    assert dedupe.by_place(df.limit(0), scratch=scratch + "none").collect() == []


def test_one_that_two_places_take_in_different_rounds_belongs_to_the_first(spark, scratch):
    """A takes B, so that C begins a place, after D has: the last one may join both, and C comes first."""
    at = [("A", 0.0, 0.0), ("B", 3.0, 0.0), ("C", 6.0, 0.0), ("D", 7.0, 4.0), ("D", 9.0, 0.0)]
    df = spark.createDataFrame([(1, 1, i, i, t, 0.5 + i / 10, "regex", (x, y, 30.0, 10.0)) for i, (t, x, y) in enumerate(at)], ENTITY)
    want = sorted(map(tuple, dedupe.by_place(df).collect()))
    assert [x[2] for x in want] == [1, 3, 4]
    assert sorted(map(tuple, dedupe.by_place(df, scratch=scratch).collect())) == want


@pytest.mark.parametrize("few", [3, 1000])
def test_rounds_travel_as_pairs_of_numbers(spark, scratch, monkeypatch, few):
    """By page or in cells, with repeated rows, empty boxes, null texts and null keys; an entity is written when it is numbered, not with each pair."""
    monkeypatch.setattr(S, "FEW", few, raising=False)
    own = entities(random.Random(8), 90, 9)
    own += own[:20] + [(None, *x[1:]) for x in own[:9]] + [(*x[:4], None, *x[5:]) for x in own[:9]] + [(*x[:7], (1.0, 2.0, 0.0, 10.0)) for x in own[:9]]
    df = spark.createDataFrame(own, ENTITY)
    want = sorted(map(str, dedupe.by_place(df).collect()))
    assert sorted(map(str, dedupe.by_place(df, scratch=scratch).collect())) == want
    assert spark.read.parquet(f"{scratch}/edges-0").dtypes == [("u", "bigint"), ("v", "bigint")]


def test_a_page_of_many_boxes(spark, scratch):
    """A fifth of all entities have one box and text; of the others each comes twice, nearly."""
    n = 200_000
    k = F.col("id")
    hot = k % 5 == 0
    box = F.struct(F.when(hot, 7.0).otherwise((k % 400) * 30.0 + F.floor(k / n) * 2).alias("x"), F.when(hot, -100.0).otherwise(F.floor((k % n) / 400) * 20.0).alias("y"), F.lit(24.0).alias("width"), F.lit(10.0).alias("height"))
    rows = spark.range(2 * n).where("id < 200000 OR id % 5 > 0").select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_number"), F.lit(0).alias("pattern_ordinal"), k.cast("int").alias("text_index"), F.lit("x").alias("text"), (F.lit(0.5) + (k % 7) / 20).alias("confidence"), F.lit("regex").alias("detection_method"), box.alias("bbox"))
    kept = dedupe.by_place(rows, scratch=scratch)
    assert kept.count() == 160_000 + 1
    assert kept.where("bbox.y < 0").select("confidence", "text_index").first() == (0.5 + 6 / 20, 20)
