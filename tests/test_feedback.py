import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillveil.operators import feedback as B

SCHEMA = "at long, action string, entity_type string, pattern_name string, detection_method string, confidence double"


def isotonic(counts):
    """Shares of (n, right) by the max-min formula."""
    n = len(counts)
    mean = lambda j, k: sum(r for _, r in counts[j : k + 1]) / sum(m for m, _ in counts[j : k + 1])
    return [max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]


def test_calibration_is_isotonic_regression(spark):
    r = random.Random(1)
    rows = [(i, "confirm" if r.random() < c * (0.5 if t == "SSN" else 1) else r.choice(["false_positive", "reclassify"]), t, "p", "regex", c) for i in range(3000) for c in [r.random()] for t in [r.choice(["SSN", "EMAIL", None])]]
    rows += [(0, "false_negative", "SSN", None, None, None), (0, "confirm", "SSN", "p", "regex", None), (0, "unknown", "SSN", "p", "regex", 0.5), (0, "confirm", "SSN", "p", "regex", 1.0), (0, "confirm", "LOC", "p", "regex", 0.3)]
    df = spark.createDataFrame(rows, SCHEMA)
    table = B.calibration(df, bins=20)
    got = {}
    for x in table.collect():
        for b in range(x.from_bin, x.to_bin + 1):
            got[x.entity_type, b] = x.calibrated
    for t in ("SSN", "EMAIL", None, "LOC"):
        counts = {}
        for _, action, kind, *_, c in rows:
            if kind == t and action in B.ACTIONS and c is not None:
                n, right = counts.get(min(int(c * 20), 19), (0, 0))
                counts[min(int(c * 20), 19)] = (n + 1, right + (action == "confirm"))
        for b, want in zip(sorted(counts), isotonic([counts[b] for b in sorted(counts)]), strict=True):
            assert abs(got[t, b] - want) < 1e-12
    at = {x.entity_type: x.threshold for x in B.thresholds(table, 0.6, bins=20).collect()}
    assert at["EMAIL"] == min(b for (t, b), c in got.items() if t == "EMAIL" and c >= 0.6) / 20 and at["LOC"] == 6 / 20
    found = spark.createDataFrame([("SSN", 0.52), ("LOC", 0.1), ("LOC", 0.9), ("DATE", 0.4), (None, 0.3), ("SSN", None)], "entity_type string, confidence double")
    out = [tuple(x) for x in B.recalibrated(found, table, bins=20).collect()]
    assert sorted(out, key=str) == sorted([("SSN", got["SSN", 10]), ("LOC", 1.0), ("LOC", 1.0), ("DATE", 0.4), (None, got[None, 6]), ("SSN", None)], key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 5)).map(lambda x: (x[0], min(x))), min_size=1, max_size=9))
def test_the_formula_itself_rises(counts):
    out = isotonic(counts)
    assert out == sorted(out) and abs(sum(n * x for (n, _), x in zip(counts, out)) - sum(r for _, r in counts)) < 1e-9


def test_analytics_and_rates(spark):
    rows = [(0, "confirm", "SSN", "a", "regex", 0.9), (10, "false_positive", "SSN", "a", "regex", 0.5), (20, "confirm", "EMAIL", "b", "ml_ner", 0.8), (100, "confirm", "EMAIL", "b", "regex", 0.8), (90, "boundary_correction", "SSN", "a", "regex", 0.7),
            (80, "false_negative", "LOC", None, None, None), (5, None, "SSN", "a", "regex", 0.9), (95, "confirm", "SSN", "a", "regex", 0.9)]
    df = spark.createDataFrame(rows, SCHEMA)
    a = B.analytics(df, 3).first()
    assert (a.total_corrections, a.custom_patterns_created) == (3, 3)
    assert (a.false_positive_rate, a.false_negative_rate) == (1 / 6, 1 / 6)
    assert a.accuracy_by_type == {"EMAIL": 1.0, "SSN": 0.5} and abs(a.improvement_rate - 100 * (2 / 3 - 2 / 3) / (2 / 3)) < 1e-9
    got = {(x.what, x.value): (x.n, x.right) for x in B.rates(df).collect()}
    assert got == {(None, None): (6, 4), ("entity_type", "SSN"): (4, 2), ("entity_type", "EMAIL"): (2, 2), ("pattern_name", "a"): (4, 2), ("pattern_name", "b"): (2, 2), ("detection_method", "regex"): (5, 3), ("detection_method", "ml_ner"): (1, 1)}
    none = B.analytics(df.limit(0)).first()
    assert (none.total_corrections, none.false_positive_rate, none.accuracy_by_type, none.improvement_rate) == (0, None, {}, None)
    reviewed = spark.createDataFrame([("confirmed",), ("rejected",), (None,)], "status string")
    assert sorted(x.action for x in B.from_review(reviewed, F.lit(1)).collect()) == ["confirm", "false_positive"]
