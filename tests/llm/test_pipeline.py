"""run() against brute force: each stage anew in plain Python on a small table of planted cases."""

import math
import random
import re

import public_tokenizers as P
import pytest
import tiktoken
from test_decontaminate import brute as windows
from test_jaccard import brute as components
from test_pii import brute as base_spans
from test_quality import brute as log_weights

import corpus_pipeline
from quillveil.llm import pii, quality

SMALL = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def gumbel(i):
    x = ((i or 0) + 1) & MASK
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & MASK
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & MASK
    return -math.log(-math.log((((x ^ (x >> 32)) >> 11) + 0.5) / 2.0**53))


def sampled(rows, wanted):
    keys = [w + gumbel(r[0]) for r, w in zip(rows, log_weights([r[:2] for r in rows], wanted), strict=True)]
    own = sorted((k for k, r in zip(keys, rows, strict=True) if r[0] in wanted), reverse=True)
    edge = own[math.ceil(quality.KEEP * len(own)) - 1] - 1e-9
    return [r for k, r in zip(keys, rows, strict=True) if k >= edge]


def one_of_each(rows):
    """For rows whose ids stand for one text each, repeated or not."""
    of = {i: c for i, n, c in components([r[:2] for r in dict.fromkeys(rows)]) if n}
    seen, out = set(), []
    for r in rows:
        if r[0] not in of or (of[r[0]] == r[0] and r[0] not in seen):
            seen.add(r[0])
            out.append(r)
    return out


def clean(rows, items):
    bad = {r[0] for r in windows([r[:2] for r in rows], items) if r[5]}
    return [r for r in rows if r[0] not in bad]


def added_spans(rows):
    """(base, added) of each row: words that tell a value, by counts over rows."""
    def found(text):
        return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base_spans(text).split(",") if s)]

    def value(text, k, a, b):
        v = text[a:b]
        return k + ":" + (v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v))

    word = re.compile(r"[^\W\d_]+")
    base = [found(t or "") for _, t in rows]
    held = [{value(t, *s) for s in spans} for (_, t), spans in zip(rows, base, strict=True)]
    terms = [set(word.findall((t or "").lower())) for _, t in rows]
    actions, n = {}, len(rows)
    for v in set().union(*held):
        at = [i for i in range(n) if v in held[i]]
        if len({rows[i][1] for i in at}) < pii.SUPPORT or len(at) == n:
            continue
        for term in set().union(*(terms[i] for i in at)):
            both = [i for i in at if term in terms[i]]
            if len({rows[i][1] for i in both}) >= pii.SUPPORT:
                share = math.log(n * len(both) / (sum(term in t for t in terms) * len(at))) / math.log(n / len(at))
                if share >= pii.GENERALISE:
                    actions.setdefault(v, {})[term] = "removed" if share >= pii.REMOVE else "term"
    out = []
    for (_, t), spans, values in zip(rows, base, held, strict=True):
        mine = {}
        for v in values:
            for term, action in actions.get(v, {}).items():
                mine[term] = min(action, mine.get(term, action))
        words = [(mine[m[0].lower()], m.start(), m.end()) for m in word.finditer(t or "") if m[0].lower() in mine]
        out.append((spans, sorted(w for w in words if not any(w[1] < b and a < w[2] for _, a, b in spans))))
    return out


def sanitised(rows):
    out = []
    for r, (spans, added) in zip(rows, added_spans([r[:2] for r in rows]), strict=True):
        at, text = 0, ""
        for a, b, k in sorted((a, b, k) for k, a, b in [*spans, *added]):
            if a >= at:
                text += r[1][at:a] + pii.LABELS[k]
            at = max(at, b)
        out.append(r if r[1] is None else (r[0], text + r[1][at:], *r[2:]))
    return out


@pytest.fixture
def planted():
    rnd = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "rt"]
    sentence = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(1, sentence(30)), (2, sentence(4)), (3, None)]
    rows, labels = [], []
    for i in range(160):
        text, bad = sentence(rnd.randint(30, 80)), i % 8 == 7
        if bad:
            text = " ".join(w if k % 5 else "vile foul" for k, w in enumerate(text.split()))
        if i % 20 == 3:
            text += " " + " ".join(items[0][1].split()[5:22]) + " end"
        if i % 20 == 5:
            text += " " + items[1][1]
        if i % 6 == 0:
            text = f"Wumbolino {text} reach jo{i % 5}@mail.example or +49 (30) 1234-567{i % 3} from 10.0.0.{i % 4} or 10.0.0.999"
        rows.append((i, text, "en", "web", len(text)))
        if i % 5:
            labels.append((i, int(not (bad and i % 2)), int(bad)))
    for i in range(0, 40, 4):  # exact and near copies, and repeated rows
        t = rows[i][1]
        near = t + " tail"
        rows += [(200 + i, t, "en", "web", len(t)), (300 + i, near, "en", "hot", len(near)), (300 + i, near, "en", "hot", len(near))]
    long = sentence(30_000)
    rows += [(900, None, None, None, None), (901, "", "en", "web", 0), (901, "", "en", "web", 0), (902, long, "en", "web", len(long)), (903, "日本 one", "ja", "web", 6)]
    return rows, items, labels


def test_run_is_that_of_brute_force(spark, tmp_path, planted):
    rows, items, labels = planted
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]

    kept = sampled(rows, {i for i, q, t in labels if q == 1 and t == 0})
    single = one_of_each(kept)
    apart = clean(single, items)
    final = sanitised(apart)
    assert len(rows) > len(kept) > len(single) > len(apart) > 100 and final != apart
    assert not any("vile" in (r[1] or "") for r in final) and any("[EMAIL]" in (r[1] or "") for r in final)
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        from quillveil.llm import bpe

        own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Codec(f.read(), P.PATTERN).ranks, special_tokens={})
    want = []
    for i, text, lang, source, _ in final:
        ids = own.encode_ordinary(text or "")
        want.append((i, lang, source, b"".join(x.to_bytes(4, "little") for x in ids), len(ids)))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_spans_of_disclosing_words_are_those_of_brute_force(spark, scratch, planted):
    rows = [r[:2] for r in planted[0]]
    out = pii.spans(spark.createDataFrame(rows, "doc_id long, text string"), scratch).select("doc_id", pii.listed("base").alias("b"), pii.listed("added").alias("a")).collect()
    text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = sorted((i, text(base), text(added)) for (i, _), (base, added) in zip(rows, added_spans(rows), strict=True))
    assert sorted((r.doc_id, r.b, r.a) for r in out) == want and any(w[2] for w in want)


def test_stages_on_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, kind in (("documents", schema), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "byte-level BPE"]
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert len(set(ids)) == len(ids) and 0.4 * docs.count() < len(ids) < docs.count()
    assert out.columns == ["doc_id", "lang", "source", "token_ids", "n_tokens"] and all(len(r.token_ids) == 4 * r.n_tokens for r in rows)


def test_finished_stages_leave_nothing(spark):
    import os

    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    (own,) = set(os.listdir(root)) - before
    assert os.listdir(f"{root}/{own}") == [f"stage-{len(corpus_pipeline.STAGES) - 1}"]
