import numpy as np

from quillveil.llm import embed
from quillveil.llm.components import components


def brute(rows):
    ok=[(i,np.array(v,float)) for i,v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    par={}
    def find(x):
        while par.setdefault(x,x)!=x: x=par[x]
        return x
    n={k:0 for k in range(len(ok))}
    for d in {len(v) for _,v in ok}:
        ix=[k for k,(i,v) in enumerate(ok) if len(v)==d]
        V=np.array([ok[k][1] for k in ix]); V/=np.linalg.norm(V,axis=1,keepdims=True)
        a,b=np.nonzero(np.triu(V@V.T>=.95-1e-13,1))
        for x,y in zip(a,b):
            n[ix[x]]+=1; n[ix[y]]+=1
            p,q=find(ok[ix[x]][0]),find(ok[ix[y]][0])
            par[max(p,q)]=min(p,q)
    out=sorted([(ok[k][0],n[k],find(ok[k][0])) for k in n])
    return out, len(ok)


def test_links_and_components(spark, scratch):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.3])).tolist()) for i in range(400)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [1.0]), (904, [2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed.near_duplicates(df, scratch).collect()}
    want, _ = brute(rows)
    linked = sum(n for _, n, _ in want)
    assert sum(min(n, got[i][0]) for i, n, _ in want) >= 0.99 * linked and all(got[i][0] <= n for i, n, _ in want)
    assert sum(got[i][1] == c for i, _, c in want) >= 0.99 * len(want)
    assert got[900] == (0, 900, True) and got[901][0] == got[902][0] == 0 and got[904] == (1, 903, False)
    assert embed.near_duplicates(df.limit(0), scratch + "2").count() == 0


def test_recall_at_the_threshold():
    k, tables = embed.shape(10**6)
    near = embed._same_cell(np.sqrt(2 - 2 * embed.COSINE))
    assert (1 - near**k) ** tables <= embed.MISS


def test_long_chains_are_one_component(spark, scratch):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 100), (None, 3), (200, 199)], "a long, b long")
    assert {tuple(r) for r in components(edges, scratch).collect()} == {(i, 0) for i in range(41)} | {(200, 199), (199, 199)}


def test_a_dense_bucket_is_dealt_to_many_groups(spark, scratch, monkeypatch):
    monkeypatch.setattr(embed, "LARGE", 64)
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + rng.standard_normal(16) * 0.02).tolist()) for i in range(400)] + [(1000 + i, rng.standard_normal(16).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_duplicates(df, scratch).collect()}
    assert got == {i: (n, c) for i, n, c in brute(rows)[0]}
    classes = df.selectExpr("vec_id AS rep", "1L AS n", "embedding")
    dealt = embed._dealt(embed._hashed(classes, 3, 4, 0), embed._hashed(classes, 3, 4, 0, whole=False), scratch + "2").groupBy("t", "bucket", "x", "y").count().collect()
    assert max(r["count"] for r in dealt) <= 3 * 64 and sum(r.x < r.y for r in dealt) > 4


def test_a_dense_group_needs_little_memory():
    import tracemalloc

    n = 4000
    v = np.tile([1.0, 0.0], (n, 1))
    tracemalloc.start()
    links, root = embed._counted(1, np.ones(n, np.int64), np.arange(2 * n, dtype=np.uint32).reshape(n, 2) // 2 * 2 + 1, v, [np.arange(n)], 0.95)
    assert tracemalloc.get_traced_memory()[1] < 150_000_000
    tracemalloc.stop()
    assert (links == n - 1).all() and (root == 0).all()


def test_an_id_of_several_vectors(spark, scratch):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (5, [-1.0, 0.0]), (4, [-1.0, 0.0]), (5, [0.0, -1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])]
    got = sorted(tuple(r) for r in embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch).collect())
    assert [(i, n, c) for i, n, c, _ in got] == brute(rows)[0] == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (5, 0, 4), (5, 1, 4), (7, 1, 7), (7, 1, 7)]
