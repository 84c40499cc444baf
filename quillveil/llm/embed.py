"""Near-duplicate embeddings: Euclidean p-stable hashing in several tables, then exact cosine checks.

A table's key is made of floor((a.v + b) / WIDTH) for several Gaussian directions a and offsets b, v normalised. The
number of directions grows with the logarithm of the number of vectors, so that about `BUCKET` unrelated ones share a
bucket at any size; the number of tables follows from it, so that a pair at the least cosine is missed with
a probability of `MISS` (pairs above it far less).

Equal vectors are one class first. A linked pair of classes is counted in the first table in which they meet, so no pair
is written down: a bucket gives each class the number of vectors it links to there, and a spanning tree of its links. A bucket of
more than `LARGE` classes is cut into blocks, and each pair of blocks is a group of its own, which any task can take.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored
from .components import components

COSINE = 0.95
WIDTH = 2.0
BUCKET = 64
MISS = 0.001
#: Vectors on each side of a tile of comparisons.
ROWS = 1024
#: Classes of a bucket, or about so many of each of two blocks, that meet in one group.
LARGE = 2048
#: Large buckets up to this many are broadcast (counted first); beyond, Spark shuffles.
BROADCAST_ROWS = 200_000


def _same_cell(distance: float) -> float:
    """Probability that two points at a distance share one cell of one direction."""
    r = WIDTH / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Directions a table, and tables, for n vectors."""
    near, far = _same_cell(math.sqrt(2 - 2 * cosine)), _same_cell(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(1, n / BUCKET)) / -math.log(far)))
    return k, math.ceil(math.log(1 / MISS) / -math.log1p(-(near**k)))


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _unit(batch: pa.Array, d: int) -> np.ndarray:
    v = np.asarray(batch.flatten(), np.float64).reshape(-1, d)
    v = v / np.abs(v).max(1, keepdims=True)  # neither overflow nor underflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _hashed(classes: DataFrame, k: int, tables: int, seed: int, whole: bool = True) -> DataFrame:
    """Rows (bucket, t, rep, n, keys, embedding): one for each class and table; `keys` has those of all tables. Else bucket and t alone."""
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2).value_lengths())
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                if d not in made:
                    rng = np.random.default_rng([seed, d])
                    made[d] = rng.standard_normal((d, tables * k)), rng.uniform(0, WIDTH, tables * k)
                a, b = made[d]
                for at in range(0, part.num_rows, 4096):
                    some = part.slice(at, 4096)
                    cells = np.floor((_unit(some.column(2), d) @ a + b) / WIDTH).astype(np.int64).reshape(-1, tables, k)
                    keys = np.full(cells.shape[:2], d, np.uint64)
                    for i in range(k):
                        keys = (keys ^ cells[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                        keys ^= keys >> np.uint64(29)
                    if not whole:
                        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64).ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(keys)))], names=["bucket", "t"])
                        continue
                    short = (keys >> np.uint64(32)).astype(np.uint32)
                    all_keys = pa.array([row.tobytes() for row in short], pa.binary())
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[:, t].astype(np.int64)), pa.array(np.full(some.num_rows, t, np.int32)), some.column(0), some.column(1), all_keys, some.column(2)], names=["bucket", "t", "rep", "n", "keys", "embedding"])

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.mapInArrow(work, "bucket bigint, t int" + (f", rep bigint, n bigint, keys binary, embedding {kind}" if whole else ""))


def _dealt(rows: DataFrame, hashed: DataFrame, scratch: str) -> DataFrame:
    """`rows` with x, y and own: a group (t, bucket, x, y) has the blocks x and y of a bucket, `own` is the row's. Small buckets are one block.

    `hashed` has bucket and t of all rows, to count by.
    """
    large = hashed.groupBy("t", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > LARGE)
    large = stored(large.select(F.col("t").alias("l_t"), F.col("bucket").alias("l_bucket"), F.ceil(F.col("size") / LARGE).cast("int").alias("blocks")), f"{scratch}/large")
    few = large.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(large) if few else large, (F.col("t") == F.col("l_t")) & (F.col("bucket") == F.col("l_bucket")), "left")
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep", "embedding"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("bucket", "t", "rep", "n", "keys", "embedding", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j; `root` has each one's smallest member before and after."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def _counted(t: int, n: np.ndarray, keys: np.ndarray, v: np.ndarray, sides: list[np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row and its set's smallest row: `sides` is one block (pairs within it) or two (pairs across)."""
    links, root = np.zeros(len(n), np.int64), np.arange(len(n))
    one, two = sides[0], sides[-1]
    for at in range(0, len(one), ROWS):
        a = one[at : at + ROWS]
        for to in range(at if len(sides) == 1 else 0, len(two), ROWS):
            b = two[to : to + ROWS]
            i, j = np.nonzero(v[a] @ v[b].T >= cosine)
            i, j = a[i], b[j]
            if len(sides) == 1:
                i, j = i[i < j], j[i < j]
            for s in range(t):  # pairs that met in an earlier table count there
                new = keys[i, s] != keys[j, s]
                i, j = i[new], j[new]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            _joined(root, i, j)
    return links, root


def _linked(rows: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, root) from the groups' rows, a group's rows in turn."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[tuple] = []

        def flush() -> None:
            group = pa.Table.from_batches(held).combine_chunks()
            if group.num_rows > 1:
                lengths = np.asarray(group.column("embedding").combine_chunks().value_lengths())
                for d in np.unique(lengths).tolist():
                    g = group.filter(pa.array(lengths == d))
                    keys = np.frombuffer(b"".join(g.column("keys").to_pylist()), np.uint32).reshape(g.num_rows, -1)
                    x, y = g.column("x")[0].as_py(), g.column("y")[0].as_py()
                    sides = [np.flatnonzero(np.asarray(g.column("own")) == block) for block in sorted({x, y})]
                    links, root = _counted(g.column("t")[0].as_py(), np.asarray(g.column("n")), keys, _unit(g.column("embedding").combine_chunks(), d), sides, cosine)
                    rep, met = np.asarray(g.column("rep")), np.flatnonzero(links)
                    out.extend(zip(rep[met].tolist(), links[met].tolist(), rep[root[met]].tolist(), strict=True))
            held.clear()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["rep", "links", "root"])
            out.clear()
            return batch

        last = None
        for batch in batches:
            parts = [np.asarray(batch.column(c)) for c in ("t", "bucket", "x", "y")]
            edges = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in parts], axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                key = tuple(c[a] for c in parts)
                if held and key != last:
                    flush()
                held.append(batch.slice(a, b - a))
                last = key
            if len(out) > 10_000:
                yield made()
        if held:
            flush()
        if out:
            yield made()

    rows = rows.repartition("t", "bucket", "x", "y").sortWithinPartitions("t", "bucket", "x", "y")
    return rows.mapInArrow(work, "rep bigint, links bigint, root bigint")


def near_duplicates(vectors: DataFrame, scratch: str, cosine: float = COSINE, seed: int = 0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors`.

    Rows link when their cosine, in double precision, is `cosine` or more; vectors that are null, zero or hold null or
    non-finite components, and rows with a null id, link with nothing, nor do vectors of different lengths. Repeated rows
    are rows of their own and link with each other. Where an id stands for several vectors each row has its own vector's links, and all of
    them are one component. Other columns are left out. An empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    good = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    # Classes have numbers of their own, as an id can stand for several vectors; the number holds once the table is written.
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("rep"), "id", "n", "embedding"), f"{scratch}/classes")
    k, tables = shape(classes.count(), cosine)
    own = classes.select("rep", "n", "embedding")
    dealt = _dealt(_hashed(own, k, tables, seed), _hashed(own, k, tables, seed, whole=False), scratch)
    found = stored(_linked(dealt, cosine), f"{scratch}/linked")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    ids = classes.select("rep", "id")
    edges = found.select("rep", "root").join(ids.withColumnRenamed("id", "a"), "rep").join(ids.select(F.col("rep").alias("root"), F.col("id").alias("b")), "root").select("a", "b")
    again = good.groupBy("vec_id").agg(F.count("*").alias("times")).where("times > 1").select(F.col("vec_id").alias("again"))
    again = stored(again, f"{scratch}/again")
    if not again.isEmpty():  # an id of several vectors ties their classes
        tied = good.join(again, F.col("vec_id") == F.col("again"), "left_semi").join(classes.select("embedding", "id"), "embedding")
        edges = edges.union(tied.select("vec_id", "id"))
    parts = components(edges, f"{scratch}/components")
    known = classes.join(links, "rep", "left").join(parts, F.col("id") == F.col("node"), "left")
    known = stored(known.select(F.col("embedding").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component")), f"{scratch}/known")
    out = rows.join(known, (F.col("embedding") == F.col("v")) & usable(F.col("embedding")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
