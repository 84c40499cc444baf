"""Exact Jaccard join of word-shingle sets: pivots, Voronoi regions and triangle-inequality windows.

Two sets link when 100 |a & b| >= 80 |a | b|. In a metric space of texts nearly all distances are 1, so that pivots drawn
from the whole corpus part nothing (every window would admit every document). Regions are therefore seeded
exactly: under one global order of shingles, common ones last, linked sets share one of the first n - ceil(0.8 n) + 1
shingles of each; the documents that hold such a shingle, cut where sizes differ too much, are a cell, and the cell's
pivot draws them into its region. A document is replicated to the regions of all its cells, so both
ends of each link meet in one region.

Within a region the join goes on by pivots: those within the radius r = 0.2 of a pivot are linked to it and, for
their component, done with each other; a document at distance d of the pivot can link to one at distance e only
if |d - e| <= r, so only documents up to 2r (the boundary) meet members of the ball, each in its own window; all
outside the ball are joined recursively around the next pivot. Regions of more than `REGION` sets or `BYTES` of text are cut into
blocks whose pairs are tasks of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import texthash
from .common import freed, parts_for, stored
from .components import components

SHINGLE = 5
KIND = texthash.classes(b" \t\n\x0b\x0c\r", others=False)
CHUNK = 500_000
#: Values in one part of a shuffle, about: parts grow in number with the input, not in size.
EACH = 1_000_000
#: Shingles of fewer documents are never common; of more, at most `COMMON` (those of most documents) are known as such: a bound on
#: what is broadcast. It orders the shingles, and any order gives the same links.
RARE, COMMON = 32, 1 << 21
#: Sets, and bytes of text, in one block of a region.
REGION, BYTES = 4096, 32 << 20


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts of fewer words have their whole sequence as one."""
    tokens = texthash.Tokens(texts, KIND)
    h, of = tokens.grams(SHINGLE)
    words = np.bincount(tokens.text, minlength=len(texts))
    for n in range(1, SHINGLE):
        if (words == n).any():
            g, at = tokens.grams(n)
            short = words[at] == n
            h, of = np.concatenate([h, g[short]]), np.concatenate([of, at[short]])
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=len(texts)))
    return [np.unique(x) for x in np.split(h[order], ends[:-1])] if texts else []


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    for a, b, texts in texthash.pieces(batch.column(column), CHUNK):
        yield from zip(range(a, b), shingle_sets(texts), strict=True)


def _parted(part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows (part, blob, ...): the columns' values by part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(part))[: len(starts)]
    blobs = [pa.array([c[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()) for c in (c[order] for c in columns)]
    return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), *blobs], names=["part", *(f"c{i}" for i in range(len(columns)))])


def _by_part(batches: Iterable[pa.RecordBatch], kinds: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of each part in turn; rows come sorted by part."""
    last, held = None, [[] for _ in kinds]
    for batch in batches:
        for part, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != last and held[0]:
                yield [np.frombuffer(b"".join(x), k) for x, k in zip(held, kinds, strict=True)]
                held = [[] for _ in kinds]
            last = part
            for x, blob in zip(held, blobs, strict=True):
                x.append(blob)
    if held[0]:
        yield [np.frombuffer(b"".join(x), k) for x, k in zip(held, kinds, strict=True)]


def common_shingles(docs: DataFrame, scratch: str, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper 32 hash bits, count) of the shingles of most documents, sorted by hash: `COMMON` at most.

    Counts are added up within each task's buffers before they are shuffled, so that a shingle of very many documents is few rows.
    """

    def made(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return _parted((h.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32), h, n.astype(np.uint32))

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for _, s in _sets(batch, 1):
                held.append((s >> np.uint64(32)).astype(np.uint32))
                size += len(s)
                if size > 1_000_000:
                    yield made(held)
                    held, size = [], 0
            if held:
                yield made(held)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, times in _by_part(batches, ["<u4", "<u4"]):
            order = np.argsort(h, kind="stable")
            h, times = h[order], times[order].astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            h, n = h[starts], np.add.reduceat(times, starts)
            often = n >= RARE
            if often.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[often].astype(np.int64)), pa.array(n[often])], names=["h", "n"])

    rows = docs.mapInArrow(emit, "part int, c0 binary, c1 binary").repartition("part").sortWithinPartitions("part").mapInArrow(count, "h bigint, n bigint")
    rows = stored(rows, f"{scratch}/common")
    if rows.count() > COMMON:
        rows = rows.orderBy(F.desc("n"), "h").limit(COMMON)
    got = rows.toPandas()  # bounded by COMMON
    freed(docs.sparkSession, f"{scratch}/common")
    order = np.argsort(got["h"].to_numpy(np.int64))
    return got["h"].to_numpy(np.int64)[order].astype(np.uint32), got["n"].to_numpy(np.int64)[order]


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles: rare ones by hash, then common ones by count."""
    most = len(s) - (4 * len(s) + 4) // 5 + 1
    if not len(common):
        return s[:most]
    upper = (s >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(common, upper), len(common) - 1)
    rank = np.where(common[at] == upper, counts[at], 0)
    return s[np.argsort(rank, kind="stable")[:most]]


def cells(docs: DataFrame, common: np.ndarray, counts: np.ndarray, parts: int) -> DataFrame:
    """(sig, pivot): the regions of each set, by the first half of its signature. Copies within a task's buffer count once."""
    shared = docs.sparkSession.sparkContext.broadcast((common, counts))

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, seen = [], 0, set()

            def made() -> pa.RecordBatch:
                key = np.concatenate([k for k, _, _ in held])
                times = [len(k) for k, _, _ in held]
                sig = np.repeat(np.array([s for _, s, _ in held], np.int64), times)
                n = np.repeat(np.array([n for _, _, n in held], np.uint32), times)
                at = np.concatenate([np.arange(t, dtype=np.uint32) for t in times])
                return _parted((key >> np.uint64(12)) % np.uint64(parts), key, sig, n, at)

            for _, s in _sets(batch, 1):
                sig = signature(s)[0]
                if len(s) and sig not in seen:
                    seen.add(sig)
                    held.append((prefix(s, *shared.value), sig, len(s)))
                    size += len(held[-1][0])
                if size > 500_000:
                    yield made()
                    held, size, seen = [], 0, set()
            if held:
                yield made()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sig, n, at in _by_part(batches, ["<u8", "<i8", "<u4", "<u4"]):
            order = np.lexsort([sig, n, key])
            key, sig, n, at = key[order], sig[order], n[order], at[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])])
            key, sig, n, at = key[new], sig[new], n[new].astype(np.int64), at[new].astype(np.int64)
            # A cell ends with its shingle, or where the next size can't link to any before it.
            start = np.concatenate([[True], (key[1:] != key[:-1]) | (4 * n[1:] > 5 * n[:-1])])
            cell = np.cumsum(start) - 1
            times = np.bincount(cell)
            many = times[cell] > 1
            # Of two sets that share no shingle before this one, at most what follows it is common: 9 |a & b| >= 4 (m + n).
            first = np.flatnonzero(start)[times == 2]
            over = 9 * np.minimum(n[first] - at[first], n[first + 1] - at[first + 1]) < 4 * (n[first] + n[first + 1])
            many[first[over]] = many[first[over] + 1] = False
            if many.any():
                sig, starts = sig[many], np.flatnonzero(np.concatenate([[True], cell[many][1:] != cell[many][:-1]]))
                weight = texthash._mix(sig.astype(np.uint64))
                least = np.minimum.reduceat(weight, starts)
                size = np.diff(np.append(starts, len(sig)))
                first = np.flatnonzero(weight == np.repeat(least, size))
                pivots = np.empty(len(starts), np.int64)
                pivots[np.searchsorted(starts, first, "right") - 1] = sig[first]
                pairs = np.unique(np.stack([sig, np.repeat(pivots, size)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["sig", "pivot"])

    rows = docs.mapInArrow(emit, "part int, c0 binary, c1 binary, c2 binary, c3 binary").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(meet, "sig bigint, pivot bigint").distinct()


def region_links(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all that is connected within a region: a forest, by pivots, windows and recursion."""
    size = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    marked = np.zeros(len(names), bool)
    out: list[tuple[int, int]] = []

    def overlaps(p: int, some: np.ndarray) -> np.ndarray:
        own = flat[starts[p] : starts[p + 1]]
        marked[own] = True
        places = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in some.tolist()])
        got = np.add.reduceat(marked[flat[places]].astype(np.int64), np.concatenate([[0], np.cumsum(size[some])[:-1]]))
        marked[own] = False
        return got

    rest = np.argsort(-size, kind="stable")
    while len(rest) > 1:
        p, others = int(rest[0]), rest[1:]
        near = others[4 * size[p] <= 5 * size[others]]  # no set more than 1/4 smaller links to the largest left
        far = others[4 * size[p] > 5 * size[others]]
        both = overlaps(p, near) if len(near) else np.zeros(0, np.int64)
        union = size[p] + size[near] - both
        ball = 100 * both >= 80 * union
        out += [(ids[p], ids[i]) for i in near[ball].tolist()]
        inside, d_in = near[ball], 1 - both[ball] / union[ball]
        outside, d_out = near[~ball], 1 - both[~ball] / union[~ball]
        # d(x, y) <= 0.2 needs |d(x, p) - d(y, p)| <= 0.2; sets far smaller than p weren't measured and get no window.
        check = [(int(y), inside[d_in >= d - 0.2 - 1e-9]) for y, d in zip(outside.tolist(), d_out.tolist(), strict=True) if d <= 0.4 + 1e-9]
        check += [(int(y), inside) for y in far.tolist()] if len(inside) else []
        for y, window in check:
            window = window[(4 * size[y] <= 5 * size[window]) & (4 * size[window] <= 5 * size[y])]
            if len(window):
                got = overlaps(y, window)
                hit = np.flatnonzero(100 * got >= 80 * (size[y] + size[window] - got))
                if len(hit):
                    out.append((ids[y], ids[int(window[hit[0]])]))
        rest = np.concatenate([outside, far])
        rest = rest[np.argsort(-size[rest], kind="stable")]
    return out


def links(docs: DataFrame, reps: DataFrame, scratch: str, n_shingles: int) -> DataFrame:
    """(a, b): links between distinct sets, by the ids of their representatives, enough of them to connect all components.

    `reps` has doc_id, sig, sig2 and n_bytes of each distinct set, n_shingles is their sum over all documents. Texts are brought to
    their regions by id, and only those of representatives with a region; the sets are made there.
    """
    spark, parts = docs.sparkSession, parts_for(n_shingles, EACH)
    common = common_shingles(docs, scratch, parts)
    regions = stored(cells(docs, *common, parts), f"{scratch}/regions")
    member = regions.join(reps.withColumnRenamed("sig", "s"), F.col("sig") == F.col("s")).select("doc_id", "sig", "n_bytes", "pivot")
    sizes = member.groupBy(F.col("pivot").alias("p")).agg(F.greatest(F.ceil(F.count("*") / REGION), F.ceil(F.sum("n_bytes") / BYTES)).alias("blocks"))
    sizes = stored(sizes.where("blocks > 1"), f"{scratch}/large")
    own = member.join(sizes, F.col("pivot") == F.col("p"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")))
    own = own.select("doc_id", "sig", "pivot", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    own = own.groupBy(F.col("doc_id").alias("d"), F.col("sig").alias("s")).agg(F.collect_set(F.struct("pivot", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))).alias("regions"))
    own = stored(own, f"{scratch}/members")
    # Both sides are shuffled at any size: what a small table would broadcast grows with the input.
    shipped = docs.join(own.hint("merge"), F.col("doc_id") == F.col("d")).select("doc_id", "s", "text", F.explode("regions").alias("r")).select("r.pivot", "r.x", "r.y", "doc_id", "s", "text")

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        last = None

        def solved() -> pa.RecordBatch:
            found = region_links([i for i, _ in held.values()], [s for _, s in held.values()]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True))
            for at, s in _sets(batch, 5):
                *region, doc, wanted = keys[at]
                if region != last:
                    if len(held) > 1:
                        yield solved()
                    held, last = {}, region
                sig, sig2 = signature(s)
                if sig == wanted:  # else another text with this id
                    held[sig, sig2] = min(held.get((sig, sig2), (doc,))[0], doc), s
        if len(held) > 1:
            yield solved()

    return shipped.repartition("pivot", "x", "y").sortWithinPartitions("pivot", "x", "y").mapInArrow(join, "a bigint, b bigint")


def _classes(docs: DataFrame, scratch: str, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, sig, sig2, component) for each row; the component is its set's, null without words or any id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(len(s), *signature(s)) for _, s in _sets(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array([g[k] for g in got], pa.int64()) for k in range(3))], names=["doc_id", "text_hash", "n_bytes", "n_shingles", "sig", "sig2"])

    known = rows.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    known = stored(known.mapInArrow(measure, "doc_id bigint, text_hash bigint, n_bytes bigint, n_shingles bigint, sig bigint, sig2 bigint"), f"{scratch}/sets")
    reps = known.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sig", "sig2").agg(F.min("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"))
    reps = stored(reps, f"{scratch}/classes")
    total = known.agg(F.sum("n_shingles")).first()[0] or 0
    found = stored(links(rows.where("doc_id IS NOT NULL"), reps, scratch, total), f"{scratch}/links")
    parts = components(found, f"{scratch}/components")
    classes = reps.join(parts, F.col("doc_id") == F.col("node"), "left")
    classes = stored(classes.select(F.col("sig").alias("s"), F.col("sig2").alias("s2"), F.coalesce("component", "doc_id").alias("component")), f"{scratch}/known")
    freed(docs.sparkSession, *(f"{scratch}/{name}" for name in ("classes", "regions", "large", "members", "links")))
    out = known.join(classes, (F.col("sig") == F.col("s")) & (F.col("sig2") == F.col("s2")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "text_hash", "n_shingles", "sig", "sig2", "component")


def joined(docs: DataFrame, scratch: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`.

    Null and wordless texts have an empty set and link with nothing; rows with a null id have a null component and link
    with nothing. Equal sets are one class (of the smallest id) before the join, repeated rows with them. Other
    columns are left out. An empty table gives no rows.
    """
    out = _classes(docs, scratch, doc_id, text)
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, scratch: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they were, without near-duplicates: one row of each component.

    It is one with the smallest id (then the smallest hash of its text); of equal rows of that id and text, any one. Rows without an id
    count as copies of rows with an equal set alone, and stay only if none of those has an id. Rows without words all stay. An empty table gives no rows.
    """
    found = _classes(docs, scratch, doc_id, text).where("n_shingles > 0")
    group = F.coalesce(F.col("component").cast("string"), F.concat_ws(":", "sig", "sig2"))
    keys = found.groupBy(group.alias("of"), "doc_id", "text_hash").agg(F.count("*").alias("n"))
    keys = stored(keys, f"{scratch}/keys")
    best = keys.groupBy("of").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("best")).withColumnRenamed("of", "o")
    first = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("text_hash") == F.col("best.hash"))
    marks = keys.join(best, F.col("of") == F.col("o")).select(F.col("doc_id").alias("__j_id"), F.col("text_hash").alias("__j_hash"), first.alias("__j_first"), "n")
    marks = stored(marks.where("NOT __j_first OR n > 1").drop("n"), f"{scratch}/marks")
    freed(docs.sparkSession, *(f"{scratch}/{name}" for name in ("sets", "known", "keys")))
    same = docs[doc_id].cast("long").eqNullSafe(marks["__j_id"]) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == marks["__j_hash"])
    others = docs.join(marks.hint("merge"), same, "left_anti")
    again = docs.join(marks.where("__j_first").hint("merge"), same).withColumn("__j_key", F.struct("__j_id", "__j_hash"))
    return others.union(again.dropDuplicates(["__j_key"]).select(docs.columns))
