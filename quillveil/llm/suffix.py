"""Repeated byte strings: shard Burrows-Wheeler transforms merged by iterative interleave refinement.

Every string of `LENGTH` bytes that starts at two places is found, whole corpus and all texts through:

1. Each window of `LENGTH` bytes has an anchor, the place of its least `GRAM`-byte hash; equal windows have equal grams
   at equal distances, so a shuffle by the gram's hash brings all occurrences together, about one row for 65 bytes.
2. An anchor's surroundings hold all windows that it stands for. Where the same surroundings occur twice, all of
   them repeat. Where surroundings differ, windows may still be shared in part: those go to step 3.
3. Different surroundings of one gram, halved by the bytes next to it (each window has half of the rest on one side of
   the gram, so a very common line alone never makes a large group), form collections of aligned strings. Each shard
   of a collection has its transform, column by column; shards are merged by refining their interleave from the last
   column to the first: a column's order follows from the next one's by a stable partition by the transforms'
   characters, with no suffix sorted again. Common prefixes of neighbours come along as range minima, and where they
   reach `LENGTH` the neighbours are in one repeated interval.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import texthash
from .common import freed, parts_for, stored
from .jaccard import _by_part, _parted

LENGTH, GRAM = 200, 72
#: Bytes of a window beside its gram, which are the reach of an anchor to either side, and half of them.
REST = LENGTH - GRAM
HALF = REST // 2
#: Width of the strings of step 3: the gram, half of the rest on one side and all of it on the other.
WIDTH = GRAM + HALF + REST
PAD = 256
#: Anchors in one part of a shuffle, about: parts grow in number with the input, not in size.
EACH = 250_000
CHUNK = 500_000
#: Strings of one shard, and strings merged in one go (whole groups).
SHARD, MERGED = 4096, 16384


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] for each i with a whole window."""
    done, n = x, 1
    while n * 2 <= width:
        done, n = best(done[:-n], done[n:]), n * 2
    return best(done[: len(x) - width + 1], done[width - n : width - n + len(x) - width + 1])


class Joined:
    """Several texts' bytes end to end, with running sums from which any span's hash comes."""

    def __init__(self, texts: list[bytes]):
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = self.ends - [len(t) for t in texts]
        texthash._reach(len(self.bytes) + 1)
        self.sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(texthash._BYTES[self.bytes] * texthash._powers[: len(self.bytes)], out=self.sums[1:])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return texthash._mix((self.sums[b] - self.sums[a]) * texthash._inverse[a] + (b - a).astype(np.uint64))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all windows' least grams, their texts and the grams' hashes (equal least grams of a window: all)."""
        n = len(self.bytes)
        if n < LENGTH:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64)
        at = np.arange(n - GRAM + 1)
        h = self.hash(at, at + GRAM)
        least = _sliding(h, REST + 1, np.minimum)
        text = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)
        whole = text[: len(least)] == text[LENGTH - 1 : LENGTH - 1 + len(least)]
        least = np.where(whole, least, 0)
        pad = np.zeros(REST, np.uint64)
        reach = _sliding(np.concatenate([pad, least, pad]), REST + 1, np.maximum)
        p = np.flatnonzero(reach == h)
        return p, text[p], h[p]


def _chunked(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    for a, _, texts in texthash.pieces(batch.column(column), CHUNK):
        yield a, texts


def occurrences(docs: DataFrame, parts: int) -> DataFrame:
    """(key, at, gram, kind): each anchor whose gram occurs again. kind 0: so do its whole surroundings; 1: they occur
    once; 2: one of several equal surroundings, beside others (a partner for those that occur once)."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for first, texts in _chunked(batch, 1):
                j = Joined(texts)
                p, text, h = j.anchors()
                if len(p):
                    a, b = np.maximum(p - REST, j.starts[text]), np.minimum(p + GRAM + REST, j.ends[text])
                    around = texthash._mix(j.hash(a, b) + (p - a).astype(np.uint64))
                    yield _parted((h >> np.uint64(20)) % np.uint64(parts), h, around, keys[first + text], (p - j.starts[text]).astype(np.uint32))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, around, key, at in _by_part(batches, ["<u8", "<u8", "<i8", "<u4"]):
            order = np.lexsort([around, h])
            h, around, key, at = h[order], around[order], key[order], at[order]
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new = new_h | np.concatenate([[True], around[1:] != around[:-1]])
            each = np.cumsum(new) - 1
            of = np.cumsum(new_h) - 1
            alone = np.bincount(each)[each] == 1
            kinds = np.bincount(of[new])[of]  # different surroundings of the gram
            outs = []
            for kind, some in ((0, ~alone), (1, alone & (kinds > 1)), (2, ~alone & (kinds > 1) & new)):
                if some.any():
                    outs.append((key[some], at[some], h[some], np.full(some.sum(), kind, np.int32)))
            if outs:
                key, at, h, kind = (np.concatenate(x) for x in zip(*outs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(at.astype(np.int32)), pa.array(h.astype(np.int64)), pa.array(kind)], names=["key", "at", "gram", "kind"])

    rows = docs.mapInArrow(emit, "part int, c0 binary, c1 binary, c2 binary, c3 binary").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(meet, "key bigint, at int, gram bigint, kind int")


class Shard:
    """The transform of one collection of aligned strings (rows of `s`): for each column the suffixes' order, and the
    characters before them in that order."""

    def __init__(self, s: np.ndarray):
        m, width = s.shape
        self.order = np.zeros((width + 1, m), np.int32)
        self.before = np.zeros((width + 1, m), np.uint16)
        order = np.arange(m, dtype=np.int32)
        for c in range(width, 0, -1):
            self.order[c] = order
            self.before[c] = s[order, c - 1]
            order = order[np.argsort(self.before[c], kind="stable")]
        self.order[0] = order


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of x[a : b] for each a < b."""
    out, width = np.empty(len(a), x.dtype), b - a
    level, table = 1, x
    todo = width > 0
    while todo.any():
        now = todo & (width < 2 * level)
        out[now] = np.minimum(table[a[now]], table[b[now] - level])
        todo &= ~now
        if todo.any():
            table = np.minimum(table[:-level], table[level:])
            level *= 2
    return out


def repeated(shards: list[Shard], groups: list[np.ndarray], width: int, length: int, columns: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Merge shards; for each of the first `columns` columns, which strings (shard, row) share `length` characters there
    with another of their group (`groups`: a number for each string of each shard).

    The interleave starts as shard after shard, right for empty suffixes. Refining it to a column takes the shards'
    characters of the column in the next one's interleave and parts it stably by them.
    """
    sizes = [s.order.shape[1] for s in shards]
    z = np.repeat(np.arange(len(shards)), sizes)
    common = np.zeros(len(z), np.int32)  # with the suffix before, in this order
    for c in range(width, 0, -1):
        chars = np.empty(len(z), np.uint16)
        for k, s in enumerate(shards):
            chars[z == k] = s.before[c]
        part = np.argsort(chars, kind="stable")
        z, chars = z[part], chars[part]
        fresh = np.zeros(len(z), np.int32)
        same = np.flatnonzero((chars[1:] == chars[:-1]) & (chars[1:] < PAD)) + 1
        if len(same):
            fresh[same] = 1 + _range_min(common, part[same - 1] + 1, part[same] + 1)
        common = fresh
        if c - 1 < columns:
            joined = np.append(common >= length, False)
            hit = np.flatnonzero(joined[:-1] | joined[1:])
            if len(hit):
                row, group = np.empty(len(z), np.int64), np.empty(len(z), np.int64)
                for k, s in enumerate(shards):
                    row[z == k] = s.order[c - 1]
                    group[z == k] = groups[k][s.order[c - 1]]
                interval = np.cumsum(~joined[:-1])[hit]
                _, each, times = np.unique(np.stack([interval, group[hit]], 1), axis=0, return_inverse=True, return_counts=True)
                hit = hit[times[each.ravel()] > 1]
                if len(hit):
                    yield c - 1, z[hit], row[hit]


def partial_spans(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, start, end): what is repeated of surroundings that occur once. `asked`: (key, at, gram, kind), kinds 1 and 2."""
    asked = asked.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("at", "gram", "kind")).alias("asked"))
    rows = docs.join(asked, F.col("key") == F.col("k")).select("key", "text", "asked").dropDuplicates(["key"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple] = []
            for key, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = text.encode()
                for w in wanted:
                    p = w["at"]
                    for side, a, near in ((0, p - REST, (p - HALF, p)), (1, p - HALF, (p + GRAM, p + GRAM + HALF))):
                        if near[0] < 0 or near[1] > len(b):
                            continue
                        lo, hi = max(a, 0), min(a + WIDTH, len(b))
                        group = hashlib.blake2b(b"%d %d " % (w["gram"], side) + b[near[0] : near[1]], digest_size=8).digest()
                        got.append((int.from_bytes(group, "little", signed=True), key, a, lo - a, w["kind"], b[lo:hi]))
                if len(got) > 20_000:
                    yield made(got)
                    got = []
            if got:
                yield made(got)

    def made(got: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate(types)], names=["bucket", "key", "start", "skip", "kind", "bytes"])

    strings = rows.mapInArrow(cut, "bucket bigint, key bigint, start int, skip int, kind int, bytes binary")

    def solve(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        s, group = np.full((len(rows), WIDTH), PAD, np.uint16), np.array([r[-1] for r in rows])
        for i, (_, _, skip, _, b, _) in enumerate(rows):
            s[i, skip : skip + len(b)] = np.frombuffer(b, np.uint8)
        shards = [Shard(s[i : i + SHARD]) for i in range(0, len(rows), SHARD)]
        low, high = np.full(len(rows), -1), np.full(len(rows), -1)
        for c, z, row in repeated(shards, np.split(group, range(SHARD, len(rows), SHARD)), WIDTH, LENGTH, WIDTH - LENGTH + 1):  # columns from right to left
            i = z * SHARD + row
            apart = (low[i] > c + LENGTH) & (low[i] >= 0)  # a gap: what is behind it is a span of its own
            for j in i[apart].tolist():
                yield rows[j][0], rows[j][1] + int(low[j]), rows[j][1] + int(high[j])
            high[i] = np.where(apart | (low[i] < 0), c + LENGTH, high[i])
            low[i] = c
        for j in np.flatnonzero(low >= 0).tolist():
            yield rows[j][0], rows[j][1] + int(low[j]), rows[j][1] + int(high[j])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        last = None

        def out() -> pa.RecordBatch:
            found = list(solve(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["key", "start", "end"])

        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != last:
                    if len(group) > 1:
                        held.extend(group)
                    group, last = [], bucket
                    if len(held) >= MERGED:
                        yield out()
                group.append((*row, bucket))
        if len(group) > 1:
            held.extend(group)
        if held:
            yield out()

    return strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "key bigint, start int, end int")


def deduplicated(docs: DataFrame, scratch: str, doc_id: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row; with `texts` also kept (binary).

    Each byte covered by a string of `LENGTH` bytes that also starts anywhere else, in this text or another, goes; overlaps
    count, and all is judged on the input. Null texts count as empty. Repeated rows are texts of their own and repeat each
    other. Other columns are left out. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    long = rows.where(F.octet_length("text") >= LENGTH).select("key", "text")
    n_bytes = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = stored(occurrences(long, parts_for(n_bytes // 65, EACH)), f"{scratch}/occurrences")
    spans = stored(partial_spans(long, found.where("kind > 0")), f"{scratch}/partial")
    whole = found.where("kind = 0").select("key", F.col("at").alias("start"), F.lit(-1).alias("end"))
    spans = whole.unionByName(spans).groupBy(F.col("key").alias("k")).agg(F.collect_list("start").alias("a"), F.collect_list("end").alias("b"))
    joined = rows.join(spans, F.col("key") == F.col("k"), "left").select("doc_id", "text", "a", "b")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, a, b in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                raw = text.encode()
                n, removed, n_spans, kept = len(raw), 0, 0, raw
                if a:
                    a, b = np.array(a, np.int64), np.array(b, np.int64)
                    a, b = np.where(b < 0, np.maximum(a - REST, 0), a), np.where(b < 0, np.minimum(a + GRAM + REST, n), b)
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.concatenate([[True], a[1:] > b[:-1]])
                    first, last = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                    removed, n_spans = int((last - first).sum()), len(first)
                    kept = b"".join(raw[x:y] for x, y in zip([0, *last.tolist()], [*first.tolist(), n], strict=True))
                out.append((n, removed, n_spans, hashlib.sha256(kept).hexdigest(), kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 4 + texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate(types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts)
