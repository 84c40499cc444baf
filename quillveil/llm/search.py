"""Ranked lexical search over norm buckets.

A document is an impact vector over the terms of the items: for each the saturated, length-normalised frequency, times the square root
of the term's weight; an item has the square roots of its terms' weights, so that their product is the score. Vectors are
ordered by length and cut into buckets of neighbours. Of each item and bucket, Cauchy-Schwarz bounds the best score by the two
lengths, and a bucket that can't reach the item's threshold (its 50th best score so far) is passed over; inside a bucket
the item's heaviest coordinates, with the bucket's largest impact in each, tell how many of them must be looked
at until no other document can reach the threshold, and the candidates found there fall out as soon as the rest can't lift
them to it. Survivors are scored anew in 64-bit integers. Thresholds start with the scores of the longest vectors.

All documents are compared with all items, in blocks of items of bounded size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import texthash
from .common import ascii_lower, freed, parts_for, stored

#: Documents returned for an item.
TOP = 50
#: Terms of the items searched for at once, repeats across items counted: what is sent to all tasks is bounded by it (or by one item's terms).
BLOCK = 1 << 20
#: Vectors of one bucket, and the longest ones that set the first thresholds.
BUCKET, FIRST = 2048, 4096
#: Vectors of one part of the shuffle, about.
EACH = 16_384
CHUNK = 500_000
#: Bounds are in doubles; they are widened by this much.
SLACK = 1 + 1e-9

_BREAKS = bytes(c for c in range(128) if not chr(c).isalnum())
_KIND = texthash.classes(_BREAKS, others=False)


def terms(text: Column) -> Column:
    """Runs of A-Z (in lower case), a-z, 0-9 and all that isn't ASCII. Null has none."""
    return F.array_remove(F.split(ascii_lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def item_blocks(items: DataFrame, scratch: str, item_id: str = "item_id", text: str = "text", most: int = BLOCK) -> Iterator[list[tuple[object, list[str]]]]:
    """(item, its distinct terms) in blocks of `most` terms in all, or of one item. Rows of one id are one item."""
    rows = items.select(F.col(item_id).alias("item"), F.explode(F.array_distinct(terms(F.col(text).cast("string")))).alias("term")).distinct()
    rows = stored(rows.groupBy("item").agg(F.collect_set("term").alias("terms")).withColumn("n", F.size("terms")), f"{scratch}/items")
    block, held = [], 0
    for item, own, n in rows.orderBy("item").toLocalIterator(prefetchPartitions=False):
        if block and held + n > most:
            yield block
            block, held = [], 0
        block.append((item, own))
        held += n
    if block:
        yield block


class Vocabulary:
    """Numbers of the terms of a block, found by hash and then compared by their bytes."""

    def __init__(self, names: list[bytes]):
        ends = np.cumsum([len(x) for x in names], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(names), np.uint8)
        h = texthash.hashes(self.bytes, starts, ends)
        order = np.argsort(h, kind="stable")
        self.hash, self.number, self.starts, self.ends = h[order], order, starts, ends

    def __call__(self, t: texthash.Tokens) -> np.ndarray:
        """The number of each token's term, -1 where it is none."""
        out = np.full(len(t.hash), -1, np.int64)
        if not len(self.hash):
            return out
        at, todo = np.searchsorted(self.hash, t.hash), np.arange(len(t.hash))
        while len(todo):  # once, but for terms of equal hash
            todo = todo[(at[todo] < len(self.hash))]
            todo = todo[self.hash[at[todo]] == t.hash[todo]]
            number = self.number[at[todo]]
            same = self.ends[number] - self.starts[number] == t.ends[todo] - t.starts[todo]
            same[same] = self._equal(t, todo[same], number[same])
            out[todo[same]] = number[same]
            todo = todo[~same]
            at[todo] += 1
        return out

    def _equal(self, t: texthash.Tokens, i: np.ndarray, number: np.ndarray) -> np.ndarray:
        size = t.ends[i] - t.starts[i]
        same = np.ones(len(i), bool)
        for k in range(int(size.max(initial=0))):
            left = np.flatnonzero(size > k)
            if not len(left):
                break
            same[left] &= t.bytes[t.starts[i[left]] + k] == self.bytes[self.starts[number[left]] + k]
        return same


def vectors(docs: DataFrame, names: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, times): each document's number of terms, and the block's terms that it has (numbers and occurrences, 32 bits each)."""
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        width = max(1, len(shared.value))
        for batch in batches:
            for a, b, texts in texthash.pieces(batch.column(1), CHUNK):
                t = texthash.Tokens(texts, _KIND)
                n = np.bincount(t.text, minlength=b - a)
                number = vocabulary(t)
                own = number >= 0
                pair, times = np.unique(t.text[own] * width + number[own], return_counts=True)
                edges = np.searchsorted(pair // width, np.arange(b - a + 1))
                which, times = (pair % width).astype(np.int32), times.astype(np.int32)
                cut = [(which[x:y].tobytes(), times[x:y].tobytes()) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), *(pa.array([c[k] for c in cut], pa.binary()) for k in (0, 1))], names=["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string"))
    return rows.mapInArrow(work, "doc_id bigint, n bigint, terms binary, times binary").where("n > 0")


def document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the block's `size` terms occurs."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                sums[np.frombuffer(blob, np.int32)] += 1
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for term, n in rows.select("terms").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect():  # the block's terms at most
        out[term] = n
    return out


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def impacts(n: np.ndarray, times: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """The integer impact of terms that occur `times` times in documents of n terms."""
    m = 100 - 50 + 50 * n * n_docs // n_all
    return 1_000_000_000 * times // (1000 * times + 20 * m)


class Bucket:
    """Vectors of neighbouring lengths, by term."""

    def __init__(self, ids: np.ndarray, each: list[np.ndarray], impact: np.ndarray, weight: np.ndarray):
        self.ids = ids
        term = np.concatenate(each) if each else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
        self.length = math.sqrt(np.bincount(doc, weights=weight[term] * impact.astype(float) ** 2, minlength=1).max())
        order = np.argsort(term, kind="stable")
        term, self.doc, self.impact = term[order], doc[order], impact[order]
        self.names, at = np.unique(term, return_index=True)
        self.starts, self.ends = at, np.append(at[1:], len(term))
        self.most = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0, np.int64)

    def search(self, own: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers within the bucket) that score `least` or more for an item of terms `own`, and their scores."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.names, own)
        inside = at < len(self.names)
        inside[inside] = self.names[at[inside]] == own[inside]
        at, w = at[inside], weight[own[inside]]
        if not len(at) or math.sqrt(float(weight[own].sum())) * self.length * SLACK < least:
            return none
        bound = w * self.most[at]
        order = np.argsort(-bound, kind="stable")
        at, w = at[order], w[order]
        rest = np.append(np.cumsum(bound[order][::-1])[::-1][1:], 0)  # what the coordinates after each can add at most
        if bound.sum() < least:
            return none
        score, seen, live = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool), None
        for k in range(len(at)):
            a, b = self.starts[at[k]], self.ends[at[k]]
            score[self.doc[a:b]] += w[k] * self.impact[a:b]
            if live is None:
                seen[self.doc[a:b]] = True
                if rest[k] < least:  # no document without one of these coordinates can reach it
                    live = np.flatnonzero(seen & (score + rest[k] >= least))
            elif len(live) > 64 or k == len(at) - 1:
                live = live[score[live] + rest[k] >= least]
            if live is not None and not len(live):
                return none
        found = live if live is not None else np.flatnonzero(seen)
        exact = score[found]
        good = (exact >= least) & (exact > 0)
        return found[good], exact[good]


class Best:
    """The TOP best (score, then smallest id) of each item."""

    def __init__(self, least: np.ndarray):
        self.least, self.held = least.copy(), [[] for _ in least]

    def add(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        held = self.held[item]
        for pair in zip(scores.tolist(), (-ids).tolist(), strict=True):
            if len(held) < TOP:
                heapq.heappush(held, pair)
            elif pair > held[0]:
                heapq.heapreplace(held, pair)
        if len(held) == TOP:
            self.least[item] = max(self.least[item], held[0][0])


def searched(rows: DataFrame, shared) -> DataFrame:
    """(item, doc_id, score): for each part of `rows` (doc_id, n, terms, times; longest first) its best documents of each item of the block.

    `shared` has the items' terms, the weights, the thresholds, and the numbers of documents and of all terms.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, least, n_docs, n_all = shared.value
        best = Best(least)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                ids, n, which, times = (batch.column(k).slice(at, BUCKET) for k in range(4))
                each = [np.frombuffer(x, np.int32) for x in which.to_pylist()]
                of = np.repeat(n.to_numpy(zero_copy_only=False), [len(x) for x in each])
                impact = impacts(of, np.frombuffer(b"".join(times.to_pylist()), np.int32).astype(np.int64), n_docs, n_all)
                bucket = Bucket(ids.to_numpy(zero_copy_only=False), each, impact, weight)
                for k, own in enumerate(items):
                    best.add(k, *_named(bucket, bucket.search(own, weight, max(1, int(best.least[k])))))
        out = [(k, -i, s) for k, held in enumerate(best.held) for s, i in held]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=["item", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "times").mapInArrow(work, "item int, doc_id bigint, score bigint")


def _named(bucket: Bucket, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return bucket.ids[found[0]], found[1]


def with_length(rows: DataFrame, shared) -> DataFrame:
    """`rows` with the length of each vector."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, weight, _, n_docs, n_all = shared.value
        for batch in batches:
            each = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            sizes = [len(x) for x in each]
            impact = impacts(np.repeat(batch.column(1).to_numpy(), sizes), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int32).astype(np.int64), n_docs, n_all)
            square = weight[np.concatenate(each)] * impact.astype(float) ** 2 if each else np.zeros(0)
            length = np.sqrt(np.bincount(np.repeat(np.arange(len(each)), sizes), weights=square, minlength=len(each)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length)], names=["doc_id", "n", "terms", "times", "length"])

    return rows.mapInArrow(work, "doc_id bigint, n bigint, terms binary, times binary, length double")


def ranked(docs: DataFrame, items: DataFrame, scratch: str, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the `TOP` best documents of each item, see the contract of the query.

    Null and termless texts have no terms: such documents don't count, such items give no rows. Rows with one item id are one item of
    all their terms; a null item id is an id like others. Each row of `docs` is a document, repeated rows too (they rank side by side); rows
    without an id count in the statistics but aren't returned. Other columns are left out, whatever their names. Empty tables give no rows.
    """
    spark, out = docs.sparkSession, None
    schema = f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id bigint, score bigint"
    for at, own in enumerate(item_blocks(items, scratch, item_id, item_text, block)):
        names = sorted({t for _, ts in own for t in ts})
        number = {t: k for k, t in enumerate(names)}
        rows = stored(vectors(docs, [t.encode() for t in names], doc_id, text), f"{scratch}/vectors-{at}")
        n_docs, n_all = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        weight = weights(n_docs, document_counts(rows, len(names)))
        rows = rows.where("doc_id IS NOT NULL AND octet_length(terms) > 0")
        terms_of = [np.array(sorted(number[t] for t in ts), np.int64) for _, ts in own]

        def given(least: np.ndarray):
            return spark.sparkContext.broadcast((terms_of, weight, least, n_docs, n_all))

        shared = given(np.zeros(len(own), np.int64))
        measured = with_length(rows, shared)
        longest = stored(measured.orderBy(F.desc("length"), "doc_id").limit(FIRST), f"{scratch}/longest-{at}")
        # Any TOP documents give a threshold, those of the longest vectors a good one.
        first = searched(longest.repartition(max(1, FIRST // BUCKET)), shared)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        first = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == TOP)
        least = np.zeros(len(own), np.int64)
        for item, score in first.select("item", "score").collect():  # a row an item of the block
            least[item] = score
        # Equal lengths (copies) are dealt by id.
        dealt = measured.repartitionByRange(parts_for(n_docs, EACH), F.desc("length"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("length"))
        found = searched(dealt, given(least))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
        ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(own)], f"item int, item_id {items.schema[item_id].dataType.simpleString()}")
        part = stored(found.join(ids.hint("merge"), "item").select("item_id", "rank", "doc_id", "score"), f"{scratch}/found-{at}")
        freed(spark, f"{scratch}/vectors-{at}", f"{scratch}/longest-{at}")
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)
