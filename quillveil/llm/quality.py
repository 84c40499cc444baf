"""Importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample by their ratio.

The models are bags of hashed words and pairs of words (runs of letters and digits, or of other ASCII). Target text is what is
labelled as wanted, raw text all documents. Three generative views of a text are taken together: which words
it holds (each once), how often it has each word, and how often each pair of neighbours. A gram's log ratio of target
and raw probability is taken without the text's own share, so that a rare word isn't held against the text that brings it, and
moved towards 0 by `SURE` standard errors (of document counts: a word that one text repeats is one observation), so
that chance counts weigh nothing. A text's log importance is the sum over its grams; Gumbel noise of scale 1,
fixed by document id and seed, makes the k largest keys a sample without replacement in proportion to importance.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from . import texthash
from .common import freed, stored

ORDERS = (1, 2)
#: Hash buckets of each n.
WIDTH = 1 << 20
BUCKETS = len(ORDERS) * WIDTH
SURE = 1.0
#: Share of labelled wanted documents that the sample size is to keep.
KEEP = 0.99
#: Labelled rows used, about so many at most: those whose ids hash low.
LABELS = 1 << 18
#: Parts in which a model's counts are shuffled.
PARTS = 256
CHUNK = 500_000

KIND = texthash.classes(b" \t\n\r\x0b\x0c", others=True)
_LOW = np.uint64((1 << 40) - 1)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, text number and count of each text's distinct words and pairs."""
    tokens, out = texthash.Tokens(texts, KIND), []
    for n in ORDERS:
        h, text = tokens.grams(n)
        each, times = np.unique((h & _LOW) | (text.astype(np.uint64) << np.uint64(40)), return_counts=True)
        bucket = (texthash._mix(each & _LOW) % np.uint64(WIDTH)).astype(np.int64) + (n - 1) * WIDTH
        out.append((bucket, (each >> np.uint64(40)).astype(np.int64), times))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def wanted_ids(labels: DataFrame, wanted, doc_id: str = "doc_id", most: int = LABELS) -> np.ndarray:
    """Sorted ids of the wanted documents among about `most` labelled ones, by a threshold on the hashes of their ids:
    bounded, so collected. An id that is labelled twice is wanted if all its labels say so."""
    wanted = F.expr(wanted) if isinstance(wanted, str) else wanted
    rows = labels.where(F.col(doc_id).isNotNull())
    share = min(1.0, most / max(1, rows.count()))
    rows = rows.withColumn("__wanted", F.coalesce(wanted, F.lit(False))).where(F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    rows = rows.groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.every("__wanted").alias("wanted")).where("wanted")
    return np.sort(np.array([r[0] for r in rows.select("id").collect()], np.int64))


def _among(ids: np.ndarray, column: pa.Array) -> np.ndarray:
    values = np.array([-1 if x is None else x for x in column.to_pylist()], np.int64)
    none = np.array([x is None for x in column.to_pylist()], bool)
    at = np.minimum(np.searchsorted(ids, values), max(0, len(ids) - 1))
    return (ids[at] == values) & ~none if len(ids) else np.zeros(len(values), bool)


def fitted(docs: DataFrame, ids: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all documents, and the totals behind them.

    The first has four rows: documents of target and raw text that have the bucket, and its occurrences in each. The second
    has documents of target and raw text, and for each n their occurrences. Each task counts its texts and hands
    on its sums in `PARTS` parts; the model has a fixed size, in single precision.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ids)
    width = BUCKETS // PARTS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((4, BUCKETS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            target = _among(shared.value, batch.column(0))
            n += (target.sum(), len(target))
            for a, b, texts in texthash.pieces(batch.column(1), CHUNK):
                bucket, of, times = grams(texts)
                own = target[a:b][of]
                np.add.at(sums[0], bucket[own], 1)
                np.add.at(sums[1], bucket, 1)
                np.add.at(sums[2], bucket[own], times[own])
                np.add.at(sums[3], bucket, times)
        for k in range(PARTS if n[1] else 0):
            part = sums[:, k * width : (k + 1) * width].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["part", "sums", "n"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, sums, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = held.setdefault(part, [np.zeros(4 * width, np.int64), np.zeros(2, np.int64)])
                mine[0] += np.frombuffer(sums, np.int32)
                mine[1] += np.frombuffer(n, np.int64)
        for part, (sums, n) in held.items():
            occurrences = sums.reshape(4, width)[2:].sum(1)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.astype(np.float32).tobytes()], pa.binary()), pa.array([np.concatenate([n, occurrences]).tobytes()], pa.binary())], names=["part", "sums", "n"])

    schema = "part int, sums binary, n binary"
    counted = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(count, schema)
    model, totals = np.zeros((4, BUCKETS), np.float32), np.zeros((1 + len(ORDERS), 2), np.int64)
    for part, sums, n in counted.repartition(PARTS, "part").mapInArrow(add, schema).collect():  # a fixed size
        model[:, part * width : (part + 1) * width] = np.frombuffer(sums, np.float32).reshape(4, width)
        n = np.frombuffer(n, np.int64)
        totals[0] = n[:2]
        totals[1 + part * width // WIDTH] += n[2:]
    return model, totals


def log_importance(model: np.ndarray, totals: np.ndarray, bucket: np.ndarray, times: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What each distinct gram of a text adds, `own`: the text belongs to the target, and its share isn't counted."""
    seen_docs, raw_docs, seen, raw = model[:, bucket].astype(np.float64)
    share_docs = totals[0, 0] / totals[0, 1]
    seen_docs, due_docs = np.maximum(seen_docs - own, 0) + 1, np.maximum(raw_docs - 1, 0) * share_docs + 1
    sure = SURE * np.sqrt(1 / seen_docs + 1 / due_docs)

    def told(ratio: np.ndarray) -> np.ndarray:
        return np.sign(ratio) * np.maximum(0, np.abs(ratio) - sure)

    of_n = totals[1 + bucket // WIDTH]
    share = of_n[:, 0] / np.maximum(of_n[:, 1], 1)
    counted = times * told(np.log((np.maximum(seen - own * times, 0) + 1) / (np.maximum(raw - times, 0) * share + 1)))
    return counted + np.where(bucket < WIDTH, told(np.log(seen_docs / due_docs)), 0)


def scored(docs: DataFrame, shared: Broadcast, seed: int = 0, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add log_weight (double) and key (log_weight with Gumbel noise) to each row; `keep`: the columns to hand on (None: all).

    `shared` has what `wanted_ids` and `fitted` return: ids, model, totals. A text without words (null, empty), or whose words tell nothing, has log_weight 0. Repeated rows have equal keys. Columns named
    log_weight or key are replaced. Each row is worked on alone: no shuffle.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("log_weight", "key")]
    # A text that is handed on is sent once.
    sent = keep.index(text) if text in keep and docs.schema[text].dataType.simpleString() == "string" else None
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(doc_id).cast("long").alias("__q_id"), *([F.col(text).cast("string").alias("__q_text")] if sent is None else []))
    text_at = len(keep) + 1 if sent is None else sent

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, model, totals = shared.value
        for batch in batches:
            target, score = _among(own, batch.column(len(keep))), np.zeros(batch.num_rows)
            for a, b, texts in texthash.pieces(batch.column(text_at), CHUNK):
                bucket, of, times = grams(texts)
                if totals[0, 0]:
                    score[a:b] = np.bincount(of, weights=log_importance(model, totals, bucket, times, target[a:b][of]), minlength=b - a)
            id_hash = texthash._mix(np.array([0 if x is None else x for x in batch.column(len(keep)).to_pylist()], np.int64).astype(np.uint64) + np.uint64(seed) * np.uint64(2654435761) + np.uint64(1))
            u = ((id_hash >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score), pa.array(score - np.log(-np.log(u)))], names=[*keep, "log_weight", "key"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "log_weight double", "key double"])
    return rows.mapInArrow(work, schema)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a column of doubles without a global sort: counts in ever finer bins, a few rows each."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n:
        return None
    k = min(max(k, 1), n)
    while True:
        width = (high - low) / bins
        if width <= 0 or low + width <= low or high - width >= high:
            return high
        inside = df.where(F.col(column).between(low, high))
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        counts = inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("at")).collect()
        for _, n, bin_low, bin_high in counts:
            if k <= n:
                break
            k -= n
        if bin_low == bin_high or k == 1:
            return bin_high
        if k == n:
            return bin_low
        low, high = bin_low, bin_high


def resampled(docs: DataFrame, labels: DataFrame, wanted, scratch: str, seed: int = 0, k: int | None = None, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with log_weight, key and kept: whether the key is among the k largest (equal keys at the edge all count).

    `wanted` is a condition on `labels`, in SQL or as a column. Without `k`, the sample is as large as it takes to keep `KEEP` of the labelled
    wanted documents; where none is labelled, all documents are kept. `keep`: the columns to hand on (None: all). Columns named log_weight,
    key or kept are replaced. Repeated rows are kept or dropped together; an empty table gives no rows.

    Only ids and keys are stored; where more columns are asked for, the weights are worked out once more beside the texts,
    which costs less than to write and read all texts.
    """
    spark = docs.sparkSession
    ids = wanted_ids(labels, wanted, doc_id)
    shared = spark.sparkContext.broadcast((ids, *fitted(docs, ids, doc_id, text)))
    keep = [c for c in (docs.columns if keep is None else keep if doc_id in keep else [doc_id, *keep]) if c != "kept"]
    rows = stored(scored(docs, shared, seed, doc_id, text, [doc_id]), f"{scratch}/scored")
    if k is None:
        known = spark.createDataFrame(pa.table({"__known": ids}))
        own = rows.join(known, F.col(doc_id) == F.col("__known"), "left_semi")
        edge = kth_largest(own, "key", math.ceil(KEEP * own.count()))
    else:
        edge = kth_largest(rows, "key", k) if k > 0 else math.inf
    if keep != [doc_id]:
        freed(spark, f"{scratch}/scored")
        rows = scored(docs, shared, seed, doc_id, text, keep)
    return rows.withColumn("kept", F.col("key") >= F.lit(edge) if edge is not None else F.lit(True))
