"""Phrase collocation mining: Misra-Gries summaries of hash partitions find what can be frequent, a second pass counts exactly.

First pass: the hashes of all n-grams are dealt to hash partitions, packed in sorted blocks. Each partition merges its blocks
into one Misra-Gries summary: where it holds more than its capacity of counters, the next largest count is taken from
all, and those that it exhausts go. Each such step takes the count from more counters than the capacity, so with a capacity above mass
/ threshold all that is taken from any n-gram stays below the threshold, and each frequent n-gram survives; the summary
knows how much it has taken, and never takes more than that. Second pass: a bitmap of the survivors' hashes
drops what can't be frequent, the rest is counted by its words, so that hashes decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import texthash
from .common import freed, parts_for, stored

#: Words of a phrase at most.
MOST = 4
#: Occurrences that make a phrase a candidate; phrases a language returns; share of a phrase's occurrences, in percent, that a longer one takes to absorb it.
LEAST, TOP, ABSORBED = 30, 2000, 80
#: A score is so many times a / (l + r).
SCALE = 2_000_000
#: Bytes of text that one hash partition answers for, about: partitions grow in number with the input, not in size.
PART = 48 << 20
#: Bytes of text worked on at once, and n-grams held before they are handed on.
CHUNK, BUFFER = 1 << 20, 1 << 21
#: Bits of the survivors' bitmap for each of them, and in all at most (32 MB): when it is full it drops less, which changes no result.
BITS, MOST_BITS = 16, 1 << 28
#: Parts in which the bitmap is put together.
SEGMENTS = 64

_BREAKS, _SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = texthash.classes(_BREAKS + _SPACES, others=False)
_IS_BREAK = np.isin(np.arange(256), list(_BREAKS))
_LOW = np.uint64(0xFFFFFFFF)


class Grams:
    """The n-grams of some texts: for each n, the hash at each word and whether n words from there lie in one piece."""

    def __init__(self, texts: list[bytes], langs: np.ndarray):
        """`langs`: a number for each text's language, of 64 bits."""
        t = self.tokens = texthash.Tokens(texts, _KIND)
        # Both numbers never fall, so their sum tells pieces of different texts apart, too.
        piece = np.searchsorted(np.flatnonzero(_IS_BREAK[t.bytes]), t.starts) + t.text
        h = texthash._mix(langs[t.text] ^ t.hash) if len(t.hash) else t.hash
        self.hash, self.inside = [h], [np.ones(len(h), bool)]
        for n in range(2, MOST + 1):
            m = max(0, len(piece) - n + 1)
            h = texthash._mix(h[:m] * texthash._STEP + t.hash[n - 1 : n - 1 + m])
            self.hash.append(h)
            self.inside.append(piece[:m] == piece[n - 1 : n - 1 + m])


def _coded(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The languages of a column, their hashes, and each row's number among them."""
    coded = column.dictionary_encode()
    names = [x.encode() for x in coded.dictionary.to_pylist()]
    ends = np.cumsum([len(x) for x in names], dtype=np.int64)
    hashes = texthash.hashes(np.frombuffer(b"".join(names), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if names else np.zeros(0, np.uint64)
    return coded.dictionary, hashes, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _keys(h: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition (upper half) and the hash's lower half."""
    return ((h >> np.uint64(32)) * np.uint64(parts) & ~_LOW) | (h & _LOW)


def _pack(low: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences; their upper halves compress well."""
    gaps = np.diff(low, prepend=np.uint32(0)).view("<u2").reshape(-1, 2)
    return np.ascontiguousarray(gaps[:, 0]).tobytes() + pa.compress(np.ascontiguousarray(gaps[:, 1]).tobytes(), "zstd", asbytes=True)


def _unpack(n: int, blob: bytes) -> np.ndarray:
    gaps = np.empty((n, 2), "<u2")
    gaps[:, 0] = np.frombuffer(blob, "<u2", n)
    gaps[:, 1] = np.frombuffer(pa.decompress(blob[2 * n :], 2 * n, "zstd", asbytes=True), "<u2")
    return np.cumsum(gaps.reshape(-1).view("<u4"), dtype=np.uint32)


class Summary:
    """A Misra-Gries summary of 32-bit numbers: no count is more than `taken` below the true one, and those that are gone had no more than that."""

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least, self.taken = capacity, least, 0
        self.held = np.zeros(0, np.uint64)  # number in the upper half, count in the lower; sorted

    def add(self, numbers: np.ndarray) -> None:
        """Merge the counts of `numbers` and take the (capacity + 1)-th largest count from all, as long as `least` isn't reached."""
        both = np.concatenate([self.held, (numbers.astype(np.uint64) << np.uint64(32)) | np.uint64(1)])
        both.sort()
        value = both >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(both) else np.zeros(0, np.int64)
        count = np.minimum(np.add.reduceat(both & _LOW, starts), _LOW) if len(both) else both
        value = value[starts]
        if len(count) > self.capacity:
            d = int(np.partition(count, len(count) - self.capacity - 1)[len(count) - self.capacity - 1])
            if self.taken + d < self.least:
                self.taken += d
                stays = count > d
                value, count = value[stays], count[stays] - np.uint64(d)
        self.held = (value << np.uint64(32)) | count

    def survivors(self) -> np.ndarray:
        """Numbers that may have come `least` times."""
        return (self.held[(self.held & _LOW) + np.uint64(self.taken) >= self.least] >> np.uint64(32)).astype(np.uint32)


def survivors(docs: DataFrame, parts: int, capacity: int, least: int = LEAST) -> DataFrame:
    """(part, n, numbers): lower hash halves of the n-grams (1 to `MOST` words) of (lang, text) that may occur `least` times, by hash partition."""

    def made(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(held)
        keys.sort()
        part = (keys >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(starts[1:], len(keys))
        low = (keys & _LOW).astype(np.uint32)
        blobs = [_pack(low[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "n", "numbers"])

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            _, hashes, lang = _coded(batch.column(0))
            for a, b, texts in texthash.pieces(batch.column(1), CHUNK):
                grams = Grams(texts, hashes[lang[a:b]])
                for h, inside in zip(grams.hash, grams.inside, strict=True):
                    held.append(_keys(h[inside], parts))
                    size += len(held[-1])
                if size > BUFFER:
                    yield made(held)
                    held, size = [], 0
        if size:
            yield made(held)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, summary, held, size = None, None, [], 0

        def result() -> pa.RecordBatch:
            summary.add(np.concatenate(held))
            out = summary.survivors()
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([len(out)], pa.int32()), pa.array([_pack(out)], pa.binary())], names=["part", "n", "numbers"])

        for batch in batches:
            for part, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != last:
                    if held:
                        yield result()
                    last, summary, held, size = part, Summary(capacity, least), [np.zeros(0, np.uint32)], 0
                held.append(_unpack(n, blob))
                size += n
                if size > capacity // 2:
                    summary.add(np.concatenate(held))
                    held, size = [np.zeros(0, np.uint32)], 0
        if held:
            yield result()

    schema = "part int, n int, numbers binary"
    return docs.mapInArrow(emit, schema).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(summed, schema)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return texthash._mix(keys) >> np.uint64(64 - (bits.bit_length() - 1))


def bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """The survivors as a bitmap of that many bits (a power of two), put together in `SEGMENTS` parts: of bounded size, so collected."""
    each = bits // SEGMENTS

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.unique(_places((np.uint64(part) << np.uint64(32)) | _unpack(n, blob).astype(np.uint64), bits))
                segment = at // np.uint64(each)
                edges = np.searchsorted(segment, np.arange(SEGMENTS + 1, dtype=np.uint64))
                own = [(k, (at[a:b] % np.uint64(each)).astype(np.uint32).tobytes()) for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], names=["segment", "at"])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(segment, np.zeros(each, bool))[np.frombuffer(at, np.uint32)] = True
        for segment, marks in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], names=["segment", "marks"])

    out = np.zeros(bits // 8, np.uint8)
    rows = found.where("n > 0").mapInArrow(placed, "segment int, at binary").repartition("segment").mapInArrow(joined, "segment int, marks binary")
    for segment, marks in rows.collect():
        out[segment * each // 8 : (segment + 1) * each // 8] = np.frombuffer(marks, np.uint8)
    return out


def counted(docs: DataFrame, marks: np.ndarray, parts: int) -> DataFrame:
    """(lang, n, phrase, times): exact counts of the n-grams that the bitmap lets through, not yet summed; n = 0: the number of all words."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(marks), len(marks) * 8

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value

        def passes(h: np.ndarray) -> np.ndarray:
            at = _places(_keys(h, parts), bits)
            return (marks[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0

        for batch in batches:
            names, hashes, lang = _coded(batch.column(0))
            for a, b, texts in texthash.pieces(batch.column(1), CHUNK):
                own, grams = lang[a:b], Grams(texts, hashes[lang[a:b]])
                t = grams.tokens
                total = np.bincount(own[t.text], minlength=len(names)) if len(t.text) else np.zeros(len(names), np.int64)
                yield _counts(names, 0, pa.array(np.arange(len(names))), pa.array([b""] * len(names), pa.binary()), total)
                ok = passes(grams.hash[0])
                # The words that pass, encoded by their bytes: equal codes are equal words.
                at = np.flatnonzero(ok)
                edge = np.zeros(len(t.bytes) + 1, np.int8)
                edge[t.starts[at]] += 1
                edge[t.ends[at]] -= 1
                letters = t.bytes[np.cumsum(edge[:-1], dtype=np.int8) > 0]
                offsets = np.concatenate([[0], np.cumsum(t.ends[at] - t.starts[at])]).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
                code = np.full(len(ok), -1, np.int64)
                code[at] = words.indices.to_numpy(zero_copy_only=False)
                rank = own[t.text] if len(ok) else np.zeros(0, np.int64)
                for n in range(1, MOST + 1):
                    if n > 1:  # both shorter ones must pass
                        m = len(grams.hash[n - 1])
                        ok = ok[:m] & ok[1 : m + 1] & grams.inside[n - 1]
                        at = np.flatnonzero(ok)
                        ok[at] = passes(grams.hash[n - 1][at])
                        at = at[ok[at]]
                    if not len(at):
                        break
                    # A pair of numbers that stand for the first n - 1 words (and the language) and for the last one: no hashes.
                    _, first, number, times = np.unique(rank[at] * len(words.dictionary) + code[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
                    rank = np.full(len(ok), -1, np.int64)
                    rank[at] = number
                    first = at[first]
                    each = [words.dictionary.take(pa.array(code[first + k])) for k in range(n)]
                    phrase = pc.binary_join_element_wise(*each, b" ") if n > 1 else each[0]
                    yield _counts(names, n, pa.array(own[t.text[first]]), phrase, times)

    return docs.mapInArrow(emit, "lang string, n int, phrase string, times bigint")


def _counts(names: pa.Array, n: int, lang: pa.Array, phrase: pa.Array, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([names.take(lang), pa.array(np.full(len(phrase), n, np.int32)), phrase.view(pa.string()), pa.array(times.astype(np.int64))], names=["lang", "n", "phrase", "times"])


def frequent(docs: DataFrame, scratch: str, lang: str = "lang", text: str = "text", least: int = LEAST) -> DataFrame:
    """(lang, n, phrase, times) of all phrases of 1 to `MOST` words that occur `least` times; n = 0: the number of all words of the language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = parts_for(n_bytes, PART)
    # n bytes have n / 2 words at most and so 2 n phrases; a hash partition may have twice its share.
    capacity = 4 * n_bytes // (parts * least) + 1024
    found = stored(survivors(rows, parts, capacity, least), f"{scratch}/survivors")
    n = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(MOST_BITS, 1 << max(16, (BITS * n - 1).bit_length() if n else 16))
    counts = counted(rows, bitmap(found, bits), parts).groupBy("lang", "n", "phrase").agg(F.sum("times").alias("times"))
    out = stored(counts.where(f"n = 0 OR times >= {least}"), f"{scratch}/frequent")
    freed(spark, f"{scratch}/survivors")
    return out


def score(a: Column, both: Column) -> Column:
    """floor(SCALE * a / both), exactly."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(18,0)") * a.cast("decimal(19,0)"), both.cast("decimal(20,0)"))


def collocations(docs: DataFrame, scratch: str, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `MOST` words, see the contract of the query.

    A null language is `und`; null and empty texts have no words. Repeated rows count as often as they come. Ties go by count, then by
    phrase in the order of its bytes. Other columns are left out, whatever their names. An empty table, or one without frequent phrases, gives no rows.
    """
    rows = frequent(docs, scratch, lang, text, least)
    known = rows.where("n > 0").select("lang", "phrase", "times")
    found = rows.where("n > 1").select("lang", "n", F.col("phrase"), F.col("times").alias("a"), F.split("phrase", " ").alias("words"))

    cut = F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")
    cuts = found.select("lang", "phrase", "a", "words", "n", cut)
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("times").alias("l")).hint("merge"), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("times").alias("r")).hint("merge"), ["lang", "right"])
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("l").cast("decimal(19,0)") + F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    starts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), lambda at: F.array_join(F.slice("words", at, size), " "))))
    longer = found.where("n > 2").select("lang", F.explode(F.array_distinct(starts)).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(longer.hint("merge"), ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {absorbed} * a")

    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = rows.where("n = 0").select("lang", F.col("times").alias("n"))
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
