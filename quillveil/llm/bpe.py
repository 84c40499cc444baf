"""Byte-level BPE: a segment tree over byte positions holds the leftmost minimum pair rank.

Each leaf is the rank of the pair that starts at a live position (none: `NONE`); each inner node is the
minimum of its two children, so the root is the best rank and the way down, left where it is equal, leads to
its leftmost place. A merge changes three leaves (the pair itself, the vanished right part, the pair before) and
the nodes above them: a logarithmic cost for each merge, whatever the length of the piece.

Short pieces are merged many at once, one tree a row of a numpy matrix; long ones one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

NONE = np.int32(2**31 - 1)
#: Pieces longer than this have a tree of their own.
WIDE = 64
#: Pieces that a worker remembers; beyond, those that its latest texts don't use are forgotten (bounds its memory).
MEMO = 400_000
#: Characters whose pieces are merged together.
CHARS = 4_000_000

# Letters and numbers of Latin-1, as the splitting pattern's classes have them: for texts of these
# characters alone, the standard library's engine gives the same pieces in less time.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
_LATIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xff‘’“”–—…€]*")
_LATIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


class Codec:
    """Encodes and decodes with the ranks of one file in tiktoken's format."""

    def __init__(self, rank_file: bytes, pattern: str):
        import public_tokenizers
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.words = [b""] * (max(self.ranks.values()) + 1)
        for word, rank in self.ranks.items():
            self.words[rank] = word
        self.split = regex.compile(pattern).findall
        self.latin = pattern == public_tokenizers.PATTERN
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for word, rank in self.ranks.items():
            for i in range(1, len(word)):
                a, b = self.ranks.get(word[:i]), self.ranks.get(word[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.memo: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return _LATIN_SPLIT.findall(text) if self.latin and _LATIN.fullmatch(text) else self.split(text)

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        memo, at = self.memo, 0
        while at < len(texts):  # pieces of about CHARS characters are looked up, and the new ones merged, together
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHARS):
                size, end = size + len(texts[end]), end + 1
            split = [self.pieces(text) for text in texts[at:end]]
            wanted = set().union(*split)
            if missing := [p for p in wanted if p not in memo]:
                if len(memo) + len(missing) > MEMO:  # what these texts use stays, the common pieces among it
                    stay = {p: memo[p] for p in wanted if p in memo}
                    memo.clear()
                    memo.update(stay)
                memo.update(zip(missing, self._merge_all([p.encode() for p in missing]), strict=True))
            for pieces in split:
                yield b"".join(map(memo.__getitem__, pieces))
            at = end

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _merge_all(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(piece) > WIDE:
                out[k] = self._merge_long(piece)
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
        for width, ks in by_width.items():
            for k, ids in zip(ks, self._merge_short([pieces[k] for k in ks], width), strict=True):
                out[k] = ids
        return out

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NONE)

    def _merge_short(self, pieces: list[bytes], width: int) -> list[bytes]:
        """One segment tree a row; node 1 is the root, the leaves are width .. 2 * width - 1."""
        n = len(pieces)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        length = np.array([len(p) for p in pieces])
        place = np.arange(width)
        ids = np.where(place < length[:, None], self.byte_ids[flat], -1)
        after = np.where(place + 1 < length[:, None], place + 1, width)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        ids = np.concatenate([ids, np.full((n, 1), -1)], 1)  # column `width`: beyond the end
        tree = np.full((n, 2 * width), NONE, np.int32)
        tree[:, width:] = self._ranks_of(ids[:, :width], ids[np.arange(n)[:, None], after])
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(rows, leaf, rank):
            node = leaf + width
            tree[rows, node] = rank
            while node[0] > 1:
                node = node // 2
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        while (rows := np.flatnonzero(tree[:, 1] != NONE)).size:
            best, node = tree[rows, 1], np.ones(rows.size, np.int64)
            while node[0] < width:
                node = 2 * node + (tree[rows, 2 * node] != best)
            i = node - width
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], ids[rows, j] = best, -1
            after[rows, i] = k
            inside = k < width
            before[rows[inside], k[inside]] = i[inside]
            put(rows, j, NONE)
            put(rows, i, self._ranks_of(ids[rows, i], ids[rows, k]))
            h = before[rows, i]
            if (some := h >= 0).any():
                put(rows[some], h[some], self._ranks_of(ids[rows[some], h[some]], best[some]))
        ids = ids[:, :width]
        live = ids >= 0
        all_ids, ends = ids[live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
        return [all_ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _merge_long(self, piece: bytes) -> bytes:
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        ids, get, none = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), self.pairs.get, int(NONE)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = get(ids[i] << 32 | ids[i + 1], none)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, rank: int) -> None:
            node = leaf + width
            tree[node] = rank
            while node > 1:
                node //= 2
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    return
                tree[node] = low

        while (best := tree[1]) != none:
            node = 1
            while node < width:
                node = 2 * node if tree[2 * node] == best else 2 * node + 1
            i = node - width
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j] = best, -1
            put(j, none)
            if k < n:
                before[k] = i
            put(i, get(best << 32 | ids[k], none) if k < n else none)
            if (h := before[i]) >= 0:
                put(h, get(ids[h] << 32 | best, none))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """This worker's codec for a rank file; later tasks of the worker find it, and its memo, again."""
    key = hashlib.sha256(rank_file).hexdigest(), pattern
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def encoded(df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "token_ids", decode_to: str | None = None, digests: bool = False) -> DataFrame:
    """Add `ids`, the tokens of `text` as little-endian unsigned 32-bit integers in one binary value.

    A null text counts as empty and gives no tokens. Repeated rows stay repeated; all other columns pass through
    (a column that has the name of an added one is replaced). `decode_to` adds the bytes decoded from the ids; for a
    text of Unicode scalar values they are its UTF-8. `digests` adds n_tokens, ids_sha256 and decoded_sha256 in place
    of both, so that no ids leave the worker. Each row is worked on alone: no shuffle, memory for one Arrow batch.

    `rank_path` (tiktoken's format) is read by the driver and broadcast: its size is that of a vocabulary.
    """
    with open(rank_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    added = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} if digests else {ids: pa.binary(), **({decode_to: pa.binary()} if decode_to else {})}
    sql = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    kept = [c for c in df.columns if c not in added or c == text]
    source = df.select([F.col(f"`{c}`") for c in kept if c not in added] + [F.col(f"`{text}`").alias("__bpe_text")])
    names = [c for c in kept if c not in added]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                texts = [x or "" for x in batch.column(len(names)).to_pylist()]
                got = list(own.encode_batch(texts))
                back = [own.decode(x) for x in got] if digests or decode_to else []
                if digests:
                    new = [[len(x) // 4 for x in got], [hashlib.sha256(x).hexdigest() for x in got], [hashlib.sha256(x).hexdigest() for x in back]]
                else:
                    new = [got, back] if decode_to else [got]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(v, t) for v, t in zip(new, added.values(), strict=True))], names=[*names, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), *(f"`{c}` {sql[t]}" for c, t in added.items())])
    return source.mapInArrow(work, schema)


def decoded(df: DataFrame, rank_path: str, pattern: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Add `to`, the bytes that the ids stand for; null ids give null."""
    with open(rank_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def work(batches):
        own = codec(shared.value, pattern)
        for batch in batches:
            yield batch.append_column(to, pa.array([None if x is None else own.decode(x) for x in batch.column(ids).to_pylist()], pa.binary()))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != to), f"`{to}` binary"])
    return df.drop(to).mapInArrow(work, schema)


def n_tokens(ids: str = "token_ids") -> Column:
    return (F.octet_length(ids) / 4).cast("long")
