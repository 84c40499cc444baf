"""Token and n-gram hashes of many texts at once, as numpy passes over their joined bytes.

A token's hash takes eight bytes at a time and mixes them before the next ones come (a sum over bytes, modulo 2^64, has
pairs of texts that collide whatever its numbers); tokens of up to eight bytes never collide with others of their length.
n-grams combine their tokens' hashes. All are unsigned 64-bit integers and the same on every machine. The polynomial sums
below are for byte ranges of bounded length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
SPACE, WORD, OTHER = 0, 1, 2
#: Ranges of more bytes are hashed one by one (BLAKE2b).
LONG = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _reach(n: int) -> None:
    """Tables of the base's powers, and their inverses, for n bytes."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]))
            _inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64)]))


def classes(spaces: bytes, others: bool) -> np.ndarray:
    """Class of each byte value: `spaces` part tokens; with `others`, runs of ASCII that is no letter or digit are tokens of their own."""
    kind = np.full(256, WORD, np.uint8)
    kind[list(spaces)] = SPACE
    if others:
        for b in range(128):
            if kind[b] and not chr(b).isalnum():
                kind[b] = OTHER
    return kind


def lowered(texts: list[bytes]) -> np.ndarray:
    """The texts' bytes, each followed by a space, with A-Z in lower case."""
    b = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    return b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)


def hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes."""
    eight = np.ndarray(len(b) + 1, "<u8", np.concatenate([b, np.zeros(8, np.uint8)]), strides=(1,))
    left = ends - starts
    h = _mix(left.astype(np.uint64) * np.uint64(_BASE))
    todo = np.flatnonzero((left > 0) & (left <= LONG))
    while len(todo):
        word = eight[ends[todo] - left[todo]]
        last = left[todo] < 8
        word[last] &= (np.uint64(1) << (left[todo][last].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[todo] = _mix((h[todo] ^ word) * _STEP + np.uint64(_BASE))
        left[todo] -= 8
        todo = todo[left[todo] > 0]
    for i in np.flatnonzero(left > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Tokens:
    """All tokens of some texts: hash, text number, first byte and end within the joined bytes."""

    def __init__(self, texts: list[bytes], kind: np.ndarray):
        b = lowered(texts)
        ends_at = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        cls = kind[b]
        if len(b):
            cls[ends_at - 1] = SPACE
        edge = np.flatnonzero(cls[1:] != cls[:-1]) + 1
        edge = np.concatenate([[0], edge, [len(b)]]) if len(b) else np.zeros(1, np.int64)
        starts, ends = edge[:-1], edge[1:]
        keep = cls[starts] != SPACE
        self.starts, self.ends = starts[keep], ends[keep]
        self.bytes, self.hash = b, hashes(b, self.starts, self.ends)
        self.text = np.searchsorted(ends_at, self.starts, "right")
        self.n_texts = len(texts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of each run of n tokens within a text."""
        m = max(0, len(self.hash) - n + 1)
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h * _STEP) + self.hash[k : k + m]
        inside = self.text[:m] == self.text[n - 1 : n - 1 + m]
        return _mix(h[inside]), self.text[:m][inside]


def chunks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of rows of about `most` bytes together, one row at least."""
    out, start, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            out.append((start, i))
            start, held = i, 0
        held += size
    if len(sizes) > start:
        out.append((start, len(sizes)))
    return out


def pieces(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows of about `most` bytes together and their texts in UTF-8 (null: empty); no more than these are copied at once."""
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for a, b in chunks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most):
        yield a, b, [x or b"" for x in column.slice(a, b - a).to_pylist()]
