"""Words and shingles of many texts at once, as numpy arrays over the texts' bytes.

Words are runs of bytes outside \\x20 and \\x09-\\x0D. A word's 64-bit hash is a polynomial over its bytes, taken from one
running sum for a whole batch, then mixed; equal words have equal hashes whatever stands around them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    """Powers of the base and of its inverse, as far as the longest batch so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._run(x, n) for x in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


POWERS = _Powers()


@dataclass
class Words:
    """hashes, first and last+1 byte of each word; ``first[d]``:``first[d + 1]`` are the words of text d."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets into them; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of up to ``rows`` texts with about ``most`` bytes together; one longer text is a slice of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
        to = min(to, at + rows)
        yield batch.slice(at, to - at)
        at = to


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving freed memory back to the system at a task's end: Spark keeps the worker, idle or for the next stage."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return tidied


def running(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the bytes' values times powers, and the inverse powers: ``(sums[j] - sums[i]) * down[i]`` is the hash of bytes i to j."""
    up, down = POWERS.to(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return total, down


def split_words(data: np.ndarray, at: np.ndarray, fold: bool) -> Words:
    """The words of all texts; ``fold`` lower-cases A-Z."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(at), dtype=np.int64))
    inside = ~_SPACE[data]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[at] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    start = np.flatnonzero(inside & (fresh[:-1] | ~before))
    end = np.flatnonzero(inside & (fresh[1:] | ~after)) + 1
    total, down = running(_LOWER[data] if fold else data)
    return Words(mix((total[end] - total[start]) * down[start]), start, end, np.searchsorted(start, at))


def shingles(words: Words, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and the number of runs of each text.

    A text with fewer words, but not none, has its whole sequence as its one shingle.
    """
    counts = np.diff(words.first)
    n = len(words.hashes)
    factors = [U(int(mix(np.array([k + 1], dtype=np.uint64))[0]) | 1) for k in range(size)]
    runs = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for k in range(size):
        runs += words.hashes[k : k + len(runs)] * factors[k]
    runs = mix(runs)
    doc = words.doc
    valid = doc[: len(runs)] == doc[size - 1 :] if len(runs) else np.zeros(0, dtype=bool)
    per = np.maximum(counts - size + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < size))
    out = runs[valid]
    if len(short):
        at = np.concatenate(([0], np.cumsum(per)))[short]
        whole = [
            mix(np.array([sum((int(h) * int(f) for h, f in zip(words.hashes[words.first[d] : words.first[d + 1]], factors)), int(counts[d])) & (2**64 - 1)], dtype=np.uint64))[0]
            for d in short
        ]
        out = np.insert(out, at, np.array(whole, dtype=np.uint64))
        per[short] = 1
    return out, per


def distinct_in(values: np.ndarray, per: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct values of each text."""
    to = np.cumsum(per)
    for a, b in zip(to - per, to):
        yield np.unique(values[a:b])
