"""Words of a batch of texts as NumPy arrays: bounds, owners and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes handled at once; intermediate arrays take some 30 times this.
CHUNK = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser with good avalanche."""
    x = np.asarray(x, U) + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x2545F4914F6CDD1D
_BYTE = mix(np.arange(256, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
_BYTE[_SPACE] = U(0)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, CHUNK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _POW[:] = [np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(b), U)]), dtype=U) for b in (_BASE, inverse)]
    return _POW[0], _POW[1]


class Words:
    """data: the UTF-8 bytes; start, end: of each word in data; count: words of each text; first: index of each text's first word; hash: of each word."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        body = texts.buffers()[2]
        self.data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]
        word = ~_SPACE[self.data]
        begins = np.zeros(len(self.data) + 1, bool)
        begins[self.off[:-1]] = True  # a text begins a word even where the one before ended in a word
        begins = begins[:-1]
        before = np.concatenate([[False], word[:-1]])
        self.start = np.flatnonzero(word & (~before[: len(word)] | begins))
        after_end = np.concatenate([~word[1:] | begins[1:], [True]])[: len(word)]
        self.end = np.flatnonzero(word & after_end) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)
        self.first = self.first[:-1]
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.start), U)
        lo = 0
        while lo < len(self.start):
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + CHUNK)))
            base, top = self.start[lo], self.end[hi - 1]
            up, down = _powers(int(top - base))
            part = self.start[lo:hi] - base
            sums = np.add.reduceat(_BYTE[self.data[base:top]] * up[: top - base], part)
            out[lo:hi] = mix(sums * down[part] ^ (self.end[lo:hi] - self.start[lo:hi]).astype(U))
            lo = hi
        return out

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The start word of each window of k words within one text, and the window's hash."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        left = np.repeat(self.first + self.count, self.count) - np.arange(n)
        at = np.flatnonzero(left >= k)
        sums = np.zeros(n - k + 1, U)
        for i in range(k):
            sums = sums * U(0x5851F42D4C957F2D) + self.hash[i : n - k + 1 + i]
        return at, mix(sums[at])

    def text_of(self, i: int, a: int, b: int) -> bytes:
        """Words a to b (exclusive, counted in text i) joined by one space."""
        f = self.first[i]
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[f + a : f + b], self.end[f + a : f + b], strict=True))


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about limit bytes; a longer text comes alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    total, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
