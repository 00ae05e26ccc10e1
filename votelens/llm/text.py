"""Words, hashes and word sequences of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D (all ASCII, so bytes and code points agree).
A null text has no words. Memory is a few dozen times one slice: ``slices`` cuts an Arrow batch at document
boundaries into pieces of about a quarter of a megabyte, a longer document is a piece of its own.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _tables["n"] < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            t = np.full(n, base, U)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
        _tables["n"] = n
    return _tables["up"][:n], _tables["down"][:n]


@dataclass
class Words:
    """Words of some texts: ``start:end`` in ``data``, ``doc`` of each word, ``first[d]:first[d + 1]`` of document d."""
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; equal words, equal hashes, in any text and process."""
        up, down = _powers(len(self.data) + 1)
        b = _LOWER[self.data] if lower else self.data
        total = np.zeros(len(b) + 1, U)
        np.cumsum((b.astype(U) + U(1)) * up[:-1], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h ^ (self.end - self.start).astype(U) * _BASE)

    def runs(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``k`` consecutive words of one document: (index of the first word, hash)."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(h))
        at = np.flatnonzero(left[:n] >= k)
        g = np.zeros(n, U)
        for j in range(k):
            g = mix(g * _BASE + h[j:j + n])
        return at, g[at]

    def shingles(self, h: np.ndarray, k: int) -> list[np.ndarray]:
        """Per document its distinct shingles of ``k`` words, sorted; fewer words are one shingle, none is none."""
        at, g = self.runs(h, k)
        cut = np.searchsorted(at, self.first)
        out = []
        for d, n in enumerate(self.counts):
            s = g[cut[d]:cut[d + 1]]
            if 0 < n < k:
                x = np.zeros(1, U)
                for w in h[self.first[d]:self.first[d + 1]]:
                    x = mix(x * _BASE + w)
                s = x
            s = np.sort(s)
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        return out


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null is empty."""
    a = pc.fill_null(column, "").cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8) if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]] if len(data) else data, off - off[0]


def split(column: pa.Array, gaps: np.ndarray = _SPACE) -> Words:
    """``gaps``: which of the 256 bytes stand between words (ASCII only, so that bytes and code points agree)."""
    data, off = raw(column)
    w = ~gaps[data]
    s, e = w.copy(), w.copy()
    if len(w):
        s[1:] &= ~w[:-1]
        e[:-1] &= ~w[1:]
        heads, tails = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]] - 1
        s[heads] = w[heads]
        e[tails] = w[tails]
    start, end = np.flatnonzero(s), np.flatnonzero(e) + 1
    return Words(data, off, start, end, np.searchsorted(start, off))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches at row boundaries so that each piece holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate(([0], np.cumsum(size + 64)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
