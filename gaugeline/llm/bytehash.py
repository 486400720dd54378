"""Vectorised hashing of words, shingles and byte windows over Arrow text columns.

A column's UTF-8 buffer is hashed whole: with prefix sums S[i] of T[b]*P^i
(mod 2^64) the hash of any byte range is (S[e]-S[s])*P^-s.  White space of the
word contract is ASCII, so working on bytes equals working on code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
P = 0x9E3779B97F4A7C15
P_INV = pow(P, -1, 1 << 64)
#: Bytes hashed at a time, some 120 bytes of a worker's memory each; a longer text is a chunk of its own.
CHUNK = 1 << 18
#: Texts in a chunk; shingle hashes keep 52 bits so that a chunk's text number fits above.
CHUNK_ROWS = 4096
U = np.uint64


def table(seed: int, n: int) -> np.ndarray:
    """n pseudo-random odd 64-bit numbers, the same everywhere."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(off: np.ndarray):
    """Row ranges of at most CHUNK bytes and CHUNK_ROWS rows (one row at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1
        j = min(max(j, i + 1), i + CHUNK_ROWS, n)
        yield i, j
        i = j


class Hasher:
    """Prefix hashes of a chunk; keeps its power tables from chunk to chunk."""

    def __init__(self, seed: int = 11):
        self.t = table(seed, 256)
        self.pw = self.ipw = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.pw) < n:
            n = max(n, CHUNK + 1)
            self.pw = np.concatenate([[U(1)], np.cumprod(np.full(n, P, np.uint64))])
            self.ipw = np.concatenate([[U(1)], np.cumprod(np.full(n, P_INV, np.uint64))])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.powers(len(data) + 1)
        s = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.t[data] * self.pw[: len(data)], out=s[1:])
        return s

    def spans(self, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges [a, b)."""
        return (s[b] - s[a]) * self.ipw[a]

    def windows(self, s: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all k-byte windows, by start."""
        n = len(s) - k
        return (s[k:] - s[:n]) * self.ipw[:n] if n > 0 else np.zeros(0, np.uint64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def white(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number) of maximal runs of True, broken at text ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True
    gap = ~inside
    starts = inside.copy()
    starts[1:] &= gap[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= gap[1:] | first[1:n]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return a, b, np.searchsorted(off, a, "right") - 1


def word_hashes(h: Hasher, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, words before each text) for one chunk; data is as it is to be compared."""
    a, b, doc = runs(~white(data), off)
    w = mix(h.spans(h.prefix(data), a, b) + (b - a).astype(np.uint64))
    return w, np.searchsorted(doc, np.arange(len(off)), "left")


def shingle_sets(w: np.ndarray, first: np.ndarray, k: int, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted 52-bit hashes, and where each
    text's set begins.  A text of fewer than k words has its whole sequence as one."""
    n_docs = len(first) - 1
    count = np.diff(first)
    doc = np.repeat(np.arange(n_docs), count)
    parts_h, parts_d = [], []
    if len(w) >= k:
        m = len(w) - k + 1
        acc = w[:m] * coef[0]
        for j in range(1, k):
            acc = acc + w[j : j + m] * coef[j]
        ok = np.arange(m) + k <= first[1:][doc[:m]]
        parts_h.append(mix(acc[ok]))
        parts_d.append(doc[:m][ok])
    for n in range(1, k):
        d = np.flatnonzero(count == n)
        if len(d):
            acc = np.full(len(d), n, np.uint64) * coef[k]
            for j in range(n):
                acc = acc + w[first[d] + j] * coef[j]
            parts_h.append(mix(acc))
            parts_d.append(d)
    if not parts_h:
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    key = (np.concatenate(parts_d).astype(np.uint64) << U(52)) | (np.concatenate(parts_h) >> U(12))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    begin = np.searchsorted(key, np.arange(n_docs + 1).astype(np.uint64) << U(52))
    if n_docs == CHUNK_ROWS:
        begin[-1] = len(key)
    return key & U((1 << 52) - 1), begin
