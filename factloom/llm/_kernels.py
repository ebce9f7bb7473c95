"""Array kernels over the byte buffers of Arrow string columns.

All text operators share one way of looking at a batch: the concatenated UTF-8
bytes and the row offsets.  Words, lines and runs are found by comparing byte
masks with their shifted copies, and any substring is hashed in O(1) from one
prefix sum: H(s, e) = (C[e] - C[s]) * P**-s with C[k] = sum(b[j] * P**j, j < k)
modulo 2**64 (P is odd, so it has an inverse).  No Python object is made per
word.  Batches are cut into slices of about ``SLICE`` bytes to bound memory; a
row is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE = 1 << 20
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)

_b = np.arange(256)
ALNUM = ((_b >= 48) & (_b <= 57)) | ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
#: Neither space, tab, line feed nor carriage return.
NOT_SPACE = ~np.isin(_b, [32, 9, 10, 13])
NOT_NEWLINE = _b != 10


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words with good diffusion."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_buffer(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets.astype(np.int64)


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about ``size`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_slices(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for each slice of a column."""
    buf, offsets = text_buffer(column, lower)
    for i, j in slices(offsets):
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def runs(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a class that don't cross rows: (starts, ends, run offsets by row)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[buf]
    prev = np.empty_like(inside)
    prev[0] = False
    prev[1:] = inside[:-1]
    first = offsets[:-1]
    prev[first[first < len(buf)]] = False
    starts = np.flatnonzero(inside & ~prev)
    nxt = np.empty_like(inside)
    nxt[-1] = False
    nxt[:-1] = inside[1:]
    last = offsets[1:] - 1
    nxt[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers = np.ones(1, U)
_inverse = np.ones(1, U)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, SLICE + (1 << 16))
        _powers = np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, _P, U), dtype=U)])
        _inverse = np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, _PINV, U), dtype=U)])


class Prefix:
    """Prefix sums of a byte buffer; ``hash`` gives the hash of any of its substrings."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        _grow(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * _powers[:n], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _inverse[starts])


def hash_spans(buf: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """The hashes of [starts, end) for each array of ends; starts ascend.

    Prefix sums take 48 bytes a byte, so a long text is hashed piece by piece.
    """
    out = [np.empty(len(starts), U) for _ in ends]
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(starts, base + 2 * SLICE))
        stop = max(int(e[i:j].max()) for e in ends)
        sums = Prefix(buf[base:stop])
        for o, e in zip(out, ends):
            o[i:j] = sums.hash(starts[i:j] - base, e[i:j] - base)
        i = j
    return out


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, word offsets by row)."""
    starts, ends, at = runs(buf, offsets, table)
    return hash_spans(buf, starts, ends)[0], at


_ODD = mix(np.arange(1, 513, dtype=U)) | U(1)


def windows(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every window of ``n`` consecutive words of a row, in order."""
    global _ODD
    if n > len(_ODD):
        _ODD = mix(np.arange(1, n + 1, dtype=U)) | U(1)
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(total, U)
    for k in range(n):
        h += hashes[k : k + total] * _ODD[k]
    counts = np.diff(at)
    row = np.repeat(np.arange(len(counts)), counts)
    ok = row[:total] == row[n - 1 :] if n > 1 else np.ones(total, bool)
    return mix(h[ok]), row[:total][ok]


def shingles(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Like ``windows``, and a row of 1 to n - 1 words gives one shingle of all of them; rows ascend."""
    h, row = windows(hashes, at, n)
    counts = np.diff(at)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), U)
        for k in range(n - 1):
            has = counts[short] > k
            extra[has] += hashes[at[short[has]] + k] * _ODD[k]
        h, row = np.concatenate([h, mix(extra)]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row


def row_starts(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets by row of an ascending row index."""
    return np.searchsorted(row, np.arange(n_rows + 1))


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
