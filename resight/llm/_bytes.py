"""Numpy helpers on the UTF-8 bytes of Arrow text columns.

The operators of this subpackage look at every byte of the corpus.  Inside a Spark task they
work on the buffers that Arrow hands over, a slice of rows at a time, so that memory is bounded by
the slice (or by one text, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once in a task.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_MULTIPLIER = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_MULTIPLIER), -1, 1 << 64))
_BYTE_KEYS = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=U64)

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of the class [\x20\x09-\x0D].
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, 9, 10, 11, 12, 13]] = True

#: Bytes of words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = True
IS_WORD[97:123] = True
IS_WORD[128:] = True


def row_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes of text each (or one row)."""
    _, off = text_bytes(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the offsets of the rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        kind, width = np.int32, 4
    else:
        kind, width = np.int64, 8
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * width).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    base, end = int(off[0]), int(off[-1])
    buf = np.frombuffer(data, np.uint8, end - base, base) if end > base else np.zeros(0, np.uint8)
    return buf, off - base


def joined(buf: np.ndarray, off: np.ndarray, lo: int, hi: int, gap: int, value: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows lo to hi with `gap` bytes of `value` after each; the start of each row (and the end)."""
    n = off[lo + 1 : hi + 1] - off[lo:hi]
    start = np.concatenate([[0], np.cumsum(n + gap)])
    out = np.full(int(start[-1]), value, np.uint8)
    src = buf[off[lo] : off[hi]]
    shift = np.repeat(np.arange(hi - lo, dtype=np.int64) * gap, n)
    out[np.arange(len(src), dtype=np.int64) + shift] = src
    return out, start


class Powers:
    """Powers of the multiplier, kept and grown as wanted."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES * 2)
            cls.up = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _MULTIPLIER, U64)]))
            cls.down = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _INVERSE, U64)]))
        return cls.up[:n], cls.down[:n]


class RollingHash:
    """64-bit hashes of any byte ranges of one buffer, from prefix sums of a polynomial over random byte keys."""

    def __init__(self, buf: np.ndarray):
        up, self.down = Powers.get(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(_BYTE_KEYS[buf] * up[: len(buf)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def windows(self, k: int) -> np.ndarray:
        """Of the bytes [i, i + k) for every i."""
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def tokens(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the byte ranges [start, end) of buf, all at once."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    s = U64(seed)
    n = (end - start).astype(np.int64)
    pos = start.astype(np.int64).copy()
    h = np.full(len(n), s + _P5, U64)
    long = np.flatnonzero(n >= 32)
    if len(long):
        with np.errstate(over="ignore"):
            acc = [np.full(len(long), x, U64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
        at, left = pos[long], n[long]
        live = np.arange(len(long))
        while len(live):
            for i in range(4):
                acc[i][live] = _round(acc[i][live], words[at[live] + 8 * i])
            at[live] += 32
            left[live] -= 32
            live = live[left[live] >= 32]
        v = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
        for a in acc:
            v = (v ^ _round(np.zeros(len(long), U64), a)) * _P1 + _P4
        h[long] = v
        pos[long] = at
    h += n.astype(U64)
    rest = n & 31
    for step in range(3):
        i = np.flatnonzero(rest >= 8 * (step + 1))
        if not len(i):
            break
        h[i] = _rot(h[i] ^ _round(np.zeros(len(i), U64), words[pos[i]]), 27) * _P1 + _P4
        pos[i] += 8
    i = np.flatnonzero(rest & 4)
    if len(i):
        h[i] = _rot(h[i] ^ ((words[pos[i]] & U64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        pos[i] += 4
    for step in range(3):
        i = np.flatnonzero((rest & 3) > step)
        if not len(i):
            break
        h[i] = _rot(h[i] ^ (padded[pos[i]].astype(U64) * _P5), 11) * _P1
        pos[i] += 1
    h ^= h >> U64(33)
    h *= _P2
    h ^= h >> U64(29)
    h *= _P3
    h ^= h >> U64(32)
    return h


def majority_bits(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each group h[first : first + count], the 64 bits set in over half of its values; zero for an empty group.

    The groups lie one after the other in h. Bits are summed as bytes, eight to a 64-bit word, in pieces of
    at most 255 values, so that no byte overflows.
    """
    out = np.zeros(len(count), U64)
    live = np.flatnonzero(count)
    if len(live):
        pieces = -(-count[live] // 255)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(first[live], pieces) + nth * 255
        lanes = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(U64)
        part = np.add.reduceat(lanes, start, axis=0).view(np.uint8).astype(np.int32)
        sums = np.add.reduceat(part, np.cumsum(pieces) - pieces, axis=0)
        major = sums * 2 > count[live, None]
        out[live] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out
