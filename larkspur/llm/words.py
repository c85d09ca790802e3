"""Words and word shingles of Arrow text columns, in numpy.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``, taken on the UTF-8 bytes. Words and shingles
are compared by 64-bit hashes that depend on their bytes only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
_LONG_WORD = 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def parts(column: pa.Array, most: int = 1 << 20):
    """Slices of a text column of at most ``most`` bytes, or of one row: (first row, bytes, offsets)."""
    data, offs = utf8(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n + 1 positions of each row's first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    before &= ~cut[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    after &= ~cut[1:]
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    size = end - start
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x243F6A8885A308D3)
    live = np.arange(len(size))
    for j in range(min(int(size.max(initial=0)), _LONG_WORD)):
        live = live[size[live] > j]
        h[live] = (h[live] ^ data[start[live] + j]) * np.uint64(0x100000001B3)
    for i in np.flatnonzero(size > _LONG_WORD):
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes()))
    return mix(h)


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows at each position, and whether a window ends in its own row."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[j : j + n]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return mix(out), row[:n] == row[k - 1 :]


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Each row's sorted distinct k-word shingles; 1 to k-1 words are one shingle, no word none."""
    start, end, first = spans(data, offs)
    h = hashes(data, start, end)
    win, _ = windows(h, first, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(win[a : b - k + 1]))
        elif b > a:
            w, v = h[a:b], np.zeros(1, np.uint64)
            for x in w:
                v = v * np.uint64(0x9FB21C651E98DF25) + x
            out.append(mix(v + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
