"""Vectorised text primitives on Arrow string columns (UTF-8 bytes in numpy).

Words are maximal runs of bytes other than space and 0x09-0x0D.  All
separators are ASCII, so byte runs and code-point runs are the same words.
Hashes are 64-bit polynomial hashes with a bit mixer; equal inputs have equal
hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21  # numpy works on about 2 MB of text at a time

_BASE = np.uint64(0x9E3779B97F4A7C55 | 1)
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective bit mixer on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 4096), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


_tables: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64: with prefix sums of value * power,
    any substring's hash is (sum to its end - sum to its start) * inverse power of its start."""
    if len(_tables.get("up", ())) < n:
        base = np.uint64(0xD1342543DE82EF95)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        for name, factor in (("up", base), ("down", inverse)):
            steps = np.full(max(n, 1 << 16), factor, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"][:n], _tables["down"][:n]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each row; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    dtype = np.int64 if wide else np.int32
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=dtype)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes: (first row, end row, bytes, offsets from 0)."""
    data, off = utf8(col)
    n, row = len(off) - 1, 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[off[row]:off[end]], off[row:end + 1] - off[row]
        row = end


@dataclass
class Words:
    """Words of a chunk of documents in text order."""

    start: np.ndarray  # first byte of each word
    end: np.ndarray    # byte after each word
    first: np.ndarray  # index of each document's first word, with the total at the end
    hash: np.ndarray   # 64-bit hash of each word's bytes


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each i (empty segments give 0)."""
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> Words:
    """Split a chunk into words and hash them."""
    is_word = ~_IS_SEP[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = is_word[:-1]
    start = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = is_word[1:]
    end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    first = np.searchsorted(start, off)
    if not len(start):
        return Words(start, end, first, np.zeros(0, np.uint64))
    length = end - start
    pw = powers(int(length.max()))
    # position of every byte inside its word; separators contribute nothing
    rel = np.arange(n, dtype=np.int64) - np.repeat(start, np.diff(np.append(start, n)))[:n] \
        if start[0] == 0 else None
    if rel is None:
        lead = int(start[0])
        rel = np.zeros(n, dtype=np.int64)
        rel[lead:] = np.arange(lead, n) - np.repeat(start, np.diff(np.append(start, n)))
    text = LOWER[data] if lower else data
    value = (text.astype(np.uint64) + np.uint64(1)) * pw[np.where(is_word, rel, 0)]
    value[~is_word] = 0
    h = np.add.reduceat(value, start)
    return Words(start, end, first, mix64(h + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def shingles(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word windows, in text order, and each document's first index.

    A document with fewer words than the window has its whole sequence as the
    only shingle; one without words has none.
    """
    n_words = np.diff(w.first)
    h, total = w.hash, len(w.hash)
    n_sh = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n_sh)]).astype(np.int64)
    if not total:
        return np.zeros(0, np.uint64), first
    odd = mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    acc = h * odd[0]
    for j in range(1, min(width, total)):
        acc[:total - j] += h[j:] * odd[j]
    # short documents: add only their own words
    for d in np.flatnonzero((n_words > 0) & (n_words < width)):
        a, b = w.first[d], w.first[d + 1]
        acc[a] = (h[a:b] * odd[:b - a]).sum(dtype=np.uint64) + np.uint64(int(b - a))
    doc = np.repeat(np.arange(len(n_words)), n_words)
    pos = np.arange(total) - w.first[doc]
    return mix64(acc[pos < n_sh[doc]]), first


def sort_distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment and the new segment bounds."""
    values = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    if not len(values):
        return values, first
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = values[1:] != values[:-1]
    keep[first[:-1][np.diff(first) > 0]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[first].astype(np.int64)
