"""Whole Arrow batches of text as flat numpy vectors: words, their hashes and hashed shingles.

A word is a run of bytes other than space and 0x09-0x0D, after A-Z are lower-cased; null text counts as empty."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20260101))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_IS_SPACE] = 0
_R = _U(0x9E3779B97F4A7C15)
_R_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n + n // 8, SLICE_BYTES)
        out = []
        for r in (_R, _R_INV):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers = (out[0], out[1])
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `size` bytes of text (a longer text is alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + size, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


@dataclass
class Words:
    hashes: np.ndarray  # of each word
    doc: np.ndarray  # row of each word
    counts: np.ndarray  # words of each row
    starts: np.ndarray  # byte offset of each word


def words(column: pa.Array) -> Words:
    raw, off = text_bytes(column)
    n = len(off) - 1
    if not len(raw):
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, np.zeros(n, np.int64), z)
    space = _IS_SPACE[raw]
    begins = np.ones(len(raw), bool)
    begins[1:] = space[:-1]
    begins[off[:-1][off[:-1] < len(raw)]] = True
    starts = np.flatnonzero(begins & ~space)
    doc = np.searchsorted(off, starts, "right") - 1
    counts = np.bincount(doc, minlength=n)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), doc, counts, starts)
    power, inverse = _tables(len(raw))
    # spaces add nothing, so a run up to the next word's start sums over the word alone
    sums = np.add.reduceat(_BYTE[raw] * power[: len(raw)], starts)
    return Words(mix(sums * inverse[starts]), doc, counts, starts)


def prefixes(column: pa.Array, w: Words, sizes: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, hashes of the first so many bytes of each longer word, and the rows of these words."""
    raw, off = text_bytes(column)
    word = np.arange(len(w.starts))
    ends = off[w.doc + 1]
    total = np.zeros(len(w.starts), np.uint64)
    for j in range(sizes.stop):
        at = w.starts[word] + j
        inside = at < ends[word]
        inside[inside] = ~_IS_SPACE[raw[at[inside]]]
        word, at, total = word[inside], at[inside], total[inside]
        if j in sizes:
            yield mix(total + _U(j)), w.doc[word]
        total = total * _R + _BYTE[raw[at]]


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k words in each row (of the whole row, if it has fewer), in text order, with rows."""
    h, doc = w.hashes, w.doc
    if not len(h):
        return h, doc
    total = h * _U(0xD6E8FEB86659FD93)
    whole = np.ones(len(h), bool)
    for j in range(1, k):
        same = np.zeros(len(h), bool)
        same[:-j or None] = doc[j:] == doc[:-j] if j < len(h) else False
        shifted = np.zeros(len(h), np.uint64)
        if j < len(h):
            shifted[:-j] = h[j:]
        total = total * _U(0xD6E8FEB86659FD93) + np.where(same, shifted, _U(j))
        whole = same
    first = np.ones(len(h), bool)
    first[1:] = doc[1:] != doc[:-1]
    keep = whole | (first & (w.counts[doc] < k))
    return mix(total[keep]), doc[keep]


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each row's run in a vector sorted by row."""
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
