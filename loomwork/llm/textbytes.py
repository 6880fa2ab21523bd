"""Vectorised reading of words from UTF-8 text in Arrow batches.

Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z. Texts are never decoded:
multi-byte characters hold no byte below 0x80, so they stay whole inside words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
GOLD = 0x9E3779B97F4A7C15
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint64) + U(1)
_LOWER[65:91] += U(32)
_BASE, _WORD_BASE = 0xD6E8FEB86659FD93, 0xCA5A826395121157


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits of x."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_blocks(column: pa.Array, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows of about limit bytes; a longer text is a block of its own. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1), i + 60_000)
        yield i, offs[i : j + 1] - offs[i], data[offs[i] : offs[j]]
        i = j


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of each word of a block."""
    none = np.zeros(0, np.int64)
    is_word = _IS_WORD[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    if not len(data):
        return none, none, none, none.astype(np.uint64)
    before[0], before[1:] = False, is_word[:-1]
    after[-1], after[:-1] = False, is_word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    if not len(starts):
        return starts, ends, rows, none.astype(np.uint64)
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # long blocks in parts, for memory
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 21))))
        s, e = starts[i:j], ends[i:j]
        lens = e - s
        at = np.repeat(s - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(int(lens.sum()))
        inside = at - np.repeat(s, lens)
        hashes[i:j] = np.add.reduceat(_LOWER[data[at]] * powers(_BASE, int(lens.max()))[inside], np.concatenate(([0], np.cumsum(lens)[:-1])))
        i = j
    return starts, ends, rows, mix(hashes ^ (ends - starts).astype(np.uint64) * U(GOLD))


def fold(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run start:end of a sequence of word hashes, the same wherever the run stands."""
    up = powers(_WORD_BASE, len(hashes) + 1)
    down = powers(pow(_WORD_BASE, -1, 1 << 64), len(hashes) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(hashes * up[:-1], dtype=np.uint64)))
    return mix((sums[end] - sums[start]) * down[start] ^ (end - start).astype(np.uint64) * U(GOLD))


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each row's part of an array that is sorted by row."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingles(rows: np.ndarray, hashes: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes) of each row's distinct k-word shingles, ascending; with fewer words, the whole sequence is one."""
    bounds = per_row(rows, n_rows)
    count = np.diff(bounds)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(n_rows), n)
    start = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    grams = fold(hashes, start, start + np.minimum(k, count[row]))
    order = np.argsort(grams)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    row, grams = row[order], grams[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    return row[new], grams[new]


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary value for each bounds[i]:bounds[i + 1] of data."""
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int64)), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
