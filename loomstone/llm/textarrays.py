"""Texts of an Arrow batch as numpy arrays: words and their hashes without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: ASCII white space, which separates words.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]  # A-Z count as a-z


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    if n == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``limit`` text bytes, one longer row at least; this bounds memory."""
    if not batch.num_rows:
        return
    _, offsets = column_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words [starts, ends), and for each row the index of its first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begins[first] = inside[first]
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, block: int = 1 << 20
) -> np.ndarray:
    """A 64-bit hash of each word; ``fold`` lower-cases A-Z first.

    A polynomial over the bytes, taken from running sums in blocks of about
    ``block`` bytes, so that no word needs a step of its own.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    values = _FOLDED if fold else _BYTES
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + block, side="right")))
        s, e = starts[at:to] - low, ends[at:to] - low
        n = int(e[-1])
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[data[low : low + n]] * _powers(_BASE, max(n, 1))[:n], out=sums[1:])
        out[at:to] = mix((sums[e] - sums[s]) * _powers(_BACK, max(n, 1))[s] + (e - s).astype(np.uint64))
        at = to
    return out


_TURN = mix(np.arange(11, 43, dtype=np.uint64)) | _U(1)


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, size: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of word shingles of all rows, and the n + 1 offsets of the rows in them.

    A row with fewer words than ``size`` has its whole sequence as one shingle;
    a row without words has none.
    """
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    counts = np.diff(first)
    n = len(counts)
    row = np.repeat(np.arange(n), counts)
    made, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) >= size:
        k = len(hashes) - size + 1
        made = np.zeros(k, np.uint64)
        for i in range(size):
            made += hashes[i : i + k] * _TURN[i]
        whole = row[:k] == row[size - 1 :]
        made, owner = mix(made[whole]), row[:k][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.array(
            [(hashes[first[r] : first[r + 1]] * _TURN[: counts[r]]).sum(dtype=np.uint64) + _U(counts[r]) for r in short],
            dtype=np.uint64,
        )
        made, owner = np.concatenate([made, mix(extra)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        made, owner = made[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for r in range(n):
        made[bounds[r] : bounds[r + 1]].sort()
    keep = np.ones(len(made), dtype=bool)
    keep[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
    made, owner = made[keep], owner[keep]
    return made, np.searchsorted(owner, np.arange(n + 1))
