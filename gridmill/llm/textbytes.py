"""Vectorised access to string columns as UTF-8 bytes.

An Arrow string column is one byte buffer plus offsets, so whole batches can be
hashed with numpy without making a Python string for any row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that separates words, as bytes: space and \x09 to \x0D.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x5851F42D4C957F2D
#: The first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Slices of more bytes are taken one by one.
_LONG = 512


def as_single(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def utf8_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = as_single(column).cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(column: pa.Array | pa.ChunkedArray, most_bytes: int, most_rows: int = 4000) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``most_bytes`` (or one row)."""
    _, offsets = utf8_buffers(column)
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), start + most_rows, n)
        yield start, end
        start = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word in the rows' bytes."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts - 1
    before = before[before >= 0]
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def eights(data: np.ndarray) -> np.ndarray:
    """At each place, the eight bytes from there on as one number; zeros follow the last."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _eight(view: np.ndarray, starts: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of each slice, as far as it has them."""
    return view[starts + 8 * k] & _FIRST[np.clip(size - 8 * k, 0, 8)]


def _salt(k: np.ndarray | int) -> np.ndarray:
    return mix64(np.atleast_1d(np.asarray(k, np.uint64)) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice that depends on its bytes alone: sums of its scrambled eights, each scrambled by its place.

    There is no form of words that collide, as there is for sums of powers modulo 2**64.
    """
    view, size = eights(data), ends - starts
    out = mix64(_eight(view, starts, size, 0))
    rest, k = np.flatnonzero((size > 8) & (size <= _LONG)), 1
    while len(rest):
        out[rest] += mix64(_eight(view, starts[rest], size[rest], k) ^ _salt(k))
        k += 1
        rest = rest[size[rest] > 8 * k]
    for i in np.flatnonzero(size > _LONG).tolist():
        for at in range(8, int(size[i]), 1 << 20):
            places = np.arange(at, min(int(size[i]), at + (1 << 20)), 8)
            part = view[starts[i] + places] & _FIRST[np.minimum(size[i] - places, 8)]
            out[i : i + 1] += mix64(part ^ _salt(places // 8)).sum(dtype=np.uint64)
    return mix64(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def differ(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the slices of ``a`` and ``b``, of ``size`` bytes each, have other bytes."""
    if not len(size):
        return np.empty(0, bool)
    left, right = eights(a), eights(b)
    out = _eight(left, a_starts, size, 0) != _eight(right, b_starts, size, 0)
    rest, k = np.flatnonzero(~out & (size > 8) & (size <= _LONG)), 1
    while len(rest):
        out[rest] = _eight(left, a_starts[rest], size[rest], k) != _eight(right, b_starts[rest], size[rest], k)
        k += 1
        rest = rest[~out[rest] & (size[rest] > 8 * k)]
    for i in np.flatnonzero(~out & (size > _LONG)).tolist():
        n = int(size[i])
        out[i] = not np.array_equal(a[a_starts[i] : a_starts[i] + n], b[b_starts[i] : b_starts[i] + n])
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``width`` words; a row of fewer words has one run of all its words."""
    starts, ends, rows = words_of(data, offsets)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = word_hashes(data, starts, ends)
    n_rows = len(offsets) - 1
    count = np.bincount(rows, minlength=n_rows)
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    full = np.flatnonzero(np.arange(len(rows)) + width <= (begin + count)[rows])
    value = np.zeros(len(full), np.uint64)
    for k in range(width):
        value = value * np.uint64(_BASE) + h[full + k]
    out_rows, out = [rows[full]], [mix64(value)]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            more = count[short] > k
            value[more] = value[more] * np.uint64(_BASE) + h[begin[short[more]] + k]
        out_rows.append(short)
        out.append(mix64(value ^ np.uint64(0xA5A5A5A5A5A5A5A5) ^ count[short].astype(np.uint64)))
    return np.concatenate(out_rows), np.concatenate(out)


def bags(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets by row: (row, 52-bit hash, count), sorted.  Rows must be below 4096."""
    keys = (rows.astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12))
    keys.sort()
    if not len(keys):
        return np.empty(0, np.int64), keys, np.empty(0, np.int64)
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate((at, [len(keys)])))
    keys = keys[at]
    return (keys >> np.uint64(52)).astype(np.int64), keys & np.uint64((1 << 52) - 1), counts
