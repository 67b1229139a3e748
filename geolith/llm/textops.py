"""Vectorised text primitives over Arrow string columns.

Everything works on whole texts: a batch is cut into slices of whole rows so
that the temporary arrays stay small, and a text longer than a slice becomes a
slice of its own.  A word is a maximal run of bytes other than the six ASCII
white-space characters.  Null texts have no words and are told apart from empty
texts by the validity mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0..P^(n-1) and their inverses modulo 2^64, grown on demand."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = 1 << (n - 1).bit_length() if n > 1 else 1
        for key, base in (("p", _P), ("q", _PINV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def string_array(column) -> pa.Array:
    """A string column as one Arrow array with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if column.type == pa.large_string() else column.cast(pa.large_string())


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a large_string array; null rows span no bytes."""
    n = len(array)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + n + 1] if n else np.zeros(1, np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = ~np.asarray(array.is_null()) if array.null_count else np.ones(n, dtype=bool)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` summed size each, or one larger row."""
    ends = np.cumsum(sizes)
    start, n = 0, len(sizes)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def text_slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets, valid) for slices of whole rows."""
    array = string_array(column)
    if not len(array):
        return
    raw, offsets, valid = buffers(array)
    for a, b in slices(np.diff(offsets), limit):
        o = offsets[a : b + 1]
        yield a, b, raw[o[0] : o[-1]], o - o[0], valid[a:b]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per row): words don't reach across rows."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    stops[last] = inside[last]
    ends = np.flatnonzero(stops) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand.

    Each byte counts as a random number of its value and its place in the span, so
    that no periodic or self-similar spans cancel out, as they do in polynomials
    modulo 2^64.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    place = ranges(n)
    key = raw[np.repeat(starts, n) + place]
    key = (_LOWER[key] if lower else key).astype(np.int64)
    key += place << 8
    if n.max() <= _TABLED:
        values = _RANDOM[key]
    else:
        values = mix((key + 1).astype(np.uint64) * _P)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    last = np.cumsum(n)
    return mix(sums[last] - sums[last - n] + n.astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLED = 128
_RANDOM = mix(np.arange(1, (_TABLED << 8) + 1, dtype=np.uint64) * _P)


def segment_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths, 0 for empty runs."""
    sums = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c in counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
