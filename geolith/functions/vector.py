"""Columns of WKB as arrays: where each geometry's coordinates stand.

`Shapes` walks all geometries of a column side by side, a run of coordinates (a
point, a line or a ring) at each step, so that the number of steps is that of the
most complex geometry and not that of the rows. Little-endian geometries of ISO types
are read so, in any dimension; collections, other byte orders and flags, malformed
bytes and NaNs beyond empty points are left (`slow`) to the reader in `geometry`,
which has the last word on what is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

POINT, LINE, POLYGON = 1, 2, 3


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a binary column; null rows span no bytes."""
    if column.type != pa.large_binary():
        column = column.cast(pa.large_binary())
    n = len(column)
    valid = np.asarray(column.is_valid())
    if not n or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def binary_column(raw: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A binary column of bytes and offsets, null where not valid."""
    bits = pa.py_buffer(np.packbits(valid, bitorder="little")) if not valid.all() else None
    out = pa.Array.from_buffers(pa.large_binary(), len(valid), [bits, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
    return out.cast(pa.binary())


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Shapes:
    """kind, level (1 z, 2 m, 3 both), width (doubles a coordinate) and parts of each row; of each run its row, kind, ring number, place and count."""

    def __init__(self, column: pa.Array):
        self.raw, self.offsets, self.valid = binary_parts(column)
        n = len(self.valid)
        self.slow = np.zeros(n, bool)
        self.kind, self.level, self.width, self.parts = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, 2), np.zeros(n, np.int64)
        self.end = self.offsets[1:]
        self._walk()
        order = np.argsort(self.run_row, kind="stable")
        self.run_row, self.run_kind, self.run_ring, self.run_at, self.run_n = (x[order] for x in (self.run_row, self.run_kind, self.run_ring, self.run_at, self.run_n))
        self._xy = None
        nan = np.isnan(self.xy).any(axis=1)
        if nan.any():
            self._without_nans(nan)

    def _u4(self, at: np.ndarray) -> np.ndarray:
        return self.raw[at[:, None] + np.arange(4)].view("<u4")[:, 0].astype(np.int64)

    def _header(self, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ok, type, dimensions' thousands) of the headers at those places."""
        ok = at + 5 <= self.end[rows]
        place = np.where(ok, at, 0)
        code = self._u4(place + 1) if len(place) else np.zeros(0, np.int64)
        ok = ok & (self.raw[place] == 1) & (code < 4000)
        return ok, code % 1000, code // 1000

    def _walk(self) -> None:
        found: list[tuple[np.ndarray, ...]] = []
        rows = np.flatnonzero(self.valid)
        self.slow[rows] = self.end[rows] - self.offsets[rows] < 9
        rows = rows[~self.slow[rows]]
        ok, kind, level = self._header(rows, self.offsets[rows])
        ok &= (kind >= 1) & (kind <= 6)
        self.slow[rows[~ok]] = True
        rows, kind, level = rows[ok], kind[ok], level[ok]
        self.kind[rows], self.level[rows], self.width[rows] = kind, level, np.array([2, 3, 3, 4])[level]
        pos = self.offsets[rows] + 5
        many = kind > POLYGON
        self.parts[rows] = np.where(many, self._u4(np.where(many, pos, 0)) if len(pos) else 0, 1)
        pos = pos + 4 * many
        left, rings, ring = self.parts[rows].copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        part = np.where(many, kind - 3, kind)
        size, far = 8 * self.width[rows], self.end[rows]
        headed = ~many  # whether the part's header has been read
        live = np.arange(len(rows))
        while len(live):
            # a part begins: its header, and a polygon's number of rings
            start = live[(rings[live] == 0) & (left[live] > 0)]
            inner = start[~headed[start]]
            if len(inner):
                good, k, lv = self._header(rows[inner], pos[inner])
                good &= (k == part[inner]) & (lv == level[inner])
                self.slow[rows[inner[~good]]] = True
                pos[inner] += 5
                start = start[~self.slow[rows[start]]]
            shell = start[part[start] == POLYGON]
            shell = self._fits(rows, shell, pos, 4, far)
            if len(shell):
                rings[shell] = self._u4(pos[shell])
                ring[shell] = 0
                pos[shell] += 4
            left[start] -= 1
            headed[start] = False
            # a point, a line or a ring
            go = live[~self.slow[rows[live]]]
            begun = np.zeros(len(rows), bool)
            begun[start] = True
            point, line, of = go[begun[go] & (part[go] == POINT)], go[begun[go] & (part[go] == LINE)], go[(part[go] == POLYGON) & (rings[go] > 0)]
            counted = self._fits(rows, np.r_[line, of], pos, 4, far)
            count = np.ones(len(rows), np.int64)
            if len(counted):
                count[counted] = self._u4(pos[counted])
                pos[counted] += 4
            run = np.r_[point, counted]
            good = pos[run] + count[run] * size[run] <= far[run]
            self.slow[rows[run[~good]]] = True
            run = run[good]
            if len(run):
                found.append((rows[run], part[run], ring[run], pos[run], count[run]))
                pos[run] += count[run] * size[run]
            rings[of] -= 1
            ring[of] += 1
            live = go[(left[go] > 0) | (rings[go] > 0)]
        over = pos != far
        self.slow[rows[over]] = True
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
        keep = ~self.slow[parts[0]]
        self.run_row, self.run_kind, self.run_ring, self.run_at, self.run_n = (x[keep] for x in parts)

    def _fits(self, rows: np.ndarray, some: np.ndarray, pos: np.ndarray, n: int, far: np.ndarray) -> np.ndarray:
        good = pos[some] + n <= far[some]
        self.slow[rows[some[~good]]] = True
        return some[good]

    def _without_nans(self, nan: np.ndarray) -> None:
        """Points of NaNs are empty; any other NaN makes its row slow."""
        of = np.repeat(np.arange(len(self.run_n)), self.run_n)
        empty = (self.run_kind == POINT) & (np.bincount(of, np.isnan(self.xy).all(axis=1), len(self.run_n)) > 0) & (self.width[self.run_row] == 2)
        self.slow[self.run_row[of[nan & ~empty[of]]]] = True
        self.run_n = np.where(empty, 0, self.run_n)
        keep = ~self.slow[self.run_row]
        self.run_row, self.run_kind, self.run_ring, self.run_at, self.run_n = (x[keep] for x in (self.run_row, self.run_kind, self.run_ring, self.run_at, self.run_n))
        self._xy = None

    @property
    def fast(self) -> np.ndarray:
        return self.valid & ~self.slow

    @property
    def point_at(self) -> np.ndarray:
        """The byte where each coordinate stands."""
        return np.repeat(self.run_at, self.run_n) + ranges(self.run_n) * 8 * np.repeat(self.width[self.run_row], self.run_n)

    @property
    def xy(self) -> np.ndarray:
        """(coordinates, 2) in the order of rows and runs."""
        if self._xy is None:
            self._xy = self.raw[self.point_at[:, None] + np.arange(16)].view("<f8") if len(self.run_n) else np.zeros((0, 2))
        return self._xy

    @property
    def points(self) -> np.ndarray:
        """Coordinates of each row."""
        return np.bincount(self.run_row, self.run_n, len(self.valid)).astype(np.int64)

    @property
    def run_first(self) -> np.ndarray:
        """The first coordinate of each run."""
        return np.cumsum(self.run_n) - self.run_n

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """(first coordinate, run) of all pairs of neighbours within runs."""
        n = np.maximum(self.run_n - 1, 0)
        return np.repeat(self.run_first, n) + ranges(n), np.repeat(np.arange(len(n)), n)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """((rows, 4), there): least and greatest x and y; not there without coordinates."""
        points = self.points
        there = points > 0
        out = np.full((len(points), 4), np.nan)
        if there.any():
            at = (np.cumsum(points) - points)[there]
            out[there, :2] = np.minimum.reduceat(self.xy, at, axis=0)
            out[there, 2:] = np.maximum.reduceat(self.xy, at, axis=0)
        return out, there

    def measure(self, kinds: tuple[int, ...]) -> np.ndarray:
        """The length of all runs of those kinds, for each row."""
        at, run = self.segments()
        chosen = np.isin(self.run_kind[run], kinds)
        at, run = at[chosen], run[chosen]
        d = self.xy[at + 1] - self.xy[at]
        return np.bincount(self.run_row[run], np.hypot(d[:, 0], d[:, 1]), len(self.valid))

    def area(self) -> np.ndarray:
        """Of polygons, less their holes."""
        at, run = self.segments()
        chosen = self.run_kind[run] == POLYGON
        at, run = at[chosen], run[chosen]
        origin = self.xy[self.run_first[run]]
        a, b = self.xy[at] - origin, self.xy[at + 1] - origin
        rings = np.abs(np.bincount(run, a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1], len(self.run_n))) / 2
        return np.bincount(self.run_row, np.where(self.run_ring > 0, -rings, rings), len(self.valid))

    def changed(self, xy: np.ndarray) -> np.ndarray:
        """The column's bytes with other coordinates in place of those there are."""
        out = self.raw.copy()
        out[self.point_at[:, None] + np.arange(16)] = np.ascontiguousarray(xy, "<f8").view(np.uint8)
        return out

    def closed_runs(self) -> np.ndarray:
        """Whether each run ends where it begins; runs without coordinates do."""
        first, last = self.run_first, self.run_first + self.run_n - 1
        there = self.run_n > 0
        out = np.ones(len(first), bool)
        out[there] = (self.xy[first[there]] == self.xy[last[there]]).all(axis=1)
        return out

    def rectangles(self) -> np.ndarray:
        """Rows that are a polygon of one ring, or a line, round an upright rectangle of some area."""
        runs = np.bincount(self.run_row, minlength=len(self.valid))
        run = np.flatnonzero((self.run_n == 5) & (runs[self.run_row] == 1) & (self.run_kind > POINT) & (self.parts[self.run_row] == 1) & (self.kind[self.run_row] <= POLYGON))
        out = np.zeros(len(self.valid), bool)
        c = self.xy[self.run_first[run][:, None] + np.arange(5)] if len(run) else np.zeros((0, 5, 2))
        turn = np.diff(c, axis=1) == 0  # which coordinate stands still along each side
        alternate = (turn[:, :, 0] != turn[:, :, 1]).all(axis=1) & (turn[:, :-1, 0] != turn[:, 1:, 0]).all(axis=1)
        out[self.run_row[run]] = alternate & (c[:, 0] == c[:, 4]).all(axis=1)
        return out & np.isfinite(self.bounds()[0]).all(axis=1)


def encode(kind: int, counts: np.ndarray, xy: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Lines (or polygons of one ring) of consecutive coordinates, null where not valid and without coordinates there."""
    head = 9 if kind == LINE else 13
    size = np.where(valid, head + 16 * counts, 0)
    offsets = np.r_[0, np.cumsum(size)]
    out = np.zeros(int(offsets[-1]), np.uint8)
    rows = np.flatnonzero(valid)
    at = offsets[:-1][rows]
    top = np.zeros((len(rows), head), np.uint8)
    top[:, 0] = 1
    top[:, 1] = kind
    if kind == POLYGON:
        top[:, 5] = 1
    top[:, head - 4 :] = counts[rows].astype("<u4")[:, None].view(np.uint8)
    out[at[:, None] + np.arange(head)] = top
    n = counts[rows]
    out[(np.repeat(at + head, n) + 16 * ranges(n))[:, None] + np.arange(16)] = np.ascontiguousarray(xy, "<f8").view(np.uint8)
    return binary_column(out, offsets, valid)
