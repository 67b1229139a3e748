"""Spatial functions as Columns, and their SQL names.

Geometries are WKB in binary columns. Functions run on Arrow batches, in numpy over
the coordinates of all rows (`vector.Shapes`); rows that can't be, and predicates
between general shapes, are worked out geometry by geometry by the exact kernel. A
null argument gives null, but for `st_hasarc`, which is false whatever it is given.
Bytes that aren't WKB raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from geolith.functions import geometry as G
from geolith.functions import kernel as K
from geolith.functions import vector as V
from geolith.functions.vector import Shapes

_POINT = np.dtype([("order", "u1"), ("code", "<u4"), ("x", "<f8"), ("y", "<f8")])
BOUNDS = ("minx", "miny", "maxx", "maxy")
TYPE_NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


def points_of(geoms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(x, y, valid) where every geometry that isn't null is a plain little-endian point."""
    if not len(geoms) or pa.types.is_null(geoms.type) or not pc.all(pc.equal(pc.binary_length(geoms), 21), skip_nulls=True).as_py():
        return None
    valid = np.asarray(geoms.is_valid())
    packed = geoms.drop_null()
    rows = V.binary_parts(packed)[0].view(_POINT)
    if not ((rows["order"] == 1) & (rows["code"] == 1)).all():
        return None
    x, y = np.full(len(geoms), np.nan), np.full(len(geoms), np.nan)
    x[valid], y[valid] = rows["x"], rows["y"]
    return x, y, valid


def encode_points(x: np.ndarray, y: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Points as WKB, null where not valid."""
    rows = np.empty(len(x), _POINT)
    rows["order"], rows["code"], rows["x"], rows["y"] = 1, 1, x, y
    out = pa.Array.from_buffers(pa.binary(21), len(x), [None, pa.py_buffer(rows.tobytes())])
    return pc.if_else(pa.array(valid), out.cast(pa.binary()), pa.scalar(None, pa.binary()))


class _Decoded:
    """Geometries of a column; a run of equal bytes is read once."""

    def __init__(self):
        self.raw, self.geometry = None, None

    def __call__(self, raw: bytes) -> G.Geometry:
        if raw != self.raw:
            self.geometry = G.read_wkb(raw)
            self.raw = raw
        return self.geometry


def _rows(function, kinds: str, result: str):
    """An Arrow function that applies `function` to each row; g in kinds is a geometry."""
    wrap = G.write_wkb if result == "binary" else None
    to = {"binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}[result]

    def run(*columns: pa.Array) -> pa.Array:
        readers = [_Decoded() if k == "g" else float if k == "d" else int if k == "i" else (lambda x: x) for k in kinds]
        out = []
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            value = None if None in row else function(*(r(x) for r, x in zip(readers, row, strict=True)))
            out.append(wrap(value) if wrap and value is not None else value)
        return pa.array(out, to)

    return run


def _make_line(points: list[bytes | None]) -> G.Geometry:
    found = [G.read_wkb(p) for p in points if p is not None]
    return G.Geometry(G.LINE, tuple(c for g in found for c in g.coordinates()))


def _in_polygon(x: np.ndarray, y: np.ndarray, g: G.Geometry) -> np.ndarray:
    """Which points lie in a polygon or on it; close calls are decided exactly."""
    inside, close = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for ring in g.data:
        for a, b in zip(ring, ring[1:], strict=False):
            left, right = (b[0] - a[0]) * (y - a[1]), (b[1] - a[1]) * (x - a[0])
            det = left - right
            close |= (np.abs(det) <= 1e-12 * (np.abs(left) + np.abs(right))) & (x >= min(a[0], b[0])) & (x <= max(a[0], b[0])) & (y >= min(a[1], b[1])) & (y <= max(a[1], b[1]))
            crossing = (a[1] > y) != (b[1] > y)
            inside ^= crossing & ((det if b[1] > a[1] else -det) > 0)
    for i in np.flatnonzero(close):
        inside[i] = K.place_in_rings((float(x[i]), float(y[i])), g.data) >= 0
    return inside


def _merged(fast: pa.Array, slow_rows: np.ndarray, slow: pa.Array | None) -> pa.Array:
    """A column with some rows taken from another one."""
    if not len(slow_rows):
        return fast
    at = np.arange(len(fast))
    at[slow_rows] = len(fast) + np.arange(len(slow_rows))
    return pa.concat_arrays([fast, slow.cast(fast.type)]).take(pa.array(at))


def _mixed(fast, slow):
    """An Arrow function by `fast` on Shapes and further columns; rows it calls slow go one by one."""

    def run(geoms: pa.Array, *more: pa.Array) -> pa.Array:
        shapes = Shapes(geoms)
        for c in more:
            shapes.valid &= np.asarray(c.is_valid())
        shapes.slow &= shapes.valid
        out = fast(shapes, *more)
        rows = np.flatnonzero(shapes.slow & shapes.valid)
        return _merged(out, rows, slow(*(c.take(pa.array(rows)) for c in (geoms, *more))) if len(rows) else None)

    return run


def _some(values: np.ndarray, there: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, mask=~there)


def _intersects(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = Shapes(a), Shapes(b)
    (p, p_there), (q, q_there) = x.bounds(), y.bounds()
    both = x.valid & y.valid
    fast = x.fast & y.fast
    with np.errstate(invalid="ignore"):
        near = p_there & q_there & (p[:, 2] >= q[:, 0]) & (q[:, 2] >= p[:, 0]) & (p[:, 3] >= q[:, 1]) & (q[:, 3] >= p[:, 1])
    out = near & fast
    # where both fill their bounds, that their bounds meet is all there is to it
    full = [(s.kind == V.POINT) | (s.rectangles() & (s.kind == V.POLYGON)) for s in (x, y)]
    left = fast & near & ~(full[0] & full[1])
    for points, shapes, column in ((x, y, b), (y, x, a)):
        rows = np.flatnonzero(left & (points.kind == V.POINT) & (shapes.kind == V.POLYGON))
        if not len(rows):
            continue
        probes = column.take(pa.array(rows)).dictionary_encode()
        if len(probes.dictionary) * 4 > len(rows):
            continue
        place = points.run_first[np.searchsorted(points.run_row, rows)]
        which = np.asarray(probes.indices)
        order = np.argsort(which, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
            at = points.xy[place[part]]
            out[rows[part]] = _in_polygon(at[:, 0], at[:, 1], G.read_wkb(probes.dictionary[int(which[part[0]])].as_py()))
        left[rows] = False
    rows = np.flatnonzero(both & (left | ~fast))
    slow = _rows(K.intersects, "gg", "boolean")(a.take(pa.array(rows)), b.take(pa.array(rows))) if len(rows) else None
    return _merged(_some(out, both, pa.bool_()), rows, slow)


def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = Shapes(a), Shapes(b)
    both = x.valid & y.valid
    out, done = np.full(len(both), np.inf), np.zeros(len(both), bool)
    for points, shapes in ((x, y), (y, x)):
        rows = both & points.fast & shapes.fast & (points.kind == V.POINT) & (points.points == 1) & (shapes.points > 0) & ~done
        if not rows.any():
            continue
        p = np.full((len(both), 2), np.nan)
        p[points.run_row] = points.xy[np.minimum(points.run_first, max(len(points.xy) - 1, 0))]
        edge, _ = shapes.bounds()
        polygon = (shapes.kind == V.POLYGON) | (shapes.kind == V.POLYGON + 3)
        with np.errstate(invalid="ignore"):
            rows &= ~(polygon & (p >= edge[:, :2]).all(axis=1) & (p <= edge[:, 2:]).all(axis=1))
        at, run = shapes.segments()
        lone = shapes.run_first[shapes.run_n == 1]
        at, to = np.r_[at, lone], np.r_[at + 1, lone]
        row = np.r_[shapes.run_row[run], shapes.run_row[shapes.run_n == 1]]
        keep = rows[row]
        at, to, row = at[keep], to[keep], row[keep]
        u, d = shapes.xy[at], shapes.xy[to] - shapes.xy[at]
        n = (d * d).sum(axis=1)
        t = np.clip(((p[row] - u) * d).sum(axis=1) / np.where(n > 0, n, 1), 0, 1)
        gap = p[row] - u - t[:, None] * d
        np.minimum.at(out, row, np.hypot(gap[:, 0], gap[:, 1]))
        done |= rows
    rows = np.flatnonzero(both & ~done)
    slow = _rows(K.distance, "gg", "double")(a.take(pa.array(rows)), b.take(pa.array(rows))) if len(rows) else None
    return _merged(_some(out, both, pa.float64()), rows, slow)


def _bounds(geoms: pa.Array) -> pa.Array:
    points = points_of(geoms)
    if points:
        x, y, valid = points
        there = ~(np.isnan(x) | np.isnan(y)) & valid
        edges = [x, y, x, y]
    else:
        shapes = Shapes(geoms)
        found, there = shapes.bounds()
        rows = np.flatnonzero(shapes.slow)
        for i, g in zip(rows.tolist(), geoms.take(pa.array(rows)).to_pylist(), strict=True):
            b = G.read_wkb(g).bounds()
            there[i] = b is not None
            found[i] = b or np.nan
        edges = [np.ascontiguousarray(found[:, k]) for k in range(4)]
    return pa.StructArray.from_arrays([_some(e, there, pa.float64()) for e in edges], BOUNDS)


def _points(x: pa.Array, y: pa.Array) -> pa.Array:
    valid = np.asarray(x.is_valid()) & np.asarray(y.is_valid())
    return encode_points(np.asarray(x.cast(pa.float64()).fill_null(0)), np.asarray(y.cast(pa.float64()).fill_null(0)), valid)


def _checked(geoms: pa.Array) -> pa.Array:
    if points_of(geoms) is None:
        for g in geoms.take(pa.array(np.flatnonzero(Shapes(geoms).slow))).to_pylist():
            G.read_wkb(g)
    return geoms


def _coordinate(axis: int):
    def one(g: G.Geometry) -> float | None:
        if g.kind != G.POINT:
            raise G.GeometryError("only a point has this coordinate")
        return None if g.data is None else g.data[axis]

    slow = _rows(one, "g", "double")

    def run(geoms: pa.Array) -> pa.Array:
        points = points_of(geoms)
        if not points:
            return slow(geoms)
        empty = np.isnan(points[0]) & np.isnan(points[1])
        return pa.array(points[axis], mask=~points[2] | empty)

    return run


def _edge(k: int):
    return lambda geoms: _bounds(geoms).field(k)


def _binary_text(geoms: pa.Array, order: pa.Array) -> pa.Array:
    if any(o is not None and o.upper() != "NDR" for o in order.unique().to_pylist()):
        raise G.GeometryError("only the byte order NDR is written")
    return pc.if_else(order.is_valid(), geoms, pa.scalar(None, geoms.type))


def _depth(k: int, worst):
    """The least or greatest z of a geometry, None without z."""
    return lambda g: worst((c[2] for c in g.coordinates()), default=None) if g.z else None


def _ext(a: pa.Array, b: pa.Array) -> pa.Array:
    p, q = _bounds(a), _bounds(b)
    side = lambda s, k: np.asarray(s.field(k).fill_null(np.nan))
    with np.errstate(invalid="ignore"):
        hit = (side(p, 2) >= side(q, 0)) & (side(q, 2) >= side(p, 0)) & (side(p, 3) >= side(q, 1)) & (side(q, 3) >= side(p, 1))
    return _some(hit, np.asarray(a.is_valid()) & np.asarray(b.is_valid()), pa.bool_())


def _envelopes(*edges: pa.Array) -> pa.Array:
    valid = np.logical_and.reduce([np.asarray(e.is_valid()) for e in edges])
    x1, y1, x2, y2 = (np.asarray(e.cast(pa.float64()).fill_null(0))[valid] for e in edges)
    ring = np.stack([x1, y1, x1, y2, x2, y2, x2, y1, x1, y1], axis=1).reshape(-1, 2)
    return V.encode(V.POLYGON, np.where(valid, 5, 0), ring, valid)


def _lines(lists: pa.Array) -> pa.Array:
    """Lines of lists of points; nulls in a list are left out."""
    flat = lists.flatten().drop_null()
    points = points_of(flat) if len(flat) else None
    if not points or np.isnan(points[0]).any():
        return _rows(_make_line, "a", "binary")(lists)
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    if lists.flatten().null_count:
        there = np.asarray(lists.flatten().is_valid())
        sizes = np.diff(np.r_[0, np.cumsum(there)][np.r_[0, np.cumsum(sizes)]])
    return V.encode(V.LINE, sizes, np.stack(points[:2], axis=1), np.asarray(lists.is_valid()))


def _vertex(pick):
    """Vertex number pick(further arguments) of lines, from 1, or from -1 at the end."""

    def fast(s: Shapes, *more: pa.Array) -> pa.Array:
        s.slow |= s.fast & (s.kind == V.LINE) & (s.width != 2)
        n = pick(len(s.valid), *more)
        points = s.points
        there = s.fast & (s.kind == V.LINE) & (n != 0) & (np.abs(n) <= points)
        at = (np.cumsum(points) - points + np.where(n > 0, n - 1, points + n))[there]
        x, y = np.zeros(len(n)), np.zeros(len(n))
        x[there], y[there] = s.xy[at].T
        return encode_points(x, y, there)

    return fast


def _ring(pick, outer: bool):
    def fast(s: Shapes, *more: pa.Array) -> pa.Array:
        s.slow |= s.fast & (s.kind == V.POLYGON) & (s.width != 2)
        n = pick(len(s.valid), *more)
        run = np.flatnonzero((s.kind[s.run_row] == V.POLYGON) & s.fast[s.run_row] & (s.run_ring == n[s.run_row]) & (outer | (n[s.run_row] > 0)))
        counts, there = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
        counts[s.run_row[run]], there[s.run_row[run]] = s.run_n[run], True
        at = np.repeat(s.run_first[run], s.run_n[run]) + V.ranges(s.run_n[run])
        return V.encode(V.LINE, counts, s.xy[at], there)

    return fast


def _whole(numbers: pa.Array) -> np.ndarray:
    return np.asarray(numbers.cast(pa.int64()).fill_null(0))


def _moved(change):
    """Geometries with other coordinates, in the same places."""

    def fast(s: Shapes, *more: pa.Array) -> pa.Array:
        row = np.repeat(s.run_row, s.run_n)
        xy = change(s.xy, *(np.asarray(c.cast(pa.float64()).fill_null(0))[row] for c in more))
        return V.binary_column(s.changed(xy), s.offsets, s.valid)

    return fast


def _backwards(s: Shapes) -> pa.Array:
    s.slow |= s.fast & (s.width != 2)
    n = np.repeat(s.run_n, s.run_n)
    return V.binary_column(s.changed(s.xy[np.repeat(s.run_first, s.run_n) + n - 1 - V.ranges(s.run_n)]), s.offsets, s.valid)


def _named(prefix: str, names: dict[int, str]):
    words = pa.array([None, *(prefix + names[k] for k in range(1, 7))], pa.string())
    return lambda s: words.take(pa.array(np.where(s.fast, s.kind, 0)))


def _number(value, kind: pa.DataType):
    """A number for each row by `value` of its Shapes; a pair also tells where there is one."""

    def fast(s: Shapes) -> pa.Array:
        found = value(s)
        values, there = found if isinstance(found, tuple) else (found, True)
        return _some(np.asarray(values).astype(kind.to_pandas_dtype()), s.valid & there, kind)

    return fast


def _all_runs(s: Shapes, chosen: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Rows of which all chosen runs are good."""
    return np.bincount(s.run_row[chosen & ~good], minlength=len(s.valid)) == 0


def _is_closed(s: Shapes) -> np.ndarray:
    return _all_runs(s, s.run_kind == V.LINE, s.closed_runs()) & (s.points > 0)


def _is_ring(s: Shapes) -> pa.Array:
    box, closed = s.rectangles(), _is_closed(s)
    s.slow |= s.fast & ((s.kind != V.LINE) | (closed & ~box))
    return _some(closed, s.valid, pa.bool_())


def _is_valid(s: Shapes) -> pa.Array:
    """Points, lines of two places and rectangles are valid; rings of other shapes are looked at one by one."""
    finite = np.bincount(np.repeat(s.run_row, s.run_n), ~np.isfinite(s.xy).all(axis=1), len(s.valid)) == 0
    at, run = s.segments()
    moves = np.bincount(run, (s.xy[at] != s.xy[at + 1]).any(axis=1), len(s.run_n)) > 0
    good = finite & _all_runs(s, s.run_kind == V.LINE, moves | (s.run_n == 0))
    areal = (s.kind == V.POLYGON) | (s.kind == V.POLYGON + 3)
    s.slow |= s.fast & areal & finite & ~s.rectangles()
    return _some(good, s.valid, pa.bool_())


def _shallow(s: Shapes) -> pa.Array:
    s.slow |= s.fast & ((s.level & 1) == 1)
    return pa.nulls(len(s.valid), pa.float64())


def _flat(s: Shapes) -> pa.Array:
    s.slow |= s.fast & (s.width != 2)
    return V.binary_column(s.raw, s.offsets, s.valid)


def _distinct(function):
    """A function of one column, worked out once for each distinct value of a batch."""

    def run(values: pa.Array) -> pa.Array:
        found = values.dictionary_encode()
        return function(found.dictionary).take(found.indices)

    return run


def _rings(g: G.Geometry) -> int | None:
    return max(0, len(g.data) - 1) if g.kind == G.POLYGON else None


_ROW = {
    "st_geomfromtext": (lambda t: G.read_wkt(t), "s", "binary"), "st_astext": (G.write_wkt, "g", "string"),
    "st_force2d": (lambda g: g.moved(lambda c: c[:2], False, False), "g", "binary"),
    "st_zmflag": (lambda g: g.m + 2 * g.z, "g", "int"), "st_dimension": (K.dimension, "g", "int"), "st_numinteriorrings": (_rings, "g", "int"),
    "st_exteriorring": (lambda g: K.ring(g, 0), "g", "binary"), "st_interiorringn": (lambda g, n: K.ring(g, n) if n > 0 else None, "gi", "binary"),
    "st_isempty": (lambda g: g.empty, "g", "boolean"), "st_isvalid": (K.valid, "g", "boolean"), "geometrytype": (lambda g: G.NAMES[g.kind], "g", "string"),
    "st_geometrytype": (lambda g: "ST_" + TYPE_NAMES[g.kind], "g", "string"), "st_area": (K.area, "g", "double"),
    "st_length": (K.length, "g", "double"), "st_perimeter": (K.perimeter, "g", "double"), "st_npoints": (lambda g: sum(1 for _ in g.coordinates()), "g", "int"),
    "st_startpoint": (lambda g: K.vertex(g, 1), "g", "binary"), "st_endpoint": (lambda g: K.vertex(g, -1), "g", "binary"), "st_pointn": (K.vertex, "gi", "binary"),
    "st_isclosed": (K.closed, "g", "boolean"), "st_isring": (K.is_ring, "g", "boolean"), "st_reverse": (K.reverse, "g", "binary"),
    "st_flipcoordinates": (lambda g: g.moved(lambda c: (c[1], c[0], *c[2:])), "g", "binary"),
    "st_translate": (lambda g, x, y: g.moved(lambda c: (c[0] + x, c[1] + y, *c[2:])), "gdd", "binary"),
    "st_scale": (lambda g, x, y: g.moved(lambda c: (c[0] * x, c[1] * y, *c[2:])), "gdd", "binary"),
    "st_numgeometries": (K.count_parts, "g", "int"), "st_srid": (lambda g: 0, "g", "int"),
    "st_zmin": (_depth(0, min), "g", "double"), "st_zmax": (_depth(1, max), "g", "double"), "number_text": (G.number, "d", "string"),
}
_EXTENDED = {
    "st_ndims": (lambda g: 2 + g.z + g.m, "g", "int"), "st_coorddim": (lambda g: 2 + g.z + g.m, "g", "int"), "st_geometryn": (K.nth_part, "gi", "binary"),
    "find_srid": (lambda a, b, c: 0, "sss", "int"),
}
#: Functions that have their own way with whole batches: (function, Spark type).
_BATCH = {
    "st_intersects": (_intersects, "boolean"), "st_point": (_points, "binary"), "st_geomfromwkb": (_checked, "binary"), "st_bounds": (_bounds, "struct<minx:double,miny:double,maxx:double,maxy:double>"),
    "st_x": (_coordinate(0), "double"), "st_y": (_coordinate(1), "double"), "st_xmin": (_edge(0), "double"), "st_ymin": (_edge(1), "double"),
    "st_box_xmax": (_edge(2), "double"), "st_box_ymax": (_edge(3), "double"), "st_intersects_extent": (_ext, "boolean"), "st_asbinary": (_binary_text, "binary"),
    "st_distance": (_distance, "double"), "st_makeenvelope": (_envelopes, "binary"), "st_makeline": (_lines, "binary"),
}
_I4, _F8 = pa.int32(), pa.float64()
_FLAGS, _DIMENSIONS = np.array([0, 2, 1, 3]), np.array([0, 0, 1, 2, 0, 1, 2])
#: The ways of the row functions with Shapes.
_FAST = {
    "st_force2d": _flat, "st_zmflag": _number(lambda s: _FLAGS[s.level], _I4), "st_dimension": _number(lambda s: _DIMENSIONS[s.kind], _I4),
    "st_numinteriorrings": _number(lambda s: (np.maximum(np.bincount(s.run_row, minlength=len(s.valid)) - 1, 0), s.kind == V.POLYGON), _I4),
    "st_exteriorring": _ring(lambda n: np.zeros(n, np.int64), True), "st_interiorringn": _ring(lambda _, n: _whole(n), False),
    "st_isempty": _number(lambda s: s.points == 0, pa.bool_()), "st_isvalid": _is_valid, "geometrytype": _named("", G.NAMES), "st_geometrytype": _named("ST_", TYPE_NAMES),
    "st_area": _number(Shapes.area, _F8), "st_length": _number(lambda s: s.measure((V.LINE,)), _F8), "st_perimeter": _number(lambda s: s.measure((V.POLYGON,)), _F8),
    "st_npoints": _number(lambda s: s.points, _I4), "st_startpoint": _vertex(lambda n: np.ones(n, np.int64)), "st_endpoint": _vertex(lambda n: -np.ones(n, np.int64)),
    "st_pointn": _vertex(lambda _, n: _whole(n)), "st_isclosed": _number(_is_closed, pa.bool_()), "st_isring": _is_ring, "st_reverse": _backwards,
    "st_flipcoordinates": _moved(lambda c: c[:, ::-1]), "st_translate": _moved(lambda c, x, y: c + np.stack([x, y], axis=1)), "st_scale": _moved(lambda c, x, y: c * np.stack([x, y], axis=1)),
    "st_numgeometries": _number(lambda s: np.where(s.kind > V.POLYGON, s.parts, s.points > 0), _I4), "st_srid": _number(lambda s: np.zeros(len(s.valid)), _I4),
    "st_zmin": _shallow, "st_zmax": _shallow,
}
ALIASES = {"st_makepoint": "st_point", "st_numpoints": "st_npoints"}
VERSION = "3.4.0"

_made: dict = {}


def arrow(name: str) -> tuple:
    """(Arrow function, Spark type) of a function by its SQL name."""
    name = ALIASES.get(name, name)
    if name in _BATCH:
        return _BATCH[name]
    function, kinds, kind = (_ROW | _EXTENDED)[name]
    run = _rows(function, kinds, kind)
    if name in _FAST:
        run = _mixed(_FAST[name], run)
    elif name in ("st_geomfromtext", "st_astext"):
        run = _distinct(run)
    return run, kind


def udf(name: str, once: bool = False):
    """The Arrow UDF of a function by its SQL name; the optimiser makes no copies of one that is evaluated once."""
    name = ALIASES.get(name, name)
    if (name, once) not in _made:
        made = F.arrow_udf(*arrow(name))
        _made[name, once] = made.asNondeterministic() if once else made
    return _made[name, once]


def call(name: str, *columns, once: bool = False) -> Column:
    """A function by its SQL name; values that aren't Columns are literals."""
    return udf(name.lower(), once)(*[c if isinstance(c, Column) else F.lit(c) for c in columns])


def extent(geom: Column) -> Column:
    """The aggregate `BOX(x y,x y)`, null without any coordinate; only built-in aggregates shuffle."""
    b = call("st_bounds", geom)
    edges = [call("number_text", f(b[k])) for f, k in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))]
    return F.concat(F.lit("BOX("), edges[0], F.lit(" "), edges[1], F.lit(","), edges[2], F.lit(" "), edges[3], F.lit(")"))


def extent_3d(geom: Column) -> Column:
    """The aggregate `BOX3D(x y z,x y z)`; a missing z is 0."""
    b = call("st_bounds", geom)
    low, high = (F.coalesce(f(call(n, geom)), F.lit(0.0)) for f, n in ((F.min, "st_zmin"), (F.max, "st_zmax")))
    e = [call("number_text", x) for x in (F.min(b["minx"]), F.min(b["miny"]), low, F.max(b["maxx"]), F.max(b["maxy"]), high)]
    return F.concat(F.lit("BOX3D("), e[0], F.lit(" "), e[1], F.lit(" "), e[2], F.lit(","), e[3], F.lit(" "), e[4], F.lit(" "), e[5], F.lit(")"))


_MACROS = {
    "postgis_lib_version()": f"'{VERSION}'", "postgis_version()": f"'{VERSION} GEOLITH'", "postgis_geos_version()": "'geolith-kernel'", "postgis_proj_version()": "'none'",
    "st_geomfromewkt(t STRING)": "st_geomfromtext(regexp_replace(t, '(?i)^\\\\s*SRID=[0-9]+;', ''))", "st_aswkb(g BINARY)": "g", "st_ashexewkb(g BINARY)": "hex(g)",
    "st_curvetoline(g BINARY)": "g", "st_hasarc(g BINARY)": "false",
}


def names() -> list[str]:
    """All SQL names of the functions, extended ones included."""
    return [*_ROW, *_BATCH, *ALIASES, *_EXTENDED, "st_xmax", "st_ymax", *(head.split("(")[0] for head in _MACROS)]


def register(spark: SparkSession, compat: str = "strict") -> None:
    """Give the session the SQL names; `extended` adds those that strict mode refuses."""
    for name in [*_ROW, *_BATCH, *ALIASES, *(_EXTENDED if compat == "extended" else ())]:
        spark.udf.register(name, udf(name))
    if compat == "extended":
        for alias, name in (("st_xmax", "st_box_xmax"), ("st_ymax", "st_box_ymax")):
            spark.udf.register(alias, udf(name))
    for head, body in _MACROS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
