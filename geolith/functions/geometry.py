"""Geometries in memory, and their WKB and WKT forms.

Coordinates are tuples of x, y and maybe z and m. WKB is written little-endian; both
byte orders, the ISO codes and the extended flags of others are read. An empty
point is a point of NaNs, as WKB has no other form for it.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass

NAMES = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}
CODES = {v: k for k, v in NAMES.items()}
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)


class GeometryError(ValueError):
    """A geometry that can't be read."""


@dataclass(frozen=True)
class Geometry:
    """`data`: a coordinate or None, a tuple of coordinates, a tuple of rings, or a tuple of geometries."""

    kind: int
    data: tuple | None
    z: bool = False
    m: bool = False

    def parts(self):
        """The points, lines and polygons it is made of."""
        if self.kind < MULTIPOINT:
            yield self
        else:
            for g in self.data:
                yield from g.parts()

    def coordinates(self):
        for g in self.parts():
            if g.kind == POINT:
                if g.data is not None:
                    yield g.data
            elif g.kind == LINE:
                yield from g.data
            else:
                for ring in g.data:
                    yield from ring

    @property
    def empty(self) -> bool:
        return next(self.coordinates(), None) is None

    def bounds(self) -> tuple[float, float, float, float] | None:
        """(minx, miny, maxx, maxy), None where empty."""
        points = list(self.coordinates())
        if not points:
            return None
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        return min(xs), min(ys), max(xs), max(ys)

    def moved(self, change, z: bool | None = None, m: bool | None = None) -> Geometry:
        """The same shape with every coordinate changed."""
        z, m = self.z if z is None else z, self.m if m is None else m
        if self.kind == POINT:
            data = None if self.data is None else change(self.data)
        elif self.kind == LINE:
            data = tuple(map(change, self.data))
        elif self.kind == POLYGON:
            data = tuple(tuple(map(change, ring)) for ring in self.data)
        else:
            data = tuple(g.moved(change, z, m) for g in self.data)
        return Geometry(self.kind, data, z, m)


def read_wkb(raw: bytes) -> Geometry:
    """A geometry of WKB; malformed bytes and bytes left over are errors."""
    try:
        g, end = _read(memoryview(raw), 0, 0)
    except (struct.error, IndexError) as e:
        raise GeometryError("WKB ends too early") from e
    if end != len(raw):
        raise GeometryError("WKB has bytes left over")
    return g


def _read(raw: memoryview, at: int, depth: int) -> tuple[Geometry, int]:
    if raw[at] > 1 or depth > 32:
        raise GeometryError("WKB has no such byte order")
    order = "<" if raw[at] else ">"
    (code,) = struct.unpack_from(order + "I", raw, at + 1)
    at += 5
    z, m = bool(code & 0x80000000), bool(code & 0x40000000)
    if code & 0x20000000:
        at += 4
    code &= 0x0FFFFFFF
    z, m = z or code // 1000 in (1, 3), m or code // 1000 in (2, 3)
    kind = code % 1000
    if kind not in NAMES or code >= 4000:
        raise GeometryError(f"WKB has no geometry type {code}")
    width = 2 + z + m

    def run(n: int, at: int) -> tuple[tuple, int]:
        if n * width * 8 > len(raw) - at:
            raise GeometryError("WKB ends too early")
        flat = struct.unpack_from(f"{order}{n * width}d", raw, at)
        return tuple(flat[i : i + width] for i in range(0, n * width, width)), at + n * width * 8

    if kind == POINT:
        (c,), at = run(1, at)
        return Geometry(kind, None if all(map(math.isnan, c)) else c, z, m), at
    (n,) = struct.unpack_from(order + "I", raw, at)
    at += 4
    if kind == LINE:
        data, at = run(n, at)
    else:
        items = []
        for _ in range(n):
            if kind == POLYGON:
                (k,) = struct.unpack_from(order + "I", raw, at)
                item, at = run(k, at + 4)
            else:
                item, at = _read(raw, at, depth + 1)
                if kind != COLLECTION and item.kind != kind - 3:
                    raise GeometryError("WKB has a part of another kind")
            items.append(item)
        data = tuple(items)
    return Geometry(kind, data, z, m), at


def write_wkb(g: Geometry) -> bytes:
    """Little-endian WKB."""
    head = struct.pack("<BI", 1, g.kind + 1000 * g.z + 2000 * g.m)
    width = 2 + g.z + g.m
    if g.kind == POINT:
        return head + struct.pack(f"<{width}d", *(g.data or (math.nan,) * width))
    out = [head, struct.pack("<I", len(g.data))]
    if g.kind == LINE:
        out += [struct.pack(f"<{width}d", *c) for c in g.data]
    elif g.kind == POLYGON:
        for ring in g.data:
            out.append(struct.pack("<I", len(ring)))
            out += [struct.pack(f"<{width}d", *c) for c in ring]
    else:
        out += [write_wkb(x) for x in g.data]
    return b"".join(out)


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[-+]?[nN][aA][nN]|[-+]?[iI][nN][fF]\w*"
_TOKEN = re.compile(rf"\s*(?:({_NUMBER})(?![A-Za-z])|([A-Za-z]+)|([(),]))")


class _Reader:
    def __init__(self, text: str):
        self.items: list[str] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise GeometryError(f"WKT can't be read at {text[at : at + 20]!r}")
            self.items.append(found[0].strip().upper())
            at = found.end()
        self.at = 0

    def next(self) -> str:
        if self.at >= len(self.items):
            raise GeometryError("WKT ends too early")
        self.at += 1
        return self.items[self.at - 1]

    def peek(self) -> str:
        return self.items[self.at] if self.at < len(self.items) else ""

    def expect(self, sign: str) -> None:
        if self.next() != sign:
            raise GeometryError(f"WKT lacks {sign!r}")

    def listed(self, item) -> tuple:
        if self.peek() == "EMPTY":
            self.next()
            return ()
        self.expect("(")
        out = [item()]
        while self.peek() == ",":
            self.next()
            out.append(item())
        self.expect(")")
        return tuple(out)

    def coordinate(self) -> tuple:
        out = []
        while self.peek() not in ("", ",", ")"):
            try:
                out.append(float(self.next()))
            except ValueError as e:
                raise GeometryError("WKT lacks a number") from e
        if not 2 <= len(out) <= 4:
            raise GeometryError("WKT has no coordinate of 2 to 4 numbers")
        return tuple(out)

    def geometry(self) -> Geometry:
        name = self.next()
        if name not in CODES:
            raise GeometryError(f"WKT has no geometry type {name}")
        kind, z, m = CODES[name], False, False
        if self.peek() in ("Z", "M", "ZM"):
            z, m = "Z" in self.peek(), "M" in self.peek()
            self.next()
        if kind == POINT:
            data = self.listed(self.coordinate)
            if len(data) > 1:
                raise GeometryError("WKT has a point of several coordinates")
            data = data[0] if data else None
            if data and all(map(math.isnan, data)):
                data = None
        elif kind == LINE:
            data = self.listed(self.coordinate)
        elif kind == POLYGON:
            data = self.listed(lambda: self.listed(self.coordinate))
        elif kind == MULTIPOINT:
            data = self.listed(lambda: Geometry(POINT, self._point(), z, m))
        elif kind == MULTILINE:
            data = self.listed(lambda: Geometry(LINE, self.listed(self.coordinate), z, m))
        elif kind == MULTIPOLYGON:
            data = self.listed(lambda: Geometry(POLYGON, self.listed(lambda: self.listed(self.coordinate)), z, m))
        else:
            data = self.listed(self.geometry)
        g = Geometry(kind, data, z, m)
        widths = {len(c) for c in g.coordinates()}
        if len(widths) > 1:
            raise GeometryError("WKT mixes dimensions")
        if widths and widths != {2 + z + m}:
            if z or m:
                raise GeometryError("WKT has coordinates of another dimension")
            g = g.moved(lambda c: c, z=True, m=widths == {4})
        return g

    def _point(self):
        if self.peek() in ("(", "EMPTY"):
            data = self.listed(self.coordinate)
            return data[0] if data else None
        return self.coordinate()


def read_wkt(text: str) -> Geometry:
    """A geometry of WKT."""
    reader = _Reader(text)
    g = reader.geometry()
    if reader.peek():
        raise GeometryError("WKT has more than a geometry")
    return g


def number(x: float) -> str:
    """The shortest decimal form that reads back as the same double."""
    if x == int(x) and abs(x) < 1e15 if math.isfinite(x) else False:
        return str(int(x)) if x or math.copysign(1, x) > 0 else "-0"
    return repr(float(x))


def write_wkt(g: Geometry) -> str:
    """WKT without needless white space."""

    def body(x: Geometry) -> str:
        if x.kind == POINT:
            return "EMPTY" if x.data is None else f"({_flat(x.data)})"
        if not x.data:
            return "EMPTY"
        if x.kind == LINE:
            return "(" + ",".join(map(_flat, x.data)) + ")"
        if x.kind == POLYGON:
            return "(" + ",".join("(" + ",".join(map(_flat, ring)) + ")" if ring else "EMPTY" for ring in x.data) + ")"
        return "(" + ",".join(write_wkt(y) if x.kind == COLLECTION else body(y) for y in x.data) + ")"

    mark = " Z" * (g.z and not g.m) + " M" * (g.m and not g.z) + " ZM" * (g.z and g.m)
    text = body(g)
    return NAMES[g.kind] + mark + (" " if mark or text == "EMPTY" else "") + text


def _flat(c: tuple) -> str:
    return " ".join(map(number, c))


def point(x: float, y: float) -> Geometry:
    return Geometry(POINT, (x, y))


def envelope(x1: float, y1: float, x2: float, y2: float) -> Geometry:
    """The rectangle as a polygon, counter to the clock from its lower left."""
    return Geometry(POLYGON, (((x1, y1), (x1, y2), (x2, y2), (x2, y1), (x1, y1)),))
