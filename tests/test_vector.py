"""Functions over arrays of coordinates against the reader and kernel, geometry by geometry."""

import random

import pyarrow as pa
import pytest

from geolith.functions import geometry as G
from geolith.functions import kernel as K
from geolith.functions import spatial as S


def shapes(seed, n=400):
    rng = random.Random(seed)

    def c(width=2):
        return tuple(float(rng.randint(0, 6)) for _ in range(width))

    def line(width=2, least=1):
        return tuple(c(width) for _ in range(rng.randint(least, 6)))

    def ring(width=2):
        x = line(width, 3)
        return (*x, x[0])

    def box():
        x, y = c()
        return G.envelope(x, y, x + rng.randint(0, 3), y + rng.randint(1, 3)).data[0]

    def one(kind, width=2):
        if kind == G.POINT:
            return c(width) if rng.random() < 0.9 else None
        if kind == G.LINE:
            return line(width, 0) if rng.random() < 0.7 or width > 2 else box()
        rings = tuple(ring(width) for _ in range(rng.randint(0, 3)))
        return (box(),) if rng.random() < 0.4 and width == 2 else rings

    out = []
    for _ in range(n):
        kind, z, m = rng.randint(1, 7), rng.random() < 0.1, rng.random() < 0.1
        width = 2 + z + m
        if kind < 4:
            g = G.Geometry(kind, one(kind, width), z, m)
        elif kind < 7:
            g = G.Geometry(kind, tuple(G.Geometry(kind - 3, one(kind - 3, width), z, m) for _ in range(rng.randint(0, 3))), z, m)
        else:
            g = G.Geometry(kind, tuple(G.Geometry(k, one(k)) for k in (1, 2, 3)))
        raw = G.write_wkb(g)
        if rng.random() < 0.05:
            raw = b"\x00\x00\x00\x00\x01" + bytes(16)  # the other byte order
        out.append(raw if rng.random() < 0.95 else None)
    return out


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-9 * max(1, abs(a)) or (a != a and b != b)
    return a == b


MORE = {"st_interiorringn": [1, 2], "st_pointn": [1, 3, -1, 0], "st_translate": [(1.5, -2.0)], "st_scale": [(2.0, 0.5)]}


@pytest.mark.parametrize("name", sorted(S._FAST))
def test_against_the_rows(name):
    function, kinds, kind = S._ROW[name]
    column = shapes(name)
    if name == "st_isring":
        column = [g for g in column if g is None or G.read_wkb(g).kind == G.LINE]
    for more in MORE.get(name, [()]):
        more = more if isinstance(more, tuple) else (more,)
        rows = S._rows(function, kinds, kind)
        for part in (column, column[3:4], [], [None, None]):
            arrays = [pa.array([None, *part], pa.binary())[1:]] + [pa.array([v] * len(part)) for v in more]
            got, want = S._mixed(S._FAST[name], rows)(*arrays), rows(*arrays)
            assert got.type == want.type
            for raw, x, y in zip(part, got.to_pylist(), want.to_pylist()):
                assert same(x, y), (name, raw and G.write_wkt(G.read_wkb(raw)), x, y)


@pytest.mark.parametrize("seed", range(4))
def test_pairs_against_the_kernel(seed):
    a, b = shapes(seed), shapes(seed + 100)
    if seed % 2:  # few distinct probes against many
        b = [b[i % 7] for i in range(len(b))]
    x, y = pa.array(a, pa.binary()), pa.array(b, pa.binary())
    read = [None if None in p else tuple(map(G.read_wkb, p)) for p in zip(a, b)]
    assert S._intersects(x, y).to_pylist() == [p and K.intersects(*p) for p in read]
    for got, p in zip(S._distance(x, y).to_pylist(), read):
        assert same(got, p and K.distance(*p))
    apart = [p and not K._apart(p[0].bounds(), p[1].bounds()) for p in read]
    assert S._ext(x, y).to_pylist() == apart
    bounds = [tuple(v.values()) for v in S._bounds(x).to_pylist()]
    assert bounds == [(g and G.read_wkb(g).bounds()) or (None,) * 4 for g in a]


def test_made_geometries():
    n = pa.array([1.0, None, 3.0])
    got = S._envelopes(n, n, pa.array([5.0, 5.0, 5.0]), pa.array([6.0, 6.0, 6.0])).to_pylist()
    assert got == [G.write_wkb(G.envelope(1, 1, 5, 6)), None, G.write_wkb(G.envelope(3, 3, 5, 6))]
    p = [G.write_wkb(G.point(i, -i)) for i in range(4)]
    lists = pa.array([p[:2], None, [], [p[3], None, p[1]], [p[0]]], pa.list_(pa.binary()))
    assert S._lines(lists).to_pylist() == S._rows(S._make_line, "a", "binary")(lists).to_pylist()


def test_malformed_bytes_raise():
    good = G.write_wkb(G.envelope(0, 0, 1, 1))
    for bad in (b"", good[:-1], good + b"x", b"\x01\x09\x00\x00\x00", b"\x01\x02\x00\x00\x00\xff\xff\xff\xff", b"\x02" + good[1:]):
        for name in ("st_npoints", "st_area", "st_reverse"):
            function, kinds, kind = S._ROW[name]
            with pytest.raises(G.GeometryError):
                S._mixed(S._FAST[name], S._rows(function, kinds, kind))(pa.array([good, bad], pa.binary()))
        with pytest.raises(G.GeometryError):
            S._checked(pa.array([good, bad], pa.binary()))
