import random

import pytest
from pyspark.sql import functions as F

from geolith.functions import geometry as G
from geolith.functions import kernel as K
from geolith.functions import spatial
from geolith.operators import layout

SQUARE = "POLYGON((0 0,4 0,4 4,0 4,0 0))"
HOLED = "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 1))"
CORPUS = [
    ("postgis_lib_version()", "3.4.0"), ("st_astext(st_geomfromtext('POINT(1 2)'))", "POINT(1 2)"), ("st_astext(st_geomfromewkt('SRID=4326;POINT(1 2)'))", "POINT(1 2)"),
    ("st_astext(st_point(3.0, 4.0))", "POINT(3 4)"), ("st_astext(st_makepoint(5.0, 6.0))", "POINT(5 6)"), ("st_ashexewkb(st_geomfromtext('POINT(1 2)'))", "0101000000000000000000F03F0000000000000040"),
    ("st_astext(st_force2d(st_geomfromtext('POINT(1 2)')))", "POINT(1 2)"), ("st_astext(st_force2d(st_geomfromtext('POINT Z (1 2 3)')))", "POINT(1 2)"),
    ("st_astext(st_curvetoline(st_geomfromtext('POINT(1 2)')))", "POINT(1 2)"), ("st_hasarc(st_geomfromtext('POINT(1 2)'))", "false"), ("st_hasarc(NULL)", "false"),
    ("st_zmflag(st_geomfromtext('POINT(1 2)'))", "0"), (f"st_dimension(st_geomfromtext('{SQUARE}'))", "2"), (f"st_numinteriorrings(st_geomfromtext('{HOLED}'))", "1"),
    (f"st_astext(st_exteriorring(st_geomfromtext('{HOLED}')))", "LINESTRING(0 0,4 0,4 4,0 4,0 0)"), (f"st_astext(st_interiorringn(st_geomfromtext('{HOLED}'), 1))", "LINESTRING(1 1,2 1,2 2,1 1)"),
    ("st_isempty(st_geomfromtext('POINT(1 2)'))", "false"), ("st_isempty(st_geomfromtext('POINT EMPTY'))", "true"), ("st_isvalid(st_geomfromtext('POINT(1 2)'))", "true"),
    ("st_isvalid(st_geomfromtext('POLYGON((0 0,2 2,0 2,2 0,0 0))'))", "false"), ("geometrytype(st_geomfromtext('POINT(1 2)'))", "POINT"), ("st_geometrytype(st_geomfromtext('POINT(1 2)'))", "ST_Point"),
    ("st_geometrytype(st_geomfromtext('MULTIPOINT((0 0),(1 1))'))", "ST_MultiPoint"), (f"st_intersects(st_geomfromtext('POINT(1 1)'), st_geomfromtext('{SQUARE}'))", "true"),
    ("st_intersects(st_geomfromtext('POINT(0 0)'), st_geomfromtext('POINT(2 2)'))", "false"), (f"st_area(st_geomfromtext('{SQUARE}'))", "16.0"),
    ("st_distance(st_geomfromtext('POINT(0 0)'), st_geomfromtext('POINT(3 4)'))", "5.0"), ("st_length(st_geomfromtext('LINESTRING(0 0,3 4)'))", "5.0"), (f"st_perimeter(st_geomfromtext('{SQUARE}'))", "16.0"),
    ("st_npoints(st_geomfromtext('LINESTRING(0 0,3 4,6 8)'))", "3"), ("st_numpoints(st_geomfromtext('LINESTRING(0 0,3 4,6 8)'))", "3"), ("st_astext(st_startpoint(st_geomfromtext('LINESTRING(0 0,3 4,6 8)')))", "POINT(0 0)"),
    ("st_astext(st_endpoint(st_geomfromtext('LINESTRING(0 0,3 4,6 8)')))", "POINT(6 8)"), ("st_astext(st_pointn(st_geomfromtext('LINESTRING(0 0,3 4,6 8)'), 2))", "POINT(3 4)"),
    ("st_isclosed(st_geomfromtext('LINESTRING(0 0,3 0,0 0)'))", "true"), ("st_isring(st_geomfromtext('LINESTRING(0 0,4 0,4 4,0 4,0 0)'))", "true"), ("st_astext(st_reverse(st_geomfromtext('LINESTRING(0 0,3 4,6 8)')))", "LINESTRING(6 8,3 4,0 0)"),
    ("st_astext(st_flipcoordinates(st_geomfromtext('POINT(3 4)')))", "POINT(4 3)"), ("st_astext(st_translate(st_geomfromtext('POINT(3 4)'), 2.0, -1.0))", "POINT(5 3)"), ("st_astext(st_scale(st_geomfromtext('POINT(3 4)'), 2.0, 0.5))", "POINT(6 2)"),
    ("st_numgeometries(st_geomfromtext('POINT(3 4)'))", "1"), ("st_numgeometries(st_geomfromtext('MULTIPOINT((0 0),(1 1))'))", "2"), ("st_x(st_geomfromtext('POINT(3 4)'))", "3.0"), ("st_y(st_geomfromtext('POINT(3 4)'))", "4.0"),
    ("st_xmin(st_geomfromtext('LINESTRING(2 3,5 7)'))", "2.0"), ("st_ymin(st_geomfromtext('LINESTRING(2 3,5 7)'))", "3.0"), ("st_srid(st_geomfromtext('POINT EMPTY'))", "0"), ("hex(st_asbinary(st_point(1, 2), 'NDR'))", "0101000000000000000000F03F0000000000000040"),
    ("st_astext(st_geomfromtext(NULL))", None), ("st_intersects(NULL, st_point(1, 1))", None),
]


def test_corpus(spark):
    spatial.register(spark)
    row = spark.sql("SELECT " + ", ".join(f"CAST({sql} AS STRING) AS c{i}" for i, (sql, _) in enumerate(CORPUS))).first()
    assert [row[i] for i in range(len(CORPUS))] == [want for _, want in CORPUS]


def test_extents(spark):
    df = spark.createDataFrame([(bytearray(G.write_wkb(G.point(0, 0))),), (bytearray(G.write_wkb(G.point(2, 3))),), (None,)], "geom binary")
    assert df.agg(spatial.extent(df.geom)).first()[0] == "BOX(0 0,2 3)"
    assert df.agg(spatial.extent_3d(df.geom)).first()[0] == "BOX3D(0 0 0,2 3 0)"
    assert df.where("geom IS NULL").agg(spatial.extent(df.geom)).first()[0] is None


@pytest.mark.parametrize("raw", [b"", b"\x02", b"\x01\x01\x00\x00\x00" + b"\0" * 15, b"\x01\x63\x00\x00\x00", G.write_wkb(G.point(1, 2)) + b"x", b"\x01\x02\x00\x00\x00\xff\xff\xff\xff"])
def test_malformed(raw):
    with pytest.raises(G.GeometryError):
        G.read_wkb(raw)


@pytest.mark.parametrize("text", ["POINT EMPTY", "LINESTRING(0 0,1.5 -2)", "POLYGON((0 0,1 0,0 1,0 0))", "MULTIPOINT((0 0),(1 1))", "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "MULTIPOLYGON(((0 0,1 0,0 1,0 0)))", "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))", "POINT ZM (1 2 3 4)", "LINESTRING EMPTY", "POINT M (1 2 3)"])
def test_round_trips(text):
    g = G.read_wkt(text)
    assert G.write_wkt(g) == text and G.read_wkb(G.write_wkb(g)) == g


EDGE = [(1, "POINT(0 0)"), (2, "POINT(2 2)"), (3, "POINT(5 5)"), (4, "POINT(6 6)"), (5, "POINT(10 10)"), (6, None), (7, "POINT EMPTY"), (8, "POLYGON((0 0,2 2,0 2,2 0,0 0))")]
PROBES = ["POLYGON((0 0,6 0,6 6,0 6,0 0),(1 1,3 1,3 3,1 3,1 1))", "POLYGON((0 0,2 2,0 2,2 0,0 0))", "POINT EMPTY", "LINESTRING(0 0,10 10)", "POLYGON((1 1,2 1,2 2,1 2,1 1))", "POLYGON EMPTY"]


def test_candidates_never_change_a_result(spark):
    rows = [(i, bytearray(G.write_wkb(G.read_wkt(t))) if t else None) for i, t in EDGE]
    df = layout.with_bounds(spark.createDataFrame(rows, "id int, geom binary"), "geom").cache()
    for text in PROBES:
        probe = G.read_wkt(text)
        fast = sorted(r.id for r in layout.intersecting(df, "geom", probe).collect())
        assert fast == sorted(r.id for r in layout.intersecting_exact(df, "geom", probe).collect())
        assert fast == [i for i, t in EDGE if t and K.intersects(G.read_wkt(t), probe)]
    assert [r.id for r in layout.intersecting(df, "geom", G.read_wkt(PROBES[0])).where("id <= 5").orderBy("id").collect()] == [1, 3, 4]


def test_bounds_reach_the_scan(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "CAST(id AS DOUBLE) AS v").select("id", spatial.call("st_point", F.col("v"), F.col("v")).alias("geom"))
    layout.clustered(layout.with_bounds(df, "geom"), 4).write.parquet(str(tmp_path / "t"))
    hit = layout.intersecting(spark.read.parquet(str(tmp_path / "t")), "geom", G.envelope(10, 10, 20, 20))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = hit._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(_gl_" in plan and "GreaterThanOrEqual(_gl_maxx,10.0)" in plan and "ArrowEvalPython" in plan
    assert hit.count() == 11


def _shape(rng):
    kind = rng.randrange(4)
    c = lambda: (rng.randrange(8), rng.randrange(8))
    if kind == 0:
        return "POINT({} {})".format(*c())
    if kind == 1:
        a, b = c(), c()
        return "LINESTRING({} {},{} {})".format(*a, *(b if a != b else (b[0] + 1, b[1])))
    x, y = c()
    w, h = rng.randrange(1, 5), rng.randrange(1, 5)
    shell = f"({x} {y},{x + w} {y},{x + w} {y + h},{x} {y + h},{x} {y})"
    hole = f",({x + 0.25} {y + 0.25},{x + 0.25} {y + 0.75},{x + 0.75} {y + 0.75},{x + 0.75} {y + 0.25},{x + 0.25} {y + 0.25})"
    return f"POLYGON({shell}{hole if kind == 3 else ''})"


def test_against_another_kernel(spark):
    """The same answers as the geometry library that comes with Spark's own jars."""
    try:
        reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    except TypeError:
        pytest.skip("no such library here")
    rng = random.Random(4)
    for _ in range(300):
        a, b = _shape(rng), _shape(rng)
        g, h, p, q = G.read_wkt(a), G.read_wkt(b), reader.read(a), reader.read(b)
        assert K.intersects(g, h) == p.intersects(q), (a, b)
        assert K.distance(g, h) == pytest.approx(p.distance(q), abs=1e-9), (a, b)
        assert (K.valid(g), K.area(g)) == (p.isValid(), pytest.approx(p.getArea()))
