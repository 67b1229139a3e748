"""Spatial queries over shapes that are derived from the tables by integer arithmetic.

The oracles need no spatial functions: rectangles are compared by their bounds, areas
and lengths are closed forms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions import geometry as G
from geolith.functions.spatial import arrow, call, extent, extent_3d
from geolith.operators import joins, layout

XY = "(o_orderkey * 17) % 1000 AS x, (o_orderkey * 31) % 1000 AS y"
POINTS = f"SELECT o_orderkey AS id, {XY} FROM orders"
BOX = (100.0, 100.0, 199.0, 199.0)
HOLED = G.read_wkt("POLYGON((0 0,600 0,600 600,0 600,0 0),(200 200,400 200,400 400,200 400,200 200))")
TRIANGLE = G.read_wkt("POLYGON((0 0,900 0,0 900,0 0))")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, geom): a point for each order."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    o = o.select("id", ((F.col("id") * 17) % 1000).cast("double").alias("x"), ((F.col("id") * 31) % 1000).cast("double").alias("y"))
    return o.withColumn("geom", call("st_point", F.col("x"), F.col("y")))


def _shape(kind: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """By kind a point, a line or else a square of side 0.25 at (x, y)."""
    point, line, square = (arrow(name)[0] for name in ("st_point", "st_makeline", "st_makeenvelope"))
    right, top, n = pc.add(x, 0.25), pc.add(y, 0.25), len(x)
    places = point(x, y)
    ends = pa.concat_arrays([places, point(right, y)]).take(pa.array(np.arange(2 * n).reshape(2, n).T.ravel()))
    lines = line(pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2), pa.int32()), ends))
    which = pa.StructArray.from_arrays([pc.equal(kind, 0), pc.equal(kind, 1)], ["point", "line"])
    return pc.case_when(which, places, lines, square(x, y, right, top))


def _shape_at(p: DataFrame, once: bool = False) -> Column:
    """The shape of a row of `points`.

    One Python function: an array or a CASE between two of them would give each its own
    Python worker for each core.
    """
    made = F.arrow_udf(_shape, "binary")
    return (made.asNondeterministic() if once else made)(p["id"] % 3, p["x"], p["y"])


def shapes(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """(id, x, y, geom): by id % 3 a point, a line or a square of side 0.25 at the point's place.

    Made once, however many functions read it, or else anew for each in that one's own worker.
    """
    p = points(spark, sf_dir)
    return p.select("id", "x", "y", _shape_at(p, once).alias("geom"))


def laid_out(df: DataFrame) -> DataFrame:
    return layout.with_bounds(df, "geom")


def spatial_flagship_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven aggregates of a full scan, among them an exact intersection count."""
    p = points(spark, sf_dir)
    inside = F.col("x").between(100, 199) & F.col("y").between(100, 199)
    hit = call("st_intersects", F.col("geom"), F.lit(G.write_wkb(G.envelope(*BOX))))
    name = F.concat(F.lit("point-"), F.lpad(F.col("id").cast("string"), 6, "0"))
    return p.agg(
        F.count("*").alias("n"), F.sum("id").alias("id_sum"), F.count_if(F.col("id") % 32 == 7).alias("grp7"), F.count_if(inside).alias("in_box"), F.count_if(hit).alias("hits"),
        F.sum(F.length(name)).alias("name_chars"), F.sum(F.octet_length("geom")).cast("long").alias("wkb_bytes"),
    )


def spatial_selective_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.intersecting(laid_out(points(spark, sf_dir)), "geom", G.envelope(*BOX)).agg(F.count("*").alias("n"))


def spatial_unpruned_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.intersecting_exact(points(spark, sf_dir), "geom", G.envelope(*BOX)).agg(F.count("*").alias("n"))


def spatial_grouped_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = layout.intersecting(laid_out(points(spark, sf_dir)), "geom", G.envelope(0, 0, 500, 500))
    return hit.groupBy((F.col("id") % 8).alias("bucket")).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("id").alias("total"))


def spatial_wide_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = layout.intersecting(laid_out(points(spark, sf_dir)), "geom", G.envelope(*BOX))
    return hit.select("id", F.hex("geom").alias("wkb"), F.repeat(F.lit("x"), (F.col("id") % 5).cast("int")).alias("pad"), "x", "y").orderBy("id")


def viewport_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.intersecting(laid_out(shapes(spark, sf_dir, once=False)), "geom", G.envelope(250.125, 250.125, 500, 500)).select("id")


def holed_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.intersecting(laid_out(points(spark, sf_dir)), "geom", HOLED).select("id")


def triangle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.intersecting(laid_out(points(spark, sf_dir)), "geom", TRIANGLE).select("id")


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = (k % 5 * 200).cast("double"), (F.floor(k / 5) * 200).cast("double")
    z = _read(spark, sf_dir, "nation").select(k.alias("zone"), call("st_makeenvelope", x, y, x + 200, y + 200).alias("geom"))
    return layout.with_bounds(z, "geom").withColumnRenamed("geom", "zone_geom")


def spatial_join_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by the zones that hold them, boundaries in both."""
    return joins.spatial_join(laid_out(points(spark, sf_dir)), _zones(spark, sf_dir), "geom", "zone_geom", 200.0).groupBy("zone").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


def spatial_join_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four probes with a range of ids each and an envelope."""
    b = F.col("id")
    probes = spark.range(4).select(b.alias("bucket"), (b * 25).alias("min_id"), (b * 25 + 24).alias("max_id"), call("st_makeenvelope", b * 250.0, b * 250.0, b * 250 + 249.25, b * 250 + 249.25).alias("geom"))
    probes = layout.with_bounds(probes, "geom").withColumnRenamed("geom", "probe")
    near = F.col("id").between(F.col("min_id") * 100, F.col("max_id") * 100)
    return joins.spatial_join(laid_out(points(spark, sf_dir)), probes, "geom", "probe", 250.0, near).select("bucket", "id")


def _semi(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    p = laid_out(points(spark, sf_dir))
    zones = _zones(spark, sf_dir).where("zone % 2 = 0")
    hit = joins.spatial_join(p, zones, "geom", "zone_geom", 200.0).select("id").distinct()
    return points(spark, sf_dir).select("id").join(hit, "id", how)


def _round_trip(geoms: pa.Array) -> pa.Array:
    """The text of each geometry, and whether the geometry of that text has the same bytes."""
    text = arrow("st_astext")[0](geoms)
    back = arrow("st_geomfromtext")[0](text)
    same = pc.or_(pc.fill_null(pc.equal(back, geoms), False), pc.and_(back.is_null(), geoms.is_null()))
    return pa.StructArray.from_arrays([text, same], ["wkt", "same"])


def wkt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes as text and back, all in one Python worker for each task."""
    p = points(spark, sf_dir)
    trip = F.arrow_udf(_round_trip, "wkt string, same boolean").asNondeterministic()  # one call for both fields
    return p.select("id", trip(_shape_at(p)).alias("trip")).select("id", "trip.wkt", "trip.same")


def accessors_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", call("st_x", F.col("geom")).alias("px"), call("st_y", F.col("geom")).alias("py"), F.hex("geom").alias("wkb"))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("geom")
    return shapes(spark, sf_dir).select("id", *[call(n, g).alias(a) for n, a in (("st_xmin", "a"), ("st_ymin", "b"), ("st_box_xmax", "c"), ("st_box_ymax", "d"))])


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    g: Column = F.col("geom")
    origin = F.lit(G.write_wkb(G.point(-3, -4)))
    return shapes(spark, sf_dir).select(
        "id", call("st_area", g).alias("area"), call("st_length", g).alias("len"), call("st_perimeter", g).alias("per"), call("st_npoints", g).alias("np"),
        call("st_dimension", g).alias("dim"), call("geometrytype", g).alias("t"), call("st_geometrytype", g).alias("st"), call("st_isvalid", g).alias("ok"), call("st_isempty", g).alias("no"),
        (F.round(F.pow(call("st_distance", g, origin), 2), 3)).cast("long").alias("d2"), call("st_numgeometries", g).alias("parts"), call("st_srid", g).alias("srid"), call("st_zmflag", g).alias("zm"),
    )


def affine_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("geom")
    moved = call("st_scale", call("st_translate", g, F.lit(2.0), F.lit(-1.0)), F.lit(2.0), F.lit(0.5))
    return points(spark, sf_dir).select("id", call("st_x", moved).alias("mx"), call("st_y", moved).alias("my"), call("st_x", call("st_flipcoordinates", g)).alias("fx"))


def line_ring_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shapes(spark, sf_dir).where("id % 3 = 2")
    ring = call("st_exteriorring", F.col("geom"))
    return s.select(
        "id", call("st_numinteriorrings", F.col("geom")).alias("holes"), call("st_isclosed", ring).alias("closed"), call("st_isring", ring).alias("ring"),
        call("st_x", call("st_startpoint", ring)).alias("sx"), call("st_y", call("st_pointn", call("st_reverse", ring), F.lit(4))).alias("ry"), call("st_length", ring).alias("len"),
    )


def extent_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).groupBy((F.col("id") % 4).alias("bucket")).agg(extent(F.col("geom")).alias("box"), extent_3d(F.col("geom")).alias("box3"))


def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = _read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 40).cast("long").alias("lo"), (F.col("n_nationkey") * 40 + 60).cast("long").alias("hi"))
    return joins.range_join(_read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("v")), ranges, "v", "lo", "hi", 50).groupBy("n_nationkey").agg(F.count("*").alias("n"))


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type <> 'purchase'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("seen"))
    return joins.asof_join(left, right, ["user_id"], "ts", "seen_at", ["seen"], "seen").select("event_id", "seen")


_IN = "x BETWEEN {0} AND {2} AND y BETWEEN {1} AND {3}"
_BOX = _IN.format(*BOX)
_P = "(SELECT o_orderkey AS id, CAST((o_orderkey * 17) % 1000 AS DOUBLE) AS x, CAST((o_orderkey * 31) % 1000 AS DOUBLE) AS y FROM orders)"
_ZONES = "(SELECT n_nationkey AS zone, n_nationkey % 5 * 200 AS zx, n_nationkey // 5 * 200 AS zy FROM nation)"
_IN_ZONE = "x BETWEEN zx AND zx + 200 AND y BETWEEN zy AND zy + 200"
_N = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


def _n(x: str) -> str:
    return _N.format(x)


_W = f"CASE WHEN id % 3 = 0 THEN 'POINT(' || {_n('x')} || ' ' || {_n('y')} || ')' WHEN id % 3 = 1 THEN 'LINESTRING(' || {_n('x')} || ' ' || {_n('y')} || ',' || {_n('(x + 0.25)')} || ' ' || {_n('y')} || ')' ELSE 'POLYGON((' || {_n('x')} || ' ' || {_n('y')} || ',' || {_n('x')} || ' ' || {_n('(y + 0.25)')} || ',' || {_n('(x + 0.25)')} || ' ' || {_n('(y + 0.25)')} || ',' || {_n('(x + 0.25)')} || ' ' || {_n('y')} || ',' || {_n('x')} || ' ' || {_n('y')} || '))' END"
_MAXX, _MAXY = "x + CASE WHEN id % 3 = 0 THEN 0 ELSE 0.25 END", "y + CASE WHEN id % 3 = 2 THEN 0.25 ELSE 0 END"
_DX, _DY = "(x + 3)", "(y + 4)"
_EXT = f"SELECT id % 4 AS bucket, 'BOX(' || {_n('min(x)')} || ' ' || {_n('min(y)')} || ',' || {_n(f'max({_MAXX})')} || ' ' || {_n(f'max({_MAXY})')} || ')' AS box, 'BOX3D(' || {_n('min(x)')} || ' ' || {_n('min(y)')} || ' 0,' || {_n(f'max({_MAXX})')} || ' ' || {_n(f'max({_MAXY})')} || ' 0)' AS box3 FROM {_P} GROUP BY id % 4"


def _double_hex(v: str) -> str:
    """Little-endian bytes, in hexadecimal, of a whole double from 0 to 1023: exponent and mantissa by arithmetic."""
    e = f"CAST(floor(log2({v})) AS BIGINT)"
    top = f"printf('%03X', 1023 + {e})"
    body = f"printf('%013X', CAST(({v} / pow(2, {e}) - 1) * 4503599627370496 AS BIGINT))"
    text = f"({top} || {body})"
    bytes_ = " || ".join(f"substr({text}, {i}, 2)" for i in range(15, 0, -2))
    return f"CASE WHEN {v} = 0 THEN '0000000000000000' ELSE {bytes_} END"


_WKB = f"'0101000000' || {_double_hex('x')} || {_double_hex('y')}"

QUERIES = {
    "spatial_flagship_agg": spatial_flagship_agg, "spatial_selective_count": spatial_selective_count, "spatial_unpruned_count": spatial_unpruned_count, "spatial_grouped_agg": spatial_grouped_agg,
    "spatial_wide_projection": spatial_wide_projection, "viewport_overlap": viewport_overlap, "holed_polygon": holed_polygon, "triangle_filter": triangle_filter,
    "spatial_join_zones": spatial_join_zones, "spatial_join_bounded": spatial_join_bounded, "spatial_semi_join": lambda s, d: _semi(s, d, "left_semi"), "spatial_anti_join": lambda s, d: _semi(s, d, "left_anti"),
    "wkt_roundtrip": wkt_roundtrip, "accessors_xy": accessors_xy, "bounds": bounds, "measures": measures, "affine_ops": affine_ops, "line_ring_ops": line_ring_ops, "extent_grouped": extent_grouped,
    "range_join": range_join, "asof_join": asof_join,
}
ORACLES = {
    "spatial_flagship_agg": f"SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum, count(*) FILTER (id % 32 = 7) AS grp7, count(*) FILTER ({_BOX}) AS in_box, count(*) FILTER ({_BOX}) AS hits, CAST(sum(12) AS BIGINT) AS name_chars, CAST(21 * count(*) AS BIGINT) AS wkb_bytes FROM {_P}",
    "spatial_selective_count": f"SELECT count(*) AS n FROM {_P} WHERE {_BOX}", "spatial_unpruned_count": f"SELECT count(*) AS n FROM {_P} WHERE {_BOX}",
    "spatial_grouped_agg": f"SELECT id % 8 AS bucket, count(*) AS n, min(id) AS lo, max(id) AS hi, CAST(sum(id) AS BIGINT) AS total FROM {_P} WHERE {_IN.format(0, 0, 500, 500)} GROUP BY id % 8",
    "spatial_wide_projection": f"SELECT id, {_WKB} AS wkb, repeat('x', id % 5) AS pad, x, y FROM {_P} WHERE {_BOX} ORDER BY id",
    "viewport_overlap": f"SELECT id FROM {_P} WHERE {_MAXX} >= 250.125 AND x <= 500 AND {_MAXY} >= 250.125 AND y <= 500",
    "holed_polygon": f"SELECT id FROM {_P} WHERE x <= 600 AND y <= 600 AND NOT (x > 200 AND x < 400 AND y > 200 AND y < 400)",
    "triangle_filter": f"SELECT id FROM {_P} WHERE x + y <= 900",
    "spatial_join_zones": f"SELECT zone, count(*) AS n, CAST(sum(id) AS BIGINT) AS total FROM {_P} JOIN {_ZONES} ON {_IN_ZONE} GROUP BY zone",
    "spatial_join_bounded": f"SELECT b.range AS bucket, id FROM {_P} JOIN range(4) b ON id BETWEEN b.range * 2500 AND b.range * 2500 + 2400 AND x BETWEEN b.range * 250 AND b.range * 250 + 249.25 AND y BETWEEN b.range * 250 AND b.range * 250 + 249.25",
    "spatial_semi_join": f"SELECT id FROM {_P} WHERE EXISTS (SELECT 1 FROM {_ZONES} WHERE zone % 2 = 0 AND {_IN_ZONE})",
    "spatial_anti_join": f"SELECT id FROM {_P} WHERE NOT EXISTS (SELECT 1 FROM {_ZONES} WHERE zone % 2 = 0 AND {_IN_ZONE})",
    "wkt_roundtrip": f"SELECT id, {_W} AS wkt, true AS same FROM {_P}", "accessors_xy": f"SELECT id, x AS px, y AS py, {_WKB} AS wkb FROM {_P}",
    "bounds": f"SELECT id, x AS a, y AS b, CAST({_MAXX} AS DOUBLE) AS c, CAST({_MAXY} AS DOUBLE) AS d FROM {_P}",
    "measures": f"SELECT id, CASE WHEN id % 3 = 2 THEN 0.0625::DOUBLE ELSE 0::DOUBLE END AS area, CASE WHEN id % 3 = 1 THEN 0.25::DOUBLE ELSE 0::DOUBLE END AS len, CASE WHEN id % 3 = 2 THEN 1::DOUBLE ELSE 0::DOUBLE END AS per, CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END AS np, CAST(id % 3 AS INT) AS dim, CASE id % 3 WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINESTRING' ELSE 'POLYGON' END AS t, CASE id % 3 WHEN 0 THEN 'ST_Point' WHEN 1 THEN 'ST_LineString' ELSE 'ST_Polygon' END AS st, true AS ok, false AS no, CAST(round({_DX} * {_DX} + {_DY} * {_DY}, 3) AS BIGINT) AS d2, 1 AS parts, 0 AS srid, 0 AS zm FROM {_P}",
    "affine_ops": f"SELECT id, (x + 2) * 2 AS mx, (y - 1) * 0.5::DOUBLE AS my, y AS fx FROM {_P}",
    "line_ring_ops": f"SELECT id, 0 AS holes, true AS closed, true AS ring, x AS sx, y + 0.25::DOUBLE AS ry, 1::DOUBLE AS len FROM {_P} WHERE id % 3 = 2",
    "extent_grouped": _EXT,
    "range_join": "SELECT n_nationkey, count(*) AS n FROM orders JOIN nation ON o_orderkey % 1000 BETWEEN n_nationkey * 40 AND n_nationkey * 40 + 60 GROUP BY n_nationkey",
    "asof_join": "SELECT event_id, seen FROM (SELECT l.event_id, r.event_id AS seen, row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC NULLS LAST, r.event_id DESC NULLS LAST) AS rn FROM (SELECT * FROM events WHERE event_type = 'purchase') l LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') r ON l.user_id = r.user_id AND r.ts <= l.ts) WHERE rn = 1",
}
