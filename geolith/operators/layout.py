"""Tables with maintained bounding boxes, and filters that use them.

A laid-out table has one geometry column (WKB, told by its name) and four nullable
double columns with its bounds. A selective filter first compares the bounds, which
reach the Parquet scan and skip row groups, and always tests the exact geometry
behind them: the bounds only propose candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.errors import EngineError
from geolith.functions import geometry as G
from geolith.functions.spatial import BOUNDS, call

PREFIX = "_gl_"
COLUMNS = tuple(PREFIX + b for b in BOUNDS)
GEOMETRY_NAMES = frozenset("geom geometry the_geom wkb_geometry wkb_geom geom_wkb shape footprint way".split())
GEOGRAPHY_NAMES = frozenset("geog geography the_geog".split())


def spatial_kind(name: str, kind: T.DataType) -> str | None:
    """`geometry`, `geography` or None, by a binary column's name."""
    if not isinstance(kind, T.BinaryType):
        return None
    return "geometry" if name.lower() in GEOMETRY_NAMES else "geography" if name.lower() in GEOGRAPHY_NAMES else None


def inspect(schema: T.StructType) -> str | None:
    """The geometry column that a schema's bounds follow, None without bounds.

    Some but not all of the four columns, other types, or another number of geometry
    columns than one are refused.
    """
    there = [f for f in schema if f.name.lower() in COLUMNS]
    if not there:
        return None
    if len(there) != 4 or any(not isinstance(f.dataType, T.DoubleType) or not f.nullable for f in there):
        raise EngineError("0A000", "a bounded layout needs all four bounds as nullable doubles")
    geoms = [f.name for f in schema if spatial_kind(f.name, f.dataType) == "geometry"]
    if len(geoms) != 1:
        raise EngineError("0A000", "a bounded layout needs exactly one geometry column")
    return geoms[0]


def with_bounds(df: DataFrame, geom: str) -> DataFrame:
    """The table with the bounds of its geometry column; null and empty ones have nulls.

    They are evaluated once: filters on them, those a join infers among them, stay above.
    Pushed below, each would be a further Python worker for each core, and the same work again.
    """
    mine = [c for c in df.columns if c.lower() not in COLUMNS]
    held = "_bounds"
    while held.lower() in (c.lower() for c in mine):
        held += "_"
    found = df.select(*[F.col(f"`{c}`") for c in mine], call("st_bounds", F.col(f"`{geom}`"), once=True).alias(held))
    return found.select(*[F.col(f"`{c}`") for c in mine], *[F.col(held)[k].alias(PREFIX + k) for k in BOUNDS])


def candidates(bounds: tuple[float, float, float, float] | None) -> Column:
    """Whether a row's bounds meet a probe's; nothing meets an empty probe."""
    if bounds is None:
        return F.lit(None).cast("boolean")
    x1, y1, x2, y2 = bounds
    return (F.col(COLUMNS[2]) >= x1) & (F.col(COLUMNS[0]) <= x2) & (F.col(COLUMNS[3]) >= y1) & (F.col(COLUMNS[1]) <= y2)


def intersecting(df: DataFrame, geom: str, probe: bytes | G.Geometry | None) -> DataFrame:
    """Rows whose geometry meets the probe: candidates by bounds, then the exact test.

    The probe's bounds are worked out here, as Catalyst doesn't fold Python functions.
    """
    if probe is None:
        return df.where(F.lit(False))
    g = probe if isinstance(probe, G.Geometry) else G.read_wkb(probe)
    return df.where(candidates(g.bounds())).where(call("st_intersects", F.col(geom), F.lit(G.write_wkb(g))))


def intersecting_exact(df: DataFrame, geom: str, probe: bytes | G.Geometry) -> DataFrame:
    """The same rows without the help of bounds."""
    g = probe if isinstance(probe, G.Geometry) else G.read_wkb(probe)
    return df.where(F.coalesce(call("st_intersects", F.col(geom), F.lit(G.write_wkb(g))), F.lit(False)))


def clustered(df: DataFrame, files: int) -> DataFrame:
    """Rows ranged along a Z-order curve of their bounds' centres, so that row groups hold neighbours.

    The extent that scales the curve is an aggregate over the table.
    """
    x, y = (F.col(COLUMNS[0]) + F.col(COLUMNS[2])) / 2, (F.col(COLUMNS[1]) + F.col(COLUMNS[3])) / 2
    e = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()

    def grid(v: Column, low: float | None, high: float | None) -> Column:
        span = (high - low) if low is not None and high > low else 1.0
        return F.coalesce(((v - F.lit(low or 0.0)) / span * 65535).cast("long"), F.lit(0))

    def spread(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    code = spread(grid(x, e.x0, e.x1)).bitwiseOR(F.shiftleft(spread(grid(y, e.y0, e.y1)), 1))
    z = "_z"
    while z in (c.lower() for c in df.columns):
        z += "_"
    return df.withColumn(z, code).repartitionByRange(files, z).sortWithinPartitions(z).drop(z)
