"""Spatial, range and as-of joins as compositions of equi-joins.

None of them ends in a nested loop: each side gets an equi key (a grid cell, a bin of
a range, a partition of time), a residual condition narrows the pairs, and the exact
test comes last. Which side is broadcast, if any, is left to the optimiser and its
size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.functions.spatial import BOUNDS, call
from geolith.operators.layout import COLUMNS, PREFIX


def _cells(lo: Column, hi: Column, size: Column) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


CELLS_A_ROW = 64


def spatial_join(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, cell: float, residual: Column | None = None) -> DataFrame:
    """Pairs of rows whose geometries meet; both sides have bounds.

    Rows are dealt to the grid cells their bounds touch; a pair that shares several
    cells is counted in the one that holds the lower left of their common bounds. A row
    that would touch too many cells has a level on which cells are larger, and a pair
    meets on the coarser of its two levels, so that no row is dealt to more than about
    CELLS_A_ROW cells of a level, however large it is. Rows without bounds meet nothing.
    The right side's columns must not clash with the left's, but for the bounds.
    """
    p = _fresh(left, right, prefix="_sj")
    other = {c: f"{p}{c}" for c in COLUMNS}
    right = right.withColumnsRenamed(other)
    la = {k: F.col(PREFIX + k) for k in BOUNDS}
    ra = {k: F.col(other[PREFIX + k]) for k in BOUNDS}
    size = lambda level: F.lit(cell) * F.pow(F.lit(2.0), level)

    def ranked(df: DataFrame, at: dict[str, Column], own: str) -> DataFrame:
        side = F.greatest(at["maxx"] - at["minx"], at["maxy"] - at["miny"])
        level = F.ceil(F.log2(F.greatest(side, F.lit(cell)) / (cell * (CELLS_A_ROW**0.5 - 1))))
        return df.where(at["minx"].isNotNull()).withColumn(own, F.greatest(F.lit(0), level.cast("int")))

    a, b = ranked(left, la, f"{p}_n"), ranked(right, ra, f"{p}_m")
    levels = sorted({r[0] for side, own in ((a, f"{p}_n"), (b, f"{p}_m")) for r in side.select(own).distinct().collect()})

    def dealt(df: DataFrame, at: dict[str, Column], own: str, level: str, x: str, y: str) -> DataFrame:
        """Rows in the cells of their own level and of those coarser ones that there are."""
        df = df.withColumn(level, F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col(own)))) if levels else df.withColumn(level, F.lit(0))
        return df.withColumn(x, F.explode(_cells(at["minx"], at["maxx"], size(F.col(level))))).withColumn(y, F.explode(_cells(at["miny"], at["maxy"], size(F.col(level)))))

    a, b = dealt(a, la, f"{p}_n", f"{p}_a", f"{p}_cx", f"{p}_cy"), dealt(b, ra, f"{p}_m", f"{p}_b", f"{p}_dx", f"{p}_dy")
    meets = (la["maxx"] >= ra["minx"]) & (la["minx"] <= ra["maxx"]) & (la["maxy"] >= ra["miny"]) & (la["miny"] <= ra["maxy"])
    width = size(F.col(f"{p}_a"))
    owner = (F.col(f"{p}_cx") == F.floor(F.greatest(la["minx"], ra["minx"]) / width)) & (F.col(f"{p}_cy") == F.floor(F.greatest(la["miny"], ra["miny"]) / width))
    on = (F.col(f"{p}_a") == F.col(f"{p}_b")) & (F.col(f"{p}_cx") == F.col(f"{p}_dx")) & (F.col(f"{p}_cy") == F.col(f"{p}_dy")) & (F.col(f"{p}_a") == F.greatest(f"{p}_n", f"{p}_m")) & meets & owner
    pairs = a.join(b, on & residual if residual is not None else on)
    mine = [c for c in pairs.columns if c.startswith(p)]
    return pairs.where(call("st_intersects", F.col(left_geom), F.col(right_geom))).drop(*mine)


def _fresh(*frames: DataFrame, prefix: str) -> str:
    """A prefix that no column's name begins with."""
    taken = [c.lower() for df in frames for c in df.columns]
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs with low <= value <= high, by bins of the values: integers, dates or timestamps (bins in seconds).

    Nulls and empty ranges match nothing.
    """
    p = _fresh(points, ranges, prefix="_bin")

    def number(df: DataFrame, name: str) -> Column:
        kind = df.schema[name].dataType
        c = F.col(name)
        if isinstance(kind, T.DateType):
            return F.unix_date(c).cast("long") * 86400
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000)
        return c

    bins = F.sequence(F.floor(number(ranges, low) / width), F.floor(number(ranges, high) / width))
    binned = ranges.where(F.col(low) <= F.col(high)).withColumn(f"{p}_of", F.explode(bins))
    dealt = points.withColumn(f"{p}_at", F.floor(number(points, value) / width))
    return dealt.join(binned, (F.col(f"{p}_at") == F.col(f"{p}_of")) & F.col(value).between(F.col(low), F.col(high))).drop(f"{p}_at", f"{p}_of")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str], tie: str) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before it.

    One shuffle: both sides are stacked and a window carries the last values forward.
    Of right rows at the same time the greatest `tie` is last. A null key or time
    matches nothing, as in SQL: such left rows have null values.
    """
    p = _fresh(left, right, prefix="_asof")
    k = [f"{p}_k{i}" for i in range(len(keys))]

    def side(df: DataFrame, when: str, row: Column, carried: Column, n: int, order: Column) -> DataFrame:
        return df.select(*[F.col(f"`{key}`").alias(name) for key, name in zip(keys, k, strict=True)], row.alias(f"{p}_l"), F.col(f"`{when}`").alias(f"{p}_t"), carried.alias(f"{p}_r"), F.lit(n).alias(f"{p}_side"), order.alias(f"{p}_tie"))

    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    carried = F.struct(F.col(f"`{right_at}`").alias("at"), *[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)])
    known = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, right_at]))
    rows = side(left, at, row, F.lit(None), 1, F.lit(None).cast(right.schema[tie].dataType))
    more = side(known, right_at, F.lit(None), carried, 0, F.col(f"`{tie}`"))
    window = Window.partitionBy(*k).orderBy(f"{p}_t", f"{p}_side", f"{p}_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(more).withColumn(f"{p}_r", F.last(f"{p}_r", ignorenulls=True).over(window)).where(f"{p}_side = 1")
    return found.select(*[F.col(f"{p}_l.`{c}`").alias(c) for c in left.columns], F.col(f"{p}_r.at").alias(right_at), *[F.col(f"{p}_r.v{i}").alias(v) for i, v in enumerate(values)])
