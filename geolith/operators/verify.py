"""Checksums of tables as multisets, and summaries of their geometries.

A row's SHA-256 counts as a number modulo 2^256; a table's checksum is the rows'
count, sum and exclusive or, so that neither order nor partitioning matters and a
repeated row does. Sums are taken over 32-bit limbs by built-in aggregates, which
combine before the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.functions.spatial import call


@F.arrow_udf(T.LongType())
def _float_bits(values: pa.Array) -> pa.Array:
    """The bits of doubles; all NaNs are alike, and 0 and -0 are not."""
    x = np.asarray(values.fill_null(0.0)).copy()
    x[np.isnan(x)] = np.nan
    return pa.array(x.view(np.int64), mask=~np.asarray(values.is_valid()))


def canonical(c: Column, kind: T.DataType) -> Column:
    """A value as text that is the same wherever it is stored."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("1")).when(~c, F.lit("0"))
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.lower(F.hex(_float_bits(c.cast("double"))))
    if isinstance(kind, T.DecimalType):
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return c.cast("string")


def _digest(values: list[Column], domain: str) -> Column:
    """SHA-256 of values, each with its length before it and nulls apart."""
    parts = [F.when(v.isNull(), F.lit("n;")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v, F.lit(";"))) for v in values]
    return F.sha2(F.concat(F.lit(domain), *parts), 256)


def checksum(df: DataFrame) -> DataFrame:
    """(name, n, nulls, digest): a row for each column and one, named '', for whole rows."""
    texts = {f.name: canonical(F.col(f"`{f.name}`"), f.dataType) for f in df.schema}
    hashes = [("", _digest(list(texts.values()), "row:"))] + [(n, _digest([t], "column:")) for n, t in texts.items()]
    every = F.array(*[F.struct(F.lit(n).alias("name"), h.alias("h"), (texts[n].isNull() if n else F.lit(False)).alias("null")) for n, h in hashes])
    limbs = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long") for k in range(8)]
    rows = df.select(F.explode(every).alias("x")).select("x.*").groupBy("name").agg(
        F.count("*").alias("n"), F.count_if("null").alias("nulls"), *[F.sum(x.cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k, x in enumerate(limbs)], *[F.bit_xor(x).alias(f"x{k}") for k, x in enumerate(limbs)]
    )

    found = []
    for r in rows.collect():  # one row a column
        total = sum(int(r[f"s{k}"]) << 32 * (7 - k) for k in range(8)) % (1 << 256)
        folded = b"".join(r[f"x{k}"].to_bytes(4, "big") for k in range(8))
        found.append((r.name, r.n, r.nulls, hashlib.sha256(b"multiset:%d:%d:" % (r.n, r.nulls) + total.to_bytes(32, "big") + folded).hexdigest()))
    return df.sparkSession.createDataFrame(sorted(found), "name string, n long, nulls long, digest string")


def spatial_summary(df: DataFrame, geom: str) -> DataFrame:
    """(there, valid, invalid, empty, minx, miny, maxx, maxy) of a geometry column."""
    g = F.col(geom)
    b = call("st_bounds", g)
    rows = df.select(g.isNotNull().alias("there"), call("st_isvalid", g).alias("ok"), call("st_isempty", g).alias("none"), b.alias("b"))
    return rows.agg(F.count_if("there").alias("there"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"), F.count_if("none").alias("empty"), F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"))


def classify(schema: T.StructType) -> list[tuple[str, str, str]]:
    """(column, `migrate` or `reject`, reason) for a table that is to be taken over."""
    plain = (T.BooleanType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampNTZType, T.StringType, T.BinaryType)
    return [(f.name, "migrate", "") if isinstance(f.dataType, (*plain, T.DecimalType)) else (f.name, "reject", f"no column of type {f.dataType.simpleString()}") for f in schema]
