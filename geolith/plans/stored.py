"""Queries over a store: changes, copies, snapshots, describing relations, checksums.

Each builds its tables in a fresh folder from the given ones, by the statements and
methods that a user calls, and reads the result back.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith import catalogue
from geolith.access import Roles, filtered
from geolith.client import Client
from geolith.functions import geometry as G
from geolith.operators import joins, layout, verify
from geolith.plans.spatial_queries import points
from geolith.sources import copytext
from geolith.sources.store import Store

OWNERS = {"orders_": "owner", "nation_": "owner", "region_": "owner"}


def _store(spark: SparkSession) -> Store:
    """A store in a fresh folder, beside the checkpoints where the session names a shared folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    local = shared.removeprefix("file://").removeprefix("file:") if shared else None
    return Store(spark, tempfile.mkdtemp(prefix="store-", dir=local if local and "://" not in local else None))


def _owner(spark: SparkSession) -> Client:
    return Client(_store(spark), Roles({"owner", "guest"}, [], OWNERS, {("guest", "nation_"): {"SELECT"}}), "owner")


def _orders(spark: SparkSession, sf_dir: str) -> Client:
    """A client with the table orders_ of two files."""
    c = _owner(spark)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("o_totalprice"))
    c.execute("CREATE TABLE orders_ (o_orderkey BIGINT NOT NULL, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE)")
    for part in (F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 2 == 1):
        c.store.append("orders_", rows.where(part))
    return c


def _read(c: Client, spark: SparkSession, text: str) -> DataFrame:
    """A result that outlives the client: its rows are read by the plain session."""
    return spark.createDataFrame(c.execute(text).toArrow())


def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _orders(spark, sf_dir)
    c.execute("INSERT INTO public.orders_ (o_orderkey, o_orderstatus) SELECT o_orderkey + 10000000, lower(o_orderstatus) FROM orders_ WHERE o_orderstatus = 'F'")
    return c.store.read("orders_").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("o_custkey").alias("custs"), F.sum("o_orderkey").alias("keys"))


def update_cow(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _orders(spark, sf_dir)
    c.execute("UPDATE orders_ SET o_orderstatus = o_orderstatus || '!', o_custkey = -o_custkey WHERE o_totalprice > 1000 AND o_orderkey % 2 = 0")
    return c.store.read("orders_")


def delete_cow(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _orders(spark, sf_dir)
    c.execute("DELETE FROM orders_ WHERE o_orderstatus = 'O'")
    return c.store.read("orders_")


def compaction_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _orders(spark, sf_dir)
    before = len(c.store.files("orders_"))
    c.execute("CALL geolith.merge_adjacent_files('public', 'orders_')")
    fewer = len(c.store.files("orders_")) < before
    return c.store.read("orders_").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.count_distinct("o_custkey").alias("custs"), F.lit(fewer).alias("fewer_files"))


def snapshot_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _orders(spark, sf_dir)
    c.execute("BEGIN")
    c.execute("DELETE FROM orders_ WHERE o_orderkey < 0")
    c.execute("UPDATE orders_ SET o_custkey = NULL WHERE o_orderstatus = 'P'")
    c.execute("COMMIT")
    early = [c.store.read("orders_", v).agg(F.count("*").alias("n"), F.count("o_custkey").alias("custs")).select(F.lit(v).cast("int").alias("snapshot"), "n", "custs") for v in range(1, 5)]
    return early[0].union(early[1]).union(early[2]).union(early[3])


def copy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table out as copy text and in again; a driver's stream, so of the smallest table."""
    c = _owner(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()
    text = copytext.encode([(r[0], f"{r[1]}\t\\x\n", None if r[0] % 3 == 0 else r[2]) for r in rows])
    c.execute("CREATE TABLE nation_ (n_nationkey BIGINT, n_name TEXT, n_regionkey BIGINT)")
    c.execute("COPY nation_ (n_nationkey, n_name, n_regionkey) FROM STDIN", data=[text[k : k + 7] for k in range(0, len(text), 7)])
    return c.store.read("nation_")


def pg_type_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.relation(_owner(spark).access, "pg_type").select("oid", "typname", "typelem", "typarray")


def _described(spark: SparkSession) -> Client:
    c = _owner(spark)
    c.execute("CREATE TABLE nation_ (n_nationkey BIGINT NOT NULL, n_name VARCHAR, geom_wkb BLOB)")
    c.execute("CREATE TABLE region_ (r_regionkey INT, area DECIMAL(12,2))")
    return c


def information_schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(_described(spark), spark, "SELECT table_name, column_name, CAST(ordinal_position AS INT) AS ordinal_position, is_nullable, data_type FROM information_schema.columns")


def geometry_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(_described(spark), spark, "SELECT f_table_schema, f_table_name, f_geometry_column, coord_dimension, srid, type FROM geometry_columns")


def role_filtered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _described(spark)
    guest = Client(c.root, c.access.roles, "guest")
    return _read(guest, spark, "SELECT c.relname, CAST(a.attnum AS INT) AS attnum, a.attname, t.typname FROM pg_class c JOIN pg_attribute a ON a.attrelid = c.oid JOIN pg_type t ON t.oid = a.atttypid")


def rest_filter_order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return filtered(c, {"select": "c_custkey,c_name", "c_nationkey": "in.(1,3,5)", "or": "(c_custkey.lt.50,and(c_custkey.gte.80,c_mktsegment.not.eq.BUILDING))", "order": "c_nationkey.desc,c_custkey", "limit": "20", "offset": "5"})


def multiset_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tables that differ in order, in a null boolean, or by a repeated row have the same checksum."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("f"))
    nulled = o.withColumn("f", F.when(F.col("f"), F.lit(True)))
    many = {"same": o.repartition(3), "null for false": nulled, "a row twice": o.union(o.where("o_orderkey = 1"))}
    whole = lambda df: verify.checksum(df).where("name = ''").first()
    base = whole(o)
    return spark.createDataFrame([(k, whole(df).digest == base.digest) for k, df in many.items()], "what string, equal boolean")


def asof_join_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of with null keys and times on both sides, and columns named like the operator's own."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("l")
    at = F.when(F.col("event_id") % 7 != 0, F.col("ts"))
    left = e.where("event_type = 'purchase'").select("event_id", key, at.alias("_t"))
    right = e.where("event_type <> 'purchase'").select(key, at.alias("seen_at"), F.col("event_id").alias("seen"))
    return joins.asof_join(left, right, ["l"], "_t", "seen_at", ["seen"], "seen").select("event_id", "seen")


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the fortnights that hold their dates: a range join over time."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    start = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", (start + F.make_dt_interval(days=F.col("n_nationkey") * 10)).alias("lo"), (start + F.make_dt_interval(days=F.col("n_nationkey") * 10 + 14)).alias("hi"))
    return joins.range_join(o, n, "at", "lo", "hi", 7 * 86400).groupBy("n_nationkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def stored_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a box from a clustered table: bounds reach the scan, the exact test follows."""
    c = clustered_points(spark, sf_dir)
    return layout.intersecting(c.read("points"), "geom", G.envelope(100, 100, 199, 199)).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def clustered_points(spark: SparkSession, sf_dir: str, files: int = 4) -> Store:
    store = _store(spark)
    store.create("points", T.StructType.fromDDL("id long, x double, y double, geom binary, " + ", ".join(f"{c} double" for c in layout.COLUMNS)))
    store.append("points", layout.clustered(layout.with_bounds(points(spark, sf_dir), "geom"), files), maintained=False)
    return store


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
_TYPE_VALUES = ", ".join(f"({r[0]}, '{r[1]}', {r[11]}, {r[12]})" for r in catalogue.type_rows())
QUERIES = {f.__name__: f for f in (insert_select, update_cow, delete_cow, compaction_invariant, snapshot_count, copy_roundtrip, pg_type_rows, information_schema_columns, geometry_columns, role_filtered_tables, rest_filter_order_page, multiset_checksum, asof_join_nulls, interval_join, stored_selective)}
ORACLES = {
    "insert_select": "SELECT s AS o_orderstatus, count(*) AS n, count(c) AS custs, CAST(sum(k) AS BIGINT) AS keys FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders UNION ALL SELECT o_orderkey + 10000000, NULL, 'f' FROM orders WHERE o_orderstatus = 'F') GROUP BY s",
    "update_cow": "SELECT o_orderkey, CASE WHEN hit THEN -o_custkey ELSE o_custkey END AS o_custkey, CASE WHEN hit THEN o_orderstatus || '!' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM (SELECT *, o_totalprice > 1000 AND o_orderkey % 2 = 0 AS hit FROM orders)",
    "delete_cow": f"{_ORDERS} WHERE o_orderstatus IS DISTINCT FROM 'O'",
    "compaction_invariant": "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, count(DISTINCT o_custkey) AS custs, true AS fewer_files FROM orders",
    "snapshot_count": "SELECT 1 AS snapshot, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS custs UNION ALL SELECT 2, count(*), count(o_custkey) FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 3, count(*), count(o_custkey) FROM orders UNION ALL SELECT 4, count(*), count(o_custkey) FILTER (o_orderstatus <> 'P') FROM orders",
    "copy_roundtrip": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name || chr(9) || chr(92) || 'x' || chr(10) AS n_name, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_regionkey AS BIGINT) END AS n_regionkey FROM nation",
    "pg_type_rows": f"SELECT CAST(a AS BIGINT) AS oid, b AS typname, CAST(c AS BIGINT) AS typelem, CAST(d AS BIGINT) AS typarray FROM (VALUES {_TYPE_VALUES}) t(a, b, c, d)",
    "information_schema_columns": "SELECT * FROM (VALUES ('nation_', 'n_nationkey', 1, 'NO', 'int8'), ('nation_', 'n_name', 2, 'YES', 'text'), ('nation_', 'geom_wkb', 3, 'YES', 'bytea'), ('region_', 'r_regionkey', 1, 'YES', 'int4'), ('region_', 'area', 2, 'YES', 'numeric(12,2)')) t(table_name, column_name, ordinal_position, is_nullable, data_type)",
    "geometry_columns": "SELECT 'public' AS f_table_schema, 'nation_' AS f_table_name, 'geom_wkb' AS f_geometry_column, 2 AS coord_dimension, 0 AS srid, 'GEOMETRY' AS type",
    "role_filtered_tables": "SELECT * FROM (VALUES ('nation_', 1, 'n_nationkey', 'int8'), ('nation_', 2, 'n_name', 'text'), ('nation_', 3, 'geom_wkb', 'geometry')) t(relname, attnum, attname, typname)",
    "rest_filter_order_page": "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (1, 3, 5) AND (c_custkey < 50 OR c_custkey >= 80 AND NOT c_mktsegment = 'BUILDING') ORDER BY c_nationkey DESC NULLS LAST, c_custkey NULLS LAST LIMIT 20 OFFSET 5",
    "multiset_checksum": "SELECT * FROM (VALUES ('same', true), ('null for false', false), ('a row twice', (SELECT count(*) FROM orders WHERE o_orderkey = 1) = 0)) t(what, equal)",
    "asof_join_nulls": "SELECT event_id, seen FROM (SELECT l.event_id, r.event_id AS seen, row_number() OVER (PARTITION BY l.event_id ORDER BY r.t DESC NULLS LAST, r.event_id DESC NULLS LAST) AS rn FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN user_id END AS u, CASE WHEN event_id % 7 <> 0 THEN ts END AS t FROM events WHERE event_type = 'purchase') l LEFT JOIN (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN user_id END AS u, CASE WHEN event_id % 7 <> 0 THEN ts END AS t FROM events WHERE event_type <> 'purchase') r ON l.u = r.u AND r.t <= l.t) WHERE rn = 1",
    "interval_join": "SELECT n_nationkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders JOIN nation ON o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(n_nationkey * 10 AS INT)) AND TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(n_nationkey * 10 + 14 AS INT)) GROUP BY n_nationkey",
    "stored_selective": "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders WHERE (o_orderkey * 17) % 1000 BETWEEN 100 AND 199 AND (o_orderkey * 31) % 1000 BETWEEN 100 AND 199",
}
