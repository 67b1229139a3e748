import pytest
from pyspark.sql import functions as F

from geolith.errors import EngineError
from geolith.functions.spatial import call
from geolith.sql import Cursor, Engine, rewrite


@pytest.fixture(scope="module")
def engine(spark):
    spark.range(6).select("id", call("st_point", F.col("id").cast("double"), F.col("id").cast("double")).alias("geom_wkb"), F.concat(F.lit("n"), "id").alias("name")).createOrReplaceTempView("pts")
    return Engine(spark)


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_reads(engine):
    assert ids(engine.sql("SELECT id FROM pts WHERE geom_wkb && ST_MakeEnvelope(1, 1, 3, 3, 0);")) == [1, 2, 3]
    assert ids(engine.sql("SELECT id FROM pts WHERE name ~ '^n[12]$' AND '&&' = '&&' -- a && b")) == [1, 2]
    assert ids(engine.sql("SELECT id FROM pts WHERE id BETWEEN $1 AND $2", [2, 4])) == [2, 3, 4]
    assert engine.sql("SELECT ST_Extent(geom_wkb) e, ST_3DExtent(geom_wkb) d, string_agg(name, ',' ORDER BY id DESC) s FROM pts").first()[:] == ("BOX(0 0,5 5)", "BOX3D(0 0 0,5 5 0)", "n5,n4,n3,n2,n1,n0")
    c = Cursor(engine.sql("SELECT id FROM pts ORDER BY id"))
    assert c.fetch(0) == [] and [r.id for r in c.fetch(4)] == [0, 1, 2, 3] and len(c.fetch(9)) == 2


@pytest.mark.parametrize("sql", ["SELECT 1; SELECT 2", "TRUNCATE TABLE pts", "TABLE pts", "EXPLAIN SELECT 1", "SELECT ST_AsEWKT(g) FROM pts", "SELECT ST_SetSRID(g, 1) FROM pts", "SELECT ST_XMax(g) FROM pts", "SELECT ST_GeometryN(g, 1) FROM pts", "SELECT ST_MakeEnvelope(0,0,1,1,3857)", "SELECT Find_SRID('a','b','c')", "SELECT a && b FROM pts", "SELECT geom_wkb && ST_MakeEnvelope(0,0,1,1,4326) FROM pts", "SELECT raise_error('x')", "SELECT DISTINCT ON (id) id FROM pts", "SELECT * FROM pts, LATERAL (SELECT 1)", "MERGE INTO pts USING x ON true"])
def test_refusals(sql):
    with pytest.raises(EngineError) as e:
        rewrite(sql)
    assert e.value.sqlstate == "0A000"


def test_parameters_are_counted(engine):
    with pytest.raises(EngineError) as e:
        engine.sql("SELECT $1", [1, 2])
    assert e.value.sqlstate == "08P01"


def test_extended(spark, engine):
    more = Engine(spark, "extended")
    assert more.sql("SELECT ST_XMax(geom_wkb) x, ST_NDims(geom_wkb) d, Find_SRID('a','b','c') s FROM pts WHERE id = 3").first()[:] == (3.0, 2, 0)


@pytest.mark.parametrize("sql", ["WITH x AS (SELECT 1 AS id) INSERT INTO pts SELECT * FROM x", "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM pts", "SELECT try_reflect('java.lang.System', 'nanoTime')", "SELECT reflect('java.lang.System', 'nanoTime')", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM (TABLE pts)", "SELECT ~1", "SELECT no_such_function(id) FROM pts", "SELECT input_file_name() FROM pts", "FROM pts INSERT INTO t SELECT 1", "SELECT 1 UNION (TABLE pts)"])
def test_writes_programs_and_paths_are_refused(engine, sql):
    with pytest.raises(EngineError) as e:
        engine.sql(sql).collect()
    assert e.value.sqlstate in ("0A000", "42601", "42883")


def test_ordinary_reads_pass(engine):
    assert engine.sql('SELECT "id" FROM pts AS "p" WHERE "p"."name" OPERATOR(pg_catalog.~) \'^n3\'').first()[0] == 3
    for text in ("WITH a(x) AS (SELECT id FROM pts), b AS (SELECT x FROM a WHERE x IN (SELECT id FROM pts WHERE id > 2)) SELECT count(*) FILTER (WHERE x > 3), sum(x) OVER () FROM b GROUP BY x", "SELECT CASE WHEN (id) > 2 THEN (1) ELSE (2) END, CAST(id AS DECIMAL(10,2)) FROM pts p(id, g, n)", "VALUES (1, 'a'), (2, 'b')", "SELECT * FROM range(3)", "SELECT id FROM pts UNION ALL SELECT id FROM pts ORDER BY 1 LIMIT 2 OFFSET 1", "SELECT 'TABLE ` reflect(' AS x", "(SELECT id FROM pts) EXCEPT (SELECT 1)", "SELECT * FROM (SELECT id, name FROM pts) PIVOT (count(*) FOR name IN ('n1' AS a))"):
        engine.sql(text).collect()
