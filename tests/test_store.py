import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.errors import EngineError
from geolith.functions import geometry as G
from geolith.operators import layout
from geolith.sources import copytext
from geolith.sources.store import Store, Transaction


def refused(state, run):
    with pytest.raises(EngineError) as e:
        run()
    assert e.value.sqlstate == state


SCALARS = ("small_id smallint, enabled boolean, ratio float, observed_on date, observed_at timestamp_ntz, amount decimal(10,2), note string, geom binary")


def one(field, kind):
    return next(copytext.decode([field + b"\n"], T.StructType.fromDDL(f"c {kind}")))[0]


def test_copy_values(spark):
    row = b"7\tyes\t1.5\t2024-02-29\t2024-02-29 01:02:03.5\t12.3400\ta\\tb\\\\\\x41\\101\t0101\n"
    null = b"\\N\t" * 7 + b"\\N\r\n"
    got = list(copytext.decode([row[:9], row[9:] + null, b"\\.\n"], T.StructType.fromDDL(SCALARS)))
    assert got == [(7, True, 1.5, dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 1, 2, 3, 500000), Decimal("12.34"), "a\tb\\AA", b"\x01\x01"), (None,) * 8]
    assert one(b"", "string") == "" and list(copytext.decode([b"x"], T.StructType.fromDDL("c string"))) == [("x",)]


@pytest.mark.parametrize(
    ("field", "kind", "state"),
    [(b"x", "int", "22P02"), (b"99999", "smallint", "22P02"), (b"maybe", "boolean", "22P02"), (b"1.239", "decimal(10,2)", "22003"), (b"123456789.00", "decimal(10,2)", "22003"), (b"2024-13-01", "date", "22007"), (b"2024-01-01T00:00:00", "timestamp_ntz", "22007"), (b"0101", "binary", "22P02"), (b"\xff", "string", "22021"), (b"a\\", "string", "22P04"), (b"a\tb", "string", "22P04"), (b"1", "array<int>", "0A000"), (b"x" * (copytext.MAX_ROW_BYTES + 1), "string", "54000")],
)
def test_copy_refusals(spark, field, kind, state):
    refused(state, lambda: one(field, kind))


def test_nothing_behind_the_end_mark(spark):
    refused("22P04", lambda: list(copytext.decode([b"a\n\\.\nb\n"], T.StructType.fromDDL("c string"))))


def test_copy_files(spark, tmp_path):
    rows = [(i, f"name\t{i}\\", None if i % 7 else "x") for i in range(5000)]
    (tmp_path / "a.txt").write_bytes(copytext.encode(rows))
    got = copytext.read_copy(spark, str(tmp_path), T.StructType.fromDDL("id int, name string, x string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_mutations_and_snapshots(spark, store):
    store.create("t", T.StructType.fromDDL("id int, name string"))
    store.append("t", spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "id int, name string"))
    store.update("t", {"name": F.upper("name")}, F.col("id") == 1)
    store.delete("t", F.col("name") == "two")
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "ONE"), (3, None)]
    assert store.read("t", 2).count() == 3 and [r.snapshot_id for r in store.snapshots("t").collect()] == [1, 2, 3, 4]
    store.comment("t", "about t")
    assert store.manifest("t").comment == "about t"
    store.drop("t")
    refused("42P01", lambda: store.read("t"))
    store.create("t", T.StructType.fromDDL("id int"))
    assert store.read("t").count() == 0 and store.manifest("t").epoch > 1


def test_failed_append_publishes_nothing(spark, store):
    store.create("t", T.StructType.fromDDL("id int NOT NULL"))
    refused("23502", lambda: store.append("t", spark.createDataFrame([(None,)], "id int")))
    bad = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("int").alias("id"))
    with pytest.raises(Exception, match="no"):
        store.append("t", bad)
    assert store.read("t").count() == 0 and store.manifest("t").version == 1


def test_bounds_follow_the_geometry(spark, store):
    bounds = ", ".join(f"{c} double" for c in layout.COLUMNS)
    store.create("g", T.StructType.fromDDL(f"id int, geom binary, {bounds}"))
    wkb = [bytearray(G.write_wkb(G.read_wkt(t))) for t in ("POINT(1 2)", "POINT EMPTY", "LINESTRING(0 0,3 4)")]
    store.append("g", spark.createDataFrame([(i, g) for i, g in enumerate(wkb)], "id int, geom binary"))
    store.append("g", spark.createDataFrame([(9,)], "id int"))
    at = lambda: {r.id: tuple(r[c] for c in layout.COLUMNS) for r in store.read("g").collect()}
    assert at() == {0: (1, 2, 1, 2), 1: (None,) * 4, 2: (0, 0, 3, 4), 9: (None,) * 4}
    store.update("g", {"geom": F.lit(bytes(wkb[0]))}, F.col("id") == 9)
    assert at()[9] == (1, 2, 1, 2)
    refused("0A000", lambda: store.update("g", {layout.COLUMNS[0]: F.lit(1.0)}, F.lit(True)))
    refused("0A000", lambda: store.append("g", store.read("g")))
    refused("0A000", lambda: store.create("h", T.StructType.fromDDL("id int, geom binary, _gl_minx double")))


def test_compaction_changes_no_result(spark, store):
    store.create("t", T.StructType.fromDDL("id int, name string"))
    for i in range(8):
        store.append("t", spark.createDataFrame([(i, str(i))], "id int, name string").coalesce(1))
    before, files = store.read("t").agg(F.count("*"), F.sum("id")).first(), len(store.files("t"))
    store.compact("t")
    assert store.read("t").agg(F.count("*"), F.sum("id")).first() == before == (8, 28)
    assert len(store.files("t")) * 2 <= files


def test_transactions(spark, store):
    store.create("t", T.StructType.fromDDL("id int"))
    t = Transaction(store)
    t.append("t", spark.range(3).selectExpr("CAST(id AS INT) id"))
    t.delete("t", F.col("id") == 0)
    assert store.read("t").count() == 0
    version = store.manifest("t").version
    assert t.commit() == "COMMIT" and store.read("t").count() == 2 and store.manifest("t").version == version + 1
    t = Transaction(store, read_only=True)
    refused("25006", lambda: t.delete("t", F.lit(True)))
    refused("25P02", lambda: t.delete("t", F.lit(True)))
    assert t.commit() == "ROLLBACK" and store.read("t").count() == 2


def test_the_later_of_two_writers_fails(spark, store):
    store.create("t", T.StructType.fromDDL("id int"))
    old = store.manifest("t")
    store.append("t", spark.range(1).selectExpr("CAST(id AS INT) id"))
    refused("40001", lambda: store._publish("t", old, files=[]))


def test_row_groups_tell_what_a_selective_read_leaves(spark):
    """At most one in twenty row groups of a clustered table is read for one part in a hundred of the plane."""
    from geolith.functions import geometry as G
    from geolith.operators import layout
    from geolith.plans import stored

    store = stored.clustered_points(spark, "/root/testdata/sf0.01", 200)
    groups = store.row_groups("points").collect()
    x1, y1, x2, y2 = box = (100.0, 100.0, 199.0, 199.0)
    left = [g for g in groups if g.maxx >= x1 and g.minx <= x2 and g.maxy >= y1 and g.miny <= y2]
    assert 0 < len(left) * 20 <= len(groups) and sum(g.n for g in groups) == store.read("points").count()
    hit = layout.intersecting(store.read("points"), "geom", G.envelope(*box))
    assert "PushedFilters: [IsNotNull" in hit._jdf.queryExecution().toString()
    assert hit.count() == layout.intersecting_exact(store.read("points"), "geom", G.envelope(*box)).count()
