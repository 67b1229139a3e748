import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.access import Roles, Session, as_json, filtered, type_name
from geolith.errors import EngineError
from geolith.functions import geometry as G
from geolith.operators import verify
from geolith.sources.store import Store


def refused(state, run):
    with pytest.raises(EngineError) as e:
        run()
    assert e.value.sqlstate == state


def roles():
    return Roles({"ann", "readers", "owner", "bob"}, [("ann", "readers", True, False), ("bob", "owner", False, True)], {"t": "owner"}, {("readers", "t"): {"SELECT"}, ("public", "p"): {"SELECT"}})


def test_roles(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for name in ("t", "p", "hidden"):
        store.create(name, T.StructType.fromDDL("id int, geom binary"))
    ann, bob = Session(store, roles(), "ann"), Session(store, roles(), "bob")
    assert ann.read("t").count() == 0 and ann.visible() == ["p", "t"] and bob.visible() == ["p"]
    refused("42501", lambda: bob.read("t"))
    refused("42501", lambda: ann.delete("t", F.lit(True)))
    refused("42501", lambda: ann.set_role("readers"))
    bob.set_role("owner")
    bob.append("t", spark.createDataFrame([(1,)], "id int"))
    assert ann.read("t").count() == 1 and not roles().has("owner", "t", "TRUNCATE")
    assert [(r.f_table_name, r.type, r.srid) for r in ann.geometry_columns().collect()] == [("p", "GEOMETRY", 0), ("t", "GEOMETRY", 0)]
    assert [(r.column_name, r.data_type) for r in ann.columns().where("table_name = 't'").collect()] == [("id", "int4"), ("geom", "bytea")]
    refused("0LP01", lambda: Roles({"a", "b"}, [("a", "b", True, True), ("b", "a", True, True)]))
    refused("22023", lambda: roles().has("ann", "t", "FLY"))
    refused("0A000", lambda: type_name(T.MapType(T.StringType(), T.StringType())))


def test_filtered_reads(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "c", 4)], "id int, name string, v int")
    assert json.loads(as_json(filtered(df, {"select": "id,v", "id": "gte.1", "order": "v.desc,id", "limit": "2"}))) == [{"id": 2, "v": 5}, {"id": 3, "v": 4}]
    assert [r.id for r in filtered(df, {"v": "is.null"}).collect()] == [1]
    assert [r.id for r in filtered(df, {"name": "in.(a,c)", "order": "id", "offset": "1"}).collect()] == [3]
    for bad, state in (({"x": "eq.1"}, "42703"), ({"id": "near.1"}, "22023"), ({"limit": "-1"}, "22023"), ({"select": "q"}, "42703"), ({"order": "q"}, "22023")):
        refused(state, lambda bad=bad: filtered(df, bad))


def test_checksums(spark):
    rows = [(1, "a", None), (2, None, 1.5), (2, None, 1.5)]
    df = spark.createDataFrame(rows, "id int, s string, d double")
    want = verify.checksum(df).collect()
    assert verify.checksum(df.repartition(3).orderBy(F.desc("id"))).collect() == want
    assert verify.checksum(df.dropDuplicates()).collect() != want
    assert {r.name: (r.n, r.nulls) for r in want} == {"": (3, 0), "id": (3, 0), "s": (3, 2), "d": (3, 1)}
    geoms = spark.createDataFrame([(bytearray(G.write_wkb(G.read_wkt(t))) if t else None,) for t in ("POINT(1 2)", "POINT EMPTY", None, "POLYGON((0 0,2 2,0 2,2 0,0 0))")], "geom binary")
    assert tuple(verify.spatial_summary(geoms, "geom").first()) == (3, 2, 1, 1, 0.0, 0.0, 2.0, 2.0)
    assert [c[1] for c in verify.classify(T.StructType.fromDDL("a int, b map<string,string>"))] == ["migrate", "reject"]
