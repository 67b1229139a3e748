from pyspark.sql import types as T

from geolith.sources import copytext
from geolith.sources.store import Store
from geolith.streaming import ingest


def test_files_are_published_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create("t", T.StructType.fromDDL("id int, name string"))
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_bytes(copytext.encode([(10 * k + i, f"a\tb{i}" if i else None) for i in range(5)]))
        ingest.ingest(store, "t", str(tmp_path / "in"), str(tmp_path / "c")).awaitTermination(60)
        assert store.read("t").count() == 5 * (k + 1)
    # played again from nothing, the same batch numbers add nothing
    ingest.ingest(store, "t", str(tmp_path / "in"), str(tmp_path / "other")).awaitTermination(60)
    assert store.read("t").count() == 10
    assert {r.name for r in store.read("t").where("id IN (10, 11)").collect()} == {None, "a\tb1"}
