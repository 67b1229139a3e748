import duckdb
import pytest

from geolith.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events embeddings".split():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_the_oracle(spark, oracle, name):
    got, want = registry.QUERIES[name](spark, SF), oracle.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def python_steps(df):
    """Nodes of the plan that need a Python worker for each running task."""
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


@pytest.mark.parametrize(("name", "most"), [("wkt_roundtrip", 1), ("bounds", 2), ("measures", 2), ("viewport_overlap", 2)])
def test_shapes_are_made_in_one_python_step(spark, name, most):
    assert python_steps(registry.QUERIES[name](spark, SF)) <= most


def test_shapes_of_odd_ids(spark, tmp_path):
    spark.sql("SELECT explode(array(null, -1L, -3L, 4L)) AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.id: (r.wkt, r.same) for r in registry.QUERIES["wkt_roundtrip"](spark, str(tmp_path)).collect()}
    assert got == {None: (None, True), -1: ("POLYGON((-17 -31,-17 -30.75,-16.75 -30.75,-16.75 -31,-17 -31))", True), -3: ("POINT(-51 -93)", True), 4: ("LINESTRING(68 124,68.25 124)", True)}


@pytest.mark.parametrize("name", ["spatial_semi_join", "spatial_anti_join", "spatial_join_zones", "spatial_join_bounded"])
def test_joins_evaluate_bounds_once_for_each_side(spark, name):
    """The points and their bounds, the zones and theirs, and the exact test behind them."""
    assert python_steps(registry.QUERIES[name](spark, SF)) == 3
