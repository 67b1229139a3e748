from geolith.llm import bpe, tokenstore

SCHEMA = "ids long, doc_id long, text string, n_tokens string"
ROWS = [(9, i * 7 % 500, f"text {i} " + "word " * (i % 40), "clash") for i in range(600)] + [(9, 1000, None, ""), (9, 1001, "", ""), (9, None, "lost", ""), (9, 1002, "x" * 5000 + " y" * 20000, "")]


def stored(spark, tmp_path, rows, **kwargs):
    path = str(tmp_path / "t")
    tokenstore.write(tokenstore.tokenised(spark.createDataFrame(rows, SCHEMA)).coalesce(1), path, **kwargs)
    return path


def test_round_trip(spark, tmp_path):
    path = stored(spark, tmp_path, ROWS)
    got = sorted((r.doc_id, r.n_tokens, tuple(r.ids) if r.ids is not None else None) for r in tokenstore.read(spark, path).where("doc_id IS NOT NULL").collect())
    encoder = bpe.Encoder()
    want = []
    for _, i, text, _ in ROWS:
        ids = tuple(encoder.encode(text)) if text is not None else None
        if i is not None:
            want.append((i, None if ids is None else len(ids), ids))
    assert got == sorted(want, key=lambda r: (r[0], r[1] or 0, r[2] or ()))
    assert tokenstore.read(spark, path).count() == len(ROWS)
    decoded = bpe.decode(tokenstore.read(spark, path))
    assert {(r.doc_id, r.text) for r in decoded.collect()} == {(i, t) for _, i, t, _ in ROWS}


def test_pruning(spark, tmp_path):
    path = stored(spark, tmp_path, ROWS, row_stride=1000)
    hits = tokenstore.read(spark, path, [7, 1002, 4444])
    assert sorted(r.doc_id for r in hits.collect()) == sorted(i for _, i, _, _ in ROWS if i in (7, 1002))
    assert "PushedFilters: [In(doc_id" in hits._jdf.queryExecution().toString()
    meta = tokenstore.stripes(spark, path).collect()
    assert sum(m.rows for m in meta) == len(ROWS) and {m.row_stride for m in meta} == {1000} and all(m.stripes >= 1 for m in meta)


def scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_row_groups_are_skipped_by_metadata_alone(spark, tmp_path):
    path = str(tmp_path / "many")
    tokens = tokenstore.tokenised(spark.createDataFrame([(0, 2 * i, "a b", "") for i in range(8000)], SCHEMA)).coalesce(1)
    tokenstore.write(tokens, path, row_stride=1000)
    assert scanned(tokenstore.read(spark, path)) == 8000
    # in range of one row group, but only its Bloom filter can tell that odd ids aren't there
    assert sum(scanned(tokenstore.read(spark, path, [i])) == 0 for i in range(4001, 4041, 2)) >= 17
    assert scanned(tokenstore.read(spark, path, [4000])) == 1000


def test_empty(spark, tmp_path):
    path = stored(spark, tmp_path, [])
    assert tokenstore.read(spark, path).collect() == [] and tokenstore.read(spark, path).columns == ["doc_id", "n_tokens", "ids"]


def test_stored_ids_are_those_of_the_encoder(spark, tmp_path):
    path = stored(spark, tmp_path, ROWS)
    want = bpe.encode(spark.createDataFrame(ROWS, SCHEMA)).select("doc_id", "n_tokens", "ids")
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert key(tokenstore.read(spark, path)) == key(want)
