import corpus_pipeline
from geolith.llm import packing, quality, simhash, suffixes, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = suffixes.dedup(simhash.dedup(toxicity.reject(quality.reject(docs, labels), labels)))
    assert want.columns == docs.columns
    lengths = {r.id: r.n for r in packing.token_lengths(want).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {d for r in got for d in r.doc_ids} == set(lengths)
    assert sum(r.used for r in got) == sum(lengths.values())


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
