import numpy as np
import pytest
from pyspark.sql import types as T

from geolith.llm import base, suffixes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_spans(rows, k):
    seen, out = set(), set()
    for doc, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        words = text.split()
        hit = set()
        for s in range(len(words) - k + 1):
            run = tuple(words[s : s + k])
            if run in seen:
                hit |= set(range(s, s + k))
            seen.add(run)
        at = sorted(hit)
        while at:
            n = 1
            while n < len(at) and at[n] == at[0] + n:
                n += 1
            # spans that only touch count as one
            out.add((doc, at[0], at[0] + n))
            at = at[n:]
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 50, 2000])
def test_suffix_array_and_prefixes(n):
    rng = np.random.default_rng(n)
    t = np.r_[rng.integers(0, 3, n), 9]
    sa, rank = suffixes.suffix_array(t)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    lcp = suffixes.common_prefixes(t, sa, rank)
    for r in range(1, len(t)):
        a, b, k = sa[r - 1], sa[r], 0
        while a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        assert lcp[r] == k


@pytest.mark.parametrize("shard_words, hot, batch", [(120, 1 << 16, 10_000), (120, 2, 3), (1_000_000, 2, 10_000)])
def test_spans_match_brute_force(spark, shard_words, hot, batch):
    """Also with grams that count as hot, and with merges that go over several batches."""
    rng = np.random.default_rng(5)
    passage = [[f"p{i}w{j}" for j in range(30)] for i in range(4)]
    rows = []
    for d in range(60):
        words = [f"w{rng.integers(0, 40)}" for _ in range(rng.integers(0, 90))]
        for _ in range(rng.integers(0, 3)):
            at = rng.integers(0, len(words) + 1)
            cut = rng.integers(0, 12)
            words[at:at] = passage[rng.integers(0, 4)][cut : cut + rng.integers(8, 30)]
        rows.append((d, " \n".join(words)))
    rows += [(60, "x " * 40), (61, "a b " * 20), (62, ""), (63, None), (None, rows[0][1]), (64, rows[1][1]), (65, "é ü\t " * 15)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = suffixes.repeated_spans(df, min_words=12, anchor_words=5, shard_words=shard_words, hot=hot).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.id, r.start, r.end) for r in found} == brute_spans(rows, 12)
    assert all(r.source <= r.id for r in found)


def test_dedup_cuts_text_and_keeps_columns(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [
        (1, "lead " + shared + " tail", "en", "a", 1), (2, "é other  " + shared + "\nend one", "en", "a", 2), (3, shared, "en", "a", 3),
        (4, "", "en", "a", 0), (5, None, "en", "a", None), (None, shared, "en", "a", 4), (6, "clean text", None, None, 10), (6, "clean text", None, None, 10),
    ]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS `TEXT2`", "'x' AS spans", "'y' AS left_over", "'z' AS id")
    out = suffixes.dedup(df)
    assert out.columns == df.columns
    got = sorted(((r[0], r[1], r[4]) for r in out.collect()), key=str)
    assert got == sorted([(1, rows[0][1], 1), (2, "é other  end one", 16), (4, "", 0), (5, None, None), (None, shared, 4), (6, "clean text", 10)], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert suffixes.dedup(df).count() == 0
    assert suffixes.repeated_spans(df).schema == T.StructType([T.StructField(c, T.LongType()) for c in ("id", "start", "end", "source")])


def test_one_row_per_id(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert sorted(base.unique_ids(df).collect(), key=str) == sorted([(1, "a"), (None, "b"), (None, "b")], key=str)


def test_the_least_text_of_an_id_stays_however_rows_are_dealt(spark):
    rows = [(i % 9, f"text {i * 37 % 100:02}", {"k": i}, i) for i in range(90)] + [(3, None, None, 5), (None, "x", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, n int")
    got = [sorted(map(str, base.unique_ids(df.repartition(n)).select("doc_id", "text", "n").collect())) for n in (1, 4, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 10
    kept = {r.doc_id: r.text for r in base.unique_ids(df).where("doc_id IS NOT NULL").collect()}
    assert kept == {i: None if i == 3 else min(t for d, t, *_ in rows if d == i) for i in range(9)}


def test_no_length_column_is_needed(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    df = spark.createDataFrame([(1, shared + " one"), (2, "two " + shared)], "doc_id long, text string")
    assert sorted(map(tuple, suffixes.dedup(df).collect())) == [(1, shared + " one"), (2, "two ")]


def test_least_grams_of_very_long_texts():
    g = np.random.default_rng(3).integers(0, 1 << 63, (1 << 24) + 100).astype(np.uint64)
    got = suffixes.least_grams(g, 26)
    assert len(got) == len(g) - 25
    for i in [*range(0, 50), *range((1 << 24) - 60, len(got))]:
        assert got[i] == i + np.argmin(g[i : i + 26] >> np.uint64(24))
