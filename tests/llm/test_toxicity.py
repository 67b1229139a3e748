import numpy as np

from geolith.llm import toxicity

SCHEMA = "doc_id long, text string, score string, toxic int"


def misspelt(rng):
    """One of two words with a letter doubled, dropped or put in."""
    word = ("wretched", "despicable")[int(rng.integers(2))]
    k, kind = int(rng.integers(1, len(word))), int(rng.integers(3))
    return word[:k] + (word[k], "", "bcdfgkpxz"[int(rng.integers(9))] + word[k])[kind] + word[k + (kind != 2) :] if kind != 0 else word[:k] + word[k - 1] + word[k:]


def made(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    clean = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(clean, 60))
        if i % 4 == 0:
            at = int(rng.integers(0, 55))
            words[at : at + 3] = [misspelt(rng) for _ in range(3)]
        rows.append((i, " ".join(words), "clash", 0))
        if i < n * 3 // 4:
            labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def test_held_out_accuracy_with_unseen_misspellings(spark):
    rows, labels = made(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in toxicity.reject(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    fresh = range(300, 400)
    assert sum((i in kept) == (i % 4 != 0) for i in fresh) >= 95


def test_odd_rows(spark):
    rows, labels = made(spark)
    odd = [(900, None, "", 0), (901, "", "", 0), (None, "wretched despicable wretched", "", 0), (902, "calm " * 50000, "", 0), (903, "x", "", 0)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    marks = spark.createDataFrame(labels + [(1, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    kept = toxicity.reject(docs, marks)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {900, 901, 902} <= ids
    assert toxicity.reject(docs.limit(0), marks).collect() == []
    assert toxicity.reject(docs, marks.where("toxic = 0")).count() == docs.count()


def test_a_document_beyond_the_bound_does_not_end_the_fit(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 20_000)
    rows, labels = made(spark)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for huge in (3, 4):  # a clean and a toxic one
        long = [(i, "aaa " * 30_000 + t if i == huge else t, k, n) for i, t, k, n in rows]
        assert toxicity.train(spark.createDataFrame(long, SCHEMA), marks) is not None
    # only one toxic document, longer than the bound
    few = [r for r in rows[:300] if r[0] % 4] + [(0, " ".join(["wretched calm"] * 20_000), "", 0)]
    assert toxicity.train(spark.createDataFrame(few, SCHEMA), marks) is not None
    keep = toxicity.within(np.array([90, 20, 30, 70, 10]), np.array([0, 0, 1, 1, 0]), 100)
    assert keep.tolist() == [1, 2, 4]


def test_ids_of_any_type_and_repeated_rows(spark):
    rows, labels = made(spark)
    docs = spark.createDataFrame([(f"id-{i}", *r) for i, *r in rows + rows[:50]], SCHEMA.replace("doc_id long", "doc_id string"))
    marks = spark.createDataFrame([(f"id-{i}", q, t) for i, q, t in labels], "doc_id string, quality int, toxic int")
    kept = {r.doc_id for r in toxicity.reject(docs, marks).collect()}
    assert sum((f"id-{i}" in kept) == (i % 4 != 0) for i in range(300, 400)) >= 95


def test_scores_against_plain_python():
    """The score of every text, word by word and gram by gram, without arrays."""
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.3, 0.0)
    texts = ["", "one", "Some words, some MORE words and yet a few more of them here", " é ü x " * 9]
    raw, offsets = toxicity._joined(texts)
    got = model.scores(raw, offsets)
    for text, score in zip(texts, got.tolist()):
        words = []
        for word in text.encode().split():
            flat, _ = toxicity.subwords(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
            marked = len(word) + 2
            assert len(flat) == 1 + sum(max(0, marked - k + 1) for k in toxicity.GRAMS)
            words.append(sum(model.weights[b] for b in flat) / len(flat))
        width = min(len(words), toxicity.WINDOW)
        want = max((sum(words[i : i + width]) / width for i in range(len(words) - width + 1)), default=-np.inf) + model.bias if words else -np.inf
        assert score == want or abs(score - want) < 1e-9


def test_equal_grams_share_a_bucket_wherever_they_stand():
    raw = np.frombuffer(b"abcdef xabcdefy", np.uint8)
    a, _ = toxicity.subwords(raw, np.array([0]), np.array([6]))
    b, _ = toxicity.subwords(raw, np.array([7]), np.array([15]))
    inner = {tuple(sorted(a.tolist())), tuple(sorted(b.tolist()))}
    assert len(inner) == 2 and len(set(a.tolist()) & set(b.tolist())) >= 10
