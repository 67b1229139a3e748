from fractions import Fraction
from math import comb

import numpy as np

from geolith.llm import quality

SCHEMA = "doc_id long, text string, lang string, measure string"


def brute(text):
    """The rules' values of one text, by plain Python."""
    words = (text or "").split()
    if not words:
        return [quality.EMPTY] * len(quality.RULES)
    chars = [c for c in text if c not in " \t\n\r\v\f"]
    letters = [c for c in text if c.isascii() and c.isalpha()]
    lines = [x for x in text.split("\n") if x]
    low = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    parts = [
        (sum(c in "#$%&*|!~^=<>{}[]\\_@+/" for c in text), len(chars)), (sum(c.isupper() for c in letters), len(letters)),
        (sum(a == b for a, b in zip(low, low[1:])), len(words)), (sum(c.isascii() and c.isdigit() for c in text), len(chars)),
        (len(lines) - len(set(lines)), len(lines)), (len(chars), 64 * len(words)),
    ]
    return [min(-(-a * 1000 // max(b, 1)), 1000) for a, b in parts]


TEXTS = ["plain words here", "LOUD!! LOUD!! *** ###", "", None, " \n ", "a a a A b", "x\nx\nx\ny", "é12 ñ34 " * 3000, "one\n\none"]


def test_measures_against_brute_force(spark):
    df = quality.measured(spark.createDataFrame([(t,) for t in TEXTS], "text string"), "text")
    assert [list(r.measure) for r in df.collect()] == [brute(t) for t in TEXTS]


def test_certificate_is_the_exact_tail():
    for n, k in ((10, 0), (90, 0), (100, 1), (200, 3), (500, 12)):
        p = Fraction(1, 20)
        tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        for error in (0.05, 0.01, 0.001):
            assert quality.certified(k, n, 0.05, error) == (tail <= Fraction(error))
    assert not quality.certified(0, 0, 0.05, 0.05)


def documents(spark, n=900):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [("".join(rng.choice(list("abcdef"), 4)) + ("***" if bad else "")) for _ in range(30)]
        rows.append((i, " ".join(words), ("en", None)[i % 2], "clash"))
        if i % 3:
            labels.append((i, int(not bad), 0))
    rows += [(n, None, "en", ""), (n + 1, "", "xx", ""), (None, "*** ### $$$", "en", ""), (n + 2, "fine words", "xx", ""), (0, rows[0][1], "en", "")]
    labels += [(1, 0, 0), (None, 1, 0), (2, None, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rejects_bad_and_keeps_good(spark):
    docs, labels = documents(spark)
    kept = quality.reject(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in range(900) if i % 5} <= set(ids) and not {i for i in range(900) if i % 5 == 0} & set(ids)
    assert 900 not in ids and None not in ids and {901, 902} <= set(ids)  # stratum xx has no certificate


def test_certified_limit_holds_on_the_held_out_half(spark):
    docs, labels = documents(spark)
    values = quality._values(docs, "doc_id", "text", "lang")
    cuts = quality.cutoffs(values, labels)
    assert set(cuts) == {"en", None}
    held = [r for r in quality._labelled(values, labels).collect() if r.held and r.good == 1]
    for stratum, limits in cuts.items():
        mine = [r for r in held if r.stratum == stratum]
        wrong = sum(any(r[rule] > c for rule, c in zip(quality.RULES, limits)) for r in mine)
        assert quality.certified(wrong, len(mine), quality.MAX_FALSE, quality.ERROR / len(cuts))


def test_empty(spark):
    docs, labels = documents(spark, 10)
    assert quality.reject(docs.limit(0), labels).collect() == []
    assert quality.reject(docs, labels.limit(0)).count() == docs.count()
