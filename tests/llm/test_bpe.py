import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from geolith.llm import bpe, textops

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder()


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


CASES = ["", "a", " a", "  a", "a  b\n\nc  ", "it's we'll 're'd 's's 'team '' 's x'll'x", "é ü   x　 y", "a" * 500, "ab" * 300, " " * 50, "\n" * 7 + "x", "1234 5 ½٣",
         "!!! ...'s", "日本語テスト 한국어", "don't'", "'", "x'", "'re", "'r", "'rex 're", " 're 's", "hello<|endoftext|>", "x" * 5000 + "!" * 700, "𝒳🙂\x00\x85z"]


@pytest.mark.parametrize("text", CASES)
def test_same_ids(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)
    assert encoder.decode(encoder.encode(text)) == text


def test_random_texts(encoder, reference):
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice("abst'rel vd  \n\t12é!.,日 ") for _ in range(rng.randint(0, 40)))
        assert encoder.encode(text) == reference.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


def test_long_and_short_programs_agree(encoder, reference):
    rng = random.Random(4)
    for n in (191, 192, 193, 400):
        text = "".join(rng.choice("therationg") for _ in range(n))
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_table(spark, reference):
    rows = [(1, "Some text, it's here", "x"), (2, "", "x"), (3, None, "x"), (None, "no id", "x"), (5, "word " * 40000, "x"), (1, "Some text, it's here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").selectExpr("*", "1 AS round_trip")
    out = bpe.encode(df)
    got = {(r.doc_id, r.n_tokens): r for r in out.collect()}
    assert out.count() == 6
    for doc, text, _ in rows:
        want = None if text is None else reference.encode_ordinary(text)
        r = got[doc, None if want is None else len(want)]
        assert r.ids == want and r.round_trip == (None if want is None else True)
    back = {(r.doc_id, r.text) for r in bpe.decode(out).collect()}
    assert back == {(d, t) for d, t, _ in rows}
    assert bpe.encode(df.limit(0)).count() == 0


def test_counts_take_sliced_arrays(encoder):
    texts = pa.array(["skip", None, "a b c", ""])[1:]
    assert bpe._count_batches(encoder)(texts).to_pylist() == [None, 3, 0]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_self_similar_pieces_are_told_apart(encoder, reference, n):
    """Thue-Morse words and their complements, for which polynomials modulo 2^64 collide."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    other = word.translate(str.maketrans("ab", "ba"))
    text = word + " " + other + " x " + other
    assert encoder.encode(text) == reference.encode_ordinary(text)
    raw = np.frombuffer((word + " " + other).encode(), np.uint8)
    a, b = textops.span_hash(raw, np.array([0, n + 1]), np.array([n, 2 * n + 1]))
    assert a != b and textops.span_hash(raw, np.array([n + 1]), np.array([2 * n + 1]))[0] == b


def test_the_cache_is_bounded_and_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    encoder = bpe.Encoder()
    for k in range(20):
        text = " ".join(f"word{k}x{i} again" for i in range(200)) + "z" * 300
        assert encoder.encode(text) == reference.encode_ordinary(text)
        assert encoder.held <= bpe.CACHE_BYTES
