import numpy as np
import pyarrow as pa
import pytest

from geolith.llm import base, simhash

SCHEMA = "doc_id long, text string, key string, root long"


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    rows, families = [], {}
    for f in range(25):
        text = list(rng.choice(words, int(rng.integers(120, 300))))
        for c in range(1 + f % 4):
            copy = list(text)
            for at in rng.integers(0, len(copy), c):
                copy[at] = "changed"
            families[len(rows)] = f
            rows.append((len(rows), " ".join(copy), "clash", 0))
    return rows, families


def test_groups_against_brute_force(spark):
    rows, families = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    sigs = {r.id: (r.s0 % 2**64) | (r.s1 % 2**64) << 64 for r in simhash.signatures(docs).collect()}
    root = {i: i for i in sigs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sigs:
        for b in sigs:
            if a < b and (sigs[a] ^ sigs[b]).bit_count() <= simhash.RADIUS:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i: find(i) for i in sigs if find(i) != i}
    got = {r.doc_id: r.kept_doc_id for r in simhash.duplicates(docs).collect()}
    assert len(got.items() & want.items()) >= 0.9 * len(want)
    assert all(families[a] == families[b] for a, b in got.items())
    assert len(got) >= 0.9 * (len(rows) - 25)


def test_odd_rows(spark):
    rows, _ = corpus()
    same = rows[0][1]
    odd = [(500, same, "", 0), (501, same, "", 0), (502, None, "", 0), (503, None, "", 0), (None, same, "", 0), (504, "", "", 0), (505, " ", "", 0), (506, "one", "", 0), (507, "w " * 60000, "", 0), (0, same, "", 0)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    kept = simhash.dedup(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(0) == 1 and ids.count(None) == 1
    assert not {500, 501, 505} & set(ids) and {502, 503, 504, 506, 507} <= set(ids)
    assert simhash.dedup(docs.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    got = {r.node: r.root for r in base.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_batches_of_few_words(n):
    """A batch that holds so many words in all, in one text and in several."""
    words = [f"w{i}" for i in range(n)]
    for texts in ([" ".join(words)], words, ["", " ".join(words), None]):
        batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
        out = pa.Table.from_batches(simhash._signatures(iter([batch])))
        assert out.num_rows == sum(t is not None for t in texts)


def test_tiles_keep_every_pair(spark):
    rows, _ = corpus()
    rows += [(1000 + i, f"boiler plate that all share {i * 7919 % 613} " + " ".join(f"t{i}x{j}" for j in range(3)), "", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, simhash.groups(docs).collect()))
    assert sorted(map(tuple, simhash.groups(docs, tile=7).collect())) == want
    blocks = spark.createDataFrame([(1, i, i, i) for i in range(50)] + [(2, i, i, i) for i in range(4)], "key long, id long, s0 long, s1 long")
    held = {}
    for r in simhash.tiles(blocks, 8).collect():
        held.setdefault((r.key, r.tile), set()).add(r.id)
    pairs = {(k, a, b) for (k, _), ids in held.items() for a in ids for b in ids if a < b}
    assert pairs == {(1, a, b) for a in range(50) for b in range(a + 1, 50)} | {(2, a, b) for a in range(4) for b in range(a + 1, 4)}
    assert max(map(len, held.values())) < 40
