import numpy as np

from geolith.llm import bpe, packing


def brute(lengths, capacities):
    """Best fit by looking at every open sequence, of equal rooms that filled last: the parts (start, length) of each."""
    sizes, rooms, parts, last, left = [], [], [], [], sum(lengths)
    for step, n in enumerate(lengths):
        fits = [(r, -last[k], k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            at = min(fits)[2]
        else:
            _, size = min((packing.cost(c) / min(c, left), c) for c in capacities if c >= n)
            at = len(rooms)
            rooms.append(size)
            sizes.append(size)
            parts.append([])
            last.append(step)
        parts[at].append((sizes[at] - rooms[at], n))
        rooms[at] -= n
        last[at] = step
        left -= n
    return parts


def test_best_fit_against_brute_force():
    rng = np.random.default_rng(2)
    for size in (0, 1, 5, 300):
        lengths = np.sort(rng.integers(1, 4096, size))[::-1]
        bins, starts = packing.best_fit(lengths)
        got = {}
        for b, s, n in zip(bins.tolist(), starts.tolist(), lengths.tolist()):
            got.setdefault(b, []).append((s, n))
        assert [got[b] for b in range(len(got))] == brute(lengths.tolist(), packing.CAPACITIES)


SCHEMA = "doc_id long, text string, n long, bin string"


def test_every_id_is_packed_once(spark):
    rows = [(i, "word " * (i * 37 % 3000), 0, "clash") for i in range(120)] + [(200, None, 0, ""), (201, "", 0, ""), (None, "lost", 0, ""), (5, "again", 0, ""), (202, "long " * 30000, 0, "")]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    encoder = bpe.Encoder()
    want = sorted((i, len(encoder.encode(t)) + 1) for i, t, _, _ in rows if i is not None and t is not None)
    spans = sorted((d, f, n) for r in got for d, f, n in zip(r.doc_ids, r.from_token, r.n_tokens))
    assert sorted(n for _, _, n in spans if n) and sum(n for _, _, n in spans) == sum(n for _, n in want)
    assert {d for d, _, _ in spans} == {i for i, _ in want}
    for d, n in want:
        if d != 5:
            at = 0
            for _, f, k in (s for s in spans if s[0] == d):
                assert f == at
                at += k
            assert at == n
    for r in got:
        assert r.used == sum(r.n_tokens) <= r.capacity and r.capacity == min(c for c in packing.CAPACITIES if c >= r.used)
    assert sum(r.used for r in got) / sum(r.capacity for r in got) > 0.95


def test_partitioning_changes_nothing(spark):
    lengths = spark.createDataFrame([(i, i * 91 % 5000 + 1) for i in range(400)], "id long, n long")
    a, b = (sorted(map(str, packing.pack(x, shard_docs=100).collect())) for x in (lengths, lengths.repartition(7).orderBy("n")))
    assert a == b and packing.pack(lengths.limit(0)).collect() == []
