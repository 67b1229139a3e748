import numpy as np

from geolith.llm import media

SCHEMA = "id long, image binary, place string, key long"


def pictures(spark, rows):
    return spark.createDataFrame([(i, image, "clash", 0) for i, image in rows], SCHEMA)


def family(n=12, seed=3):
    rng = np.random.default_rng(seed)
    rows, truth = [], set()
    for i in range(n):
        picture = media.draw(rng.random(8))
        rows.append((2 * i, media.encode_pgm(picture)))
        if i % 2:
            rows.append((2 * i + 1, media.encode_pgm(media.edited(picture, i // 2))))
            truth.add((2 * i, 2 * i + 1))
    return rows, truth


def brute_matches(rows):
    """All pairs of corners of different pictures within the radius, without tables."""
    found = []
    for i, image in rows:
        _, words, places = media.described(media.decode_pgm(image)[None])
        found += [(i, int(w[0]), int(w[1]), int(p)) for w, p in zip(words, places, strict=True)]
    return {(x[0], y[0], x[3], y[3]) for x in found for y in found if x[0] < y[0] and (x[1] ^ y[1]).bit_count() + (x[2] ^ y[2]).bit_count() <= media.RADIUS}


def test_copies_are_found_and_nothing_else(spark):
    rows, truth = family()
    got = media.copies(pictures(spark, rows)).collect()
    assert {(r.id_a, r.id_b) for r in got} == truth and all(r.inliers >= media.INLIERS for r in got)


def test_tables_against_brute_force(spark):
    rows, truth = family(6)
    want = brute_matches(rows)
    got = {tuple(r) for r in media.matches(media.pictures(pictures(spark, rows))).collect()}
    assert got <= want
    # what is compared is compared whole
    met = {(m[0], m[1]) for m in got}
    assert truth <= met and got == {m for m in want if (m[0], m[1]) in met}
    full = spark.createDataFrame(sorted(want), "a long, b long, pa long, pb long")
    reached = {(r.a, r.b) for r in media.consensus(full).collect()}
    found = {(r.id_a, r.id_b) for r in media.copies(pictures(spark, rows)).collect()}
    assert len(found & reached) >= 0.9 * len(reached) and truth <= found


def harder(picture, seed):
    """A picture between the fixed scales, one between the fixed turns, one under stronger noise."""
    rng = np.random.default_rng(seed)
    pixels = picture.astype(np.float32)
    angle = np.deg2rad(16.9)
    y, x = np.mgrid[: media.SIDE, : media.SIDE] - (media.SIDE - 1) / 2
    back = [np.clip(np.rint(v + (media.SIDE - 1) / 2), 0, media.SIDE - 1).astype(int) for v in (np.cos(angle) * y - np.sin(angle) * x, np.sin(angle) * y + np.cos(angle) * x)]
    return [np.rint(media.resized(pixels[None], 0.84)[0]), pixels[back[0], back[1]], np.clip(pixels + rng.integers(-12, 13, pixels.shape), 0, 255)]


def test_recall_of_harder_copies_against_brute_force(spark):
    """The keys, which are the same for any input, must find nine of ten pairs that the full comparison finds."""
    rng, rows = np.random.default_rng(11), []
    for i in range(12):
        picture = media.draw(rng.random(8))
        rows += [(4 * i + k, media.encode_pgm(p)) for k, p in enumerate([picture, *harder(picture, i)])]
    images = pictures(spark, rows)
    want = {(m[0], m[1]) for m in consensus_of(spark, brute_matches(rows))}
    found = {(r.id_a, r.id_b) for r in media.copies(images).collect()}
    assert len(want) >= 12 and found <= want and len(found) >= 0.9 * len(want)


def consensus_of(spark, rows):
    return [tuple(r) for r in media.consensus(spark.createDataFrame(sorted(rows), "a long, b long, pa long, pb long")).collect()]


def test_hot_keys_give_all_pairs():
    """Every two corners of a key that are alike are met, however many share it and wherever batches end."""
    rng = np.random.default_rng(2)
    sizes = (2, media.FEW, media.FEW + 1, 300, 2500)
    words = np.concatenate([np.repeat(rng.integers(0, 1 << 64, (1, 2), np.uint64), n, axis=0) for n in sizes])
    flips = rng.integers(0, 2, words.shape, np.uint64) << rng.integers(0, 64, words.shape, np.uint64)
    for _ in range(5):
        flips |= rng.integers(0, 2, words.shape, np.uint64) << rng.integers(0, 64, words.shape, np.uint64)
    words ^= flips
    ids = rng.integers(0, 2000, len(words))
    want = np.zeros(0, np.int64)
    for t in range(media.TABLES):
        keys = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, t * media.KEY : (t + 1) * media.KEY]
        for key in np.unique(keys, axis=0):
            k = np.flatnonzero((keys == key).all(axis=1))
            i, j = np.nonzero(np.bitwise_count(words[k][:, None] ^ words[k][None]).sum(axis=2) <= media.RADIUS)
            want = np.r_[want, (ids[k[i]] * 2000 + ids[k[j]])[ids[k[i]] < ids[k[j]]]]
    sent = []
    for a in range(0, len(words), 700):
        x = [media.pa.array(v) for v in (ids[a : a + 700], words[a : a + 700, :1].view(np.int64).tolist(), words[a : a + 700, 1:].view(np.int64).tolist())]
        sent += [r for b in media._grouped(iter([media.pa.record_batch(x, ["id", "d0", "d1"])])) for r in b.to_pylist()]
    sent.sort(key=lambda r: r["group"])
    assert len(want) > 1_000_000
    for step in (5, 1000):
        batches = (media.pa.RecordBatch.from_pylist(sent[a : a + step]) for a in range(0, len(sent), step))
        got = np.concatenate([np.asarray(b.column(0)) * 2000 + np.asarray(b.column(1)) for b in media._met(batches)])
        assert np.array_equal(np.sort(got), np.sort(want))


def test_a_pair_does_not_depend_on_what_else_the_table_holds(spark):
    """What is compared of some pictures is the same alone and among eight times as many others."""
    rng, rows = np.random.default_rng(23), []
    for i in range(12):
        picture = media.draw(rng.random(8))
        rows += [(4 * i + k, media.encode_pgm(p)) for k, p in enumerate([picture, *harder(picture, i)])]
    more = [(1000 + i, media.encode_pgm(media.draw(rng.random(8)))) for i in range(400)]
    alone, among = ({tuple(r) for r in media.matches(media.pictures(pictures(spark, x))).where("b < 1000").collect()} for x in (rows, rows + more))
    assert alone and alone == among


def shuffled(spark):
    """Bytes and records that the session's stages have written to shuffles so far."""
    gateway = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return np.array([(x.shuffleWriteBytes(), x.shuffleWriteRecords()) for x in (stages.apply(i) for i in range(stages.size()))]).reshape(-1, 2).sum(axis=0)


def test_unrelated_pictures_take_little_shuffle(spark):
    """Corners that only share a key don't become pairs of pictures; a descriptor has 24 bytes."""
    rng = np.random.default_rng(29)
    rows = [(i, media.encode_pgm(media.draw(rng.random(8)))) for i in range(1200)]
    count = sum(len(media.described(media.decode_pgm(image)[None])[0]) for _, image in rows)
    images = pictures(spark, rows)
    before = shuffled(spark)
    assert media.copies(images).collect() == []
    size, records = (shuffled(spark) - before) / count
    assert size < 170 and records < 2
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_places_of_tall_pictures():
    picture = media.draw(np.arange(4))
    tall = np.concatenate([np.full((17_000, media.SIDE), 7, np.uint8), picture])
    _, _, places = media.described(tall[None])
    assert ((places >> 16 & 0xFFFFFF) / 4).max() > 17_000 and ((places >> 40) / 4).max() < media.SIDE


def test_odd_pictures(spark):
    picture = media.encode_pgm(media.draw(np.arange(4)))
    plain = media.encode_pgm(np.full((80, 80), 7))
    rows = [(1, picture), (1, picture), (2, None), (3, b""), (4, b"P5 nonsense"), (5, media.encode_pgm(np.zeros((4, 4)))), (6, plain), (7, plain), (8, picture), (9, picture), (None, picture), (10, picture[:500]), (11, b"P5 0 0 255\n")]
    got = {(r.id_a, r.id_b, r.inliers) for r in media.copies(pictures(spark, rows)).collect()}
    assert got == {(1, 8, None), (1, 9, None), (6, 7, None)}


def test_empty(spark):
    assert media.copies(pictures(spark, [])).collect() == []
