"""Cropped and edited copies of pictures, by local descriptors and geometry.

1. Corners: at each of `LEVELS` scales (each smaller by the root of two) a picture
   is smoothed, and every maximum of the Harris response within `APART` that reaches
   `CONTRAST` of the picture's greatest is a corner.
2. Descriptors: a corner's direction is that of the brightness centroid around it,
   in `TURNS` steps; `BITS` binary tests of pairs of points, turned with it, make
   its descriptor, which neither turning nor brighter or darker tones change. The
   pairs are chosen so that their outcomes are even and hardly correlated.
3. Hamming tables: each of `TABLES` tables keys a descriptor by `KEY` bits of its own,
   whatever the size of the input. All corners of one key are compared, however many
   they are; two alike within `RADIUS` are a vote for their pictures' pair, and a pair
   with `VOTES` is compared whole, all corners with all. So whether a pair is found
   depends on its two pictures alone, not on what else the table holds.
4. Consensus: a match implies a turn, a scale and a shift. Matches vote for cells of
   these, overlapping by half; two pictures are copies where one cell holds
   `INLIERS` different corners of both.

Pictures of equal bytes are told apart first: each is a copy of the least id among
them, which alone goes through the search. All corners of all pictures go into the
tables; which pairs of pictures they bring together is approximate, what is then said
of a pair is exact. Recall against comparing all corners is over 0.9 (the tests).

Pictures are binary PGM (P5, 8 bits). No table has any, so the query draws one for
each row of `embeddings` from its vector (`drawn`), and an edited copy of those
with an id of 1 modulo 4: a crop, a crop in other tones, a quarter turn, a smaller
one, or one with a caption and noise.

Defined results: a null, empty or malformed picture, one smaller than a descriptor
or with a side of over `MOST` pixels, and a plain one have no corners and are copies
of nothing, but for equal bytes; null ids are left out; rows that repeat an id are one
picture, that of the least digest; an empty table has no copies. Columns beside id and
image aren't looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import base

LEVELS = 3
TURNS = 32
BITS = 128
RADIUS = 20
TABLES, KEY, VOTES = 7, 18, 2
#: Bits of a key that make groups: a task holds the corners of one group at a time.
GROUP = 10
#: Corners that are sorted at once, whole groups of them; keys of up to FEW corners are compared together.
HELD, FEW = 1 << 17, 48
INLIERS = 6
CONTRAST = 0.02
CELL = 16
REACH, EDGE, APART = 8, 9, 3
SIDE = 80
#: The longest side whose quarter pixels fit into a place.
MOST = 1 << 21

_angle = 2 * np.pi * np.arange(TURNS) / TURNS
_turn = np.stack([np.stack([np.cos(_angle), -np.sin(_angle)], -1), np.stack([np.sin(_angle), np.cos(_angle)], -1)], 1)
_disc = np.array([(x, y) for y in range(-7, 8) for x in range(-7, 8) if x * x + y * y <= 49])


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A picture as binary PGM."""
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def decode_pgm(image: bytes | None) -> np.ndarray | None:
    """(height, width) tones, or None where it isn't an 8-bit binary PGM."""
    head = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d{1,9})\s+(\d{1,9})\s+(\d{1,5})\s", image or b"")
    if not head:
        return None
    width, height, top = map(int, head.groups())
    if not 0 < top < 256 or len(image) - head.end() < width * height or not width * height or max(width, height) > MOST:
        return None
    return np.frombuffer(image, np.uint8, width * height, head.end()).reshape(height, width)


def resized(stack: np.ndarray, factor: float) -> np.ndarray:
    """Pictures (n, h, w) at another scale, bilinear between pixel centres."""
    _, h, w = stack.shape
    out = []
    for size, axis in ((h, 1), (w, 2)):
        n = max(1, int(size * factor))
        at = np.clip((np.arange(n) + 0.5) / factor - 0.5, 0, size - 1)
        low = np.minimum(at.astype(int), max(size - 2, 0))
        part = (at - low).astype(np.float32).reshape((-1, 1) if axis == 1 else (1, -1))
        out.append((low, np.minimum(low + 1, size - 1), part))
    (y0, y1, fy), (x0, x1, fx) = out
    rows = stack[:, y0] * (1 - fy) + stack[:, y1] * fy
    return rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx


def _along(x: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    """A filter of odd length along both axes, edges repeated."""
    r = len(weights) // 2
    for axis in (1, 2):
        n = x.shape[axis]
        padded = np.take(x, np.clip(np.arange(-r, n + r), 0, n - 1), axis=axis)
        x = sum(w * np.take(padded, np.arange(k, k + n), axis=axis) for k, w in enumerate(weights))
    return x


def corners(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(picture, y, x) of the local maxima of the Harris response of smooth pictures."""
    gx, gy = np.zeros_like(stack), np.zeros_like(stack)
    gx[:, :, 1:-1] = stack[:, :, 2:] - stack[:, :, :-2]
    gy[:, 1:-1] = stack[:, 2:] - stack[:, :-2]
    a, b, c = (_along(x, (0.5, 1, 1, 1, 0.5)) for x in (gx * gx, gy * gy, gx * gy))
    r = a * b - c * c - 0.05 * (a + b) ** 2
    inner = r[:, EDGE:-EDGE, EDGE:-EDGE]
    best = inner > np.maximum(CONTRAST * r.max(axis=(1, 2)), 1.0)[:, None, None]
    h, w = r.shape[1:]
    around = range(-APART, APART + 1)
    for dy in around:
        for dx in around:
            other = r[:, EDGE + dy : h - EDGE + dy, EDGE + dx : w - EDGE + dx]
            if (dy, dx) < (0, 0):
                best &= inner > other
            elif (dy, dx) > (0, 0):
                best &= inner >= other
    n, y, x = np.nonzero(best)
    return n, y + EDGE, x + EDGE


def turned(pairs: np.ndarray) -> np.ndarray:
    """(turn, test, point, (x, y)) whole offsets of tests turned each way."""
    return np.rint(np.einsum("tij,bpj->tbpi", _turn, pairs)).astype(np.int64)


def directions(flat: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The turn of each place: where the centroid of brightness around it lies."""
    around = np.rint(flat[at[:, None] + (_disc[:, 1] * width + _disc[:, 0])[None]] * 4).astype(np.int32)
    # whole numbers, so that the sums don't depend on how many places there are
    y, x = around @ _disc[:, 1].astype(np.int32), around @ _disc[:, 0].astype(np.int32)
    return np.rint(np.arctan2(y, x) * (TURNS / (2 * np.pi))).astype(np.int64) % TURNS


def outcomes(flat: np.ndarray, at: np.ndarray, width: int, turn: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """(places, tests) whether the first point is darker, in quarter tones."""
    shift = tests[..., 1] * width + tests[..., 0]
    return np.rint(flat[at[:, None] + shift[turn, :, 0]] * 4) < np.rint(flat[at[:, None] + shift[turn, :, 1]] * 4)


@cache
def chosen_tests() -> np.ndarray:
    """BITS tests that come out evenly and hardly depend on each other on cloudy pictures, turned each way."""
    rng = np.random.default_rng(5)
    points = rng.uniform(-REACH, REACH, (4000, 2, 2))
    pairs = points[(np.hypot(points[..., 0], points[..., 1]) <= REACH).all(axis=1) & (np.abs(points[:, 0] - points[:, 1]).max(axis=1) >= 2)][:1200]
    stack = _along(np.stack([draw(rng.random(4)) for _ in range(40)]).astype(np.float32), (0.25, 0.5, 0.25))
    n, y, x = corners(stack)
    at = n * SIDE * SIDE + y * SIDE + x
    flat = stack.reshape(-1)
    bits = outcomes(flat, at, SIDE, directions(flat, at, SIDE), turned(pairs)).astype(np.float32)
    mean = bits.mean(axis=0)
    centred = (bits - mean) / np.maximum(bits.std(axis=0), 1e-6)
    together = np.abs(centred.T @ centred) / len(bits)
    order = np.argsort(np.abs(mean - 0.5), kind="stable")[: len(pairs) // 2]
    limit, kept = 0.1, []
    while len(kept) < BITS:
        kept = []
        for k in order:
            if len(kept) < BITS and (not kept or together[k, kept].max() < limit):
                kept.append(k)
        limit += 0.02
    # a test joins the key whose tests it depends on least, so that keys are spread out
    keys: list[list[int]] = [[] for _ in range(TABLES)]
    for k in kept[: TABLES * KEY]:
        _, best = min(((together[k, key] ** 2).sum(), at) for at, key in enumerate(keys) if len(key) < KEY)
        keys[best].append(k)
    return turned(pairs[np.concatenate([*keys, kept[TABLES * KEY :]])])


def described(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(picture, descriptors as (k, 2) words, places) of pictures of one size.

    A place packs x and y in quarter pixels of the full picture, turn and level.
    """
    found = [(np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))]
    for level in range(LEVELS):
        factor = 2 ** (-level / 2)
        small = stack.astype(np.float32) if not level else resized(stack.astype(np.float32), factor)
        if min(small.shape[1:]) <= 2 * EDGE:
            break
        smooth = _along(small, (0.25, 0.5, 0.25))
        n, y, x = corners(smooth)
        flat, width = smooth.reshape(-1), smooth.shape[2]
        place = n * smooth.shape[1] * width + y * width + x
        for a in range(0, len(n), 16384):
            at = place[a : a + 16384]
            turn = directions(flat, at, width)
            bits = outcomes(flat, at, width, turn, chosen_tests())
            words = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)
            sx, sy = (np.rint(((v[a : a + 16384] + 0.5) / factor - 0.5) * 4).astype(np.int64) for v in (x, y))
            found.append((n[a : a + 16384], words, (sx << 40) | (sy << 16) | (turn << 8) | level))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pictures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each picture: (id, digest, d0, d1, place), the last three as lists over its corners."""
    for batch in batches:
        ids, images = np.asarray(batch.column(0)), batch.column(1).to_pylist()
        shapes: dict[tuple[int, int] | None, list[tuple[int, np.ndarray | None]]] = {}
        for i, image in enumerate(images):
            pixels = decode_pgm(image)
            shapes.setdefault(None if pixels is None else pixels.shape, []).append((i, pixels))
        for shape, held in shapes.items():
            step = max(1, (1 << 20) // (shape[0] * shape[1])) if shape else len(held)
            for a in range(0, len(held), step):
                rows = [i for i, _ in held[a : a + step]]
                n, words, place = described(np.stack([p for _, p in held[a : a + step]])) if shape else (np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
                order = np.argsort(n, kind="stable")
                edge = pa.array(np.r_[0, np.cumsum(np.bincount(n, minlength=len(rows)))].astype(np.int32))
                lists = [pa.ListArray.from_arrays(edge, pa.array(np.ascontiguousarray(v[order]).view(np.int64))) for v in (words[:, 0], words[:, 1], place)]
                yield pa.record_batch([pa.array(ids[rows]), pa.array([hashlib.sha256(images[i]).digest() for i in rows], pa.binary()), *lists], ["id", "digest", "d0", "d1", "place"])


def pictures(images: DataFrame, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """(id, digest, d0, d1, place) of all pictures, with lists over their corners."""
    rows = base.pick(images, id=id_col, image=image_col).where("id IS NOT NULL AND image IS NOT NULL").select(F.col("id").cast("long").alias("id"), "image")
    return rows.mapInArrow(base.tidy(_pictures), "id long, digest binary, d0 array<long>, d1 array<long>, place array<long>")


def _key(words: np.ndarray, table: np.ndarray | int) -> np.ndarray:
    """The key of each descriptor in a table: bits KEY * table and on."""
    at = np.asarray(table, np.uint64) * np.uint64(KEY)
    low, rest = words[:, 0] >> np.minimum(at, 63), at % np.uint64(64)
    high = np.where(at < 64, np.where(rest > 0, words[:, 1] << (np.uint64(64) - np.maximum(rest, 1)), 0), words[:, 1] >> rest)
    return (np.where(at < 64, low, 0) | high).astype(np.int64) & ((1 << KEY) - 1)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, ids, words): the corners of a batch's pictures by table and first bits of the key."""
    for batch in batches:
        ids = np.repeat(np.asarray(batch.column(0)), np.asarray(batch.column(1).value_lengths()))
        words = np.stack([np.asarray(batch.column(c).flatten()).view(np.uint64) for c in (1, 2)], axis=1)
        for t in range(TABLES):
            group = _key(words, t) & ((1 << GROUP) - 1)
            order = np.argsort(group, kind="stable")
            group, mine, flat = group[order], ids[order].view(np.uint8).reshape(-1, 8), words[order]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
            edges = list(zip(first.tolist(), [*first[1:].tolist(), len(group)], strict=True))
            # ids go byte by byte, most of which are alike then and take no room in the shuffle
            rows = [pa.array([f(a, b) for a, b in edges], pa.binary()) for f in (lambda a, b, mine=mine: mine[a:b].T.tobytes(), lambda a, b, flat=flat: flat[a:b].tobytes())]
            yield pa.record_batch([pa.array(group[first] | t << GROUP), *rows], ["group", "ids", "words"])


def _near(keys: np.ndarray, ids: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of pictures, one for each two corners of one key that are alike within RADIUS; rows come by key and id."""
    w0, w1 = np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    sizes = np.diff(np.r_[first, len(keys)])
    found, n = [], 0

    def pairs() -> pa.RecordBatch:
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        there = ids[i] < ids[j]  # each two once, and none within a picture
        return pa.record_batch([pa.array(ids[i[there]]), pa.array(ids[j[there]])], ["a", "b"])

    def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = np.repeat(first + sizes, sizes) - np.arange(len(keys)) - 1
        i, step = np.flatnonzero((np.repeat(sizes, sizes) <= FEW) & (left > 0)), 1
        while len(i):
            at = i[np.bitwise_count(w0[i] ^ w0[i + step]) + np.bitwise_count(w1[i] ^ w1[i + step]) <= RADIUS]
            yield at, at + step
            step += 1
            i = i[left[i] >= step]
        for start, size in zip(first[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
            for a in range(start, start + size, 256):
                x = slice(a, min(a + 256, start + size))
                for b in range(a, start + size, 2048):
                    y = slice(b, min(b + 2048, start + size))
                    i, j = np.nonzero(np.bitwise_count(w0[x, None] ^ w0[None, y]) + np.bitwise_count(w1[x, None] ^ w1[None, y]) <= RADIUS)
                    yield i + a, j + b

    for i, j in near():
        if len(i):
            found.append((i, j))
            n += len(i)
        if n >= HELD:
            yield pairs()
            found, n = [], 0
    if found:
        yield pairs()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of pictures, one for each vote; rows (group, ids, words) come by group."""
    held: list[tuple[int, bytes, bytes]] = []
    n = 0

    def whole() -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64)[:, 0] for _, x, _ in held])
        words = np.frombuffer(b"".join(x for _, _, x in held), np.uint64).reshape(-1, 2)
        table = np.repeat([g >> GROUP for g, _, _ in held], [len(x) // 8 for _, x, _ in held])
        keys = _key(words, table) | table << KEY
        order = np.lexsort((ids, keys))
        yield from _near(keys[order], ids[order], words[order])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if n >= HELD and row[0] != held[-1][0]:
                yield from whole()
                held, n = [], 0
            held.append(row)
            n += len(row[1]) // 8
    if held:
        yield from whole()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All corners of the pictures a and b of each row that are alike within RADIUS, where they are enough for copies."""
    for batch in batches:
        lists = [(np.asarray(c.flatten()), np.r_[0, np.cumsum(np.asarray(c.value_lengths()))].tolist()) for c in batch.columns[2:]]
        lists = [(v if k % 3 == 2 else v.view(np.uint64), e) for k, (v, e) in enumerate(lists)]
        ids, found = np.stack([np.asarray(c) for c in batch.columns[:2]]), []
        for k in range(batch.num_rows):
            x0, x1, xp, y0, y1, yp = (values[edge[k] : edge[k + 1]] for values, edge in lists)
            mine = []
            for at in range(0, len(x0), 4096):
                part = slice(at, at + 4096)
                apart = np.bitwise_count(x0[part, None] ^ y0[None]) + np.bitwise_count(x1[part, None] ^ y1[None])
                i, j = np.nonzero(apart <= RADIUS)
                mine.append(np.stack([np.full(len(i), ids[0, k]), np.full(len(i), ids[1, k]), xp[i + at], yp[j]]))
            if sum(m.shape[1] for m in mine) >= INLIERS:
                found += mine
        if found:
            yield pa.record_batch([pa.array(r) for r in np.concatenate(found, axis=1)], ["a", "b", "pa", "pb"])


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def matches(found: DataFrame) -> DataFrame:
    """(a, b, pa, pb): corners alike within RADIUS of pictures that the tables bring together, a before b.

    found: (id, d0, d1, place) with lists over the corners, a row for each picture; it is read several times.
    Pictures with fewer than INLIERS of them are left out.
    """
    base.small_batches(found.sparkSession)
    keys = found.where(F.size("d0") > 0).select("id", "d0", "d1").mapInArrow(base.tidy(_grouped), "group long, ids binary, words binary")
    met = keys.repartition("group").sortWithinPartitions("group").mapInArrow(base.tidy(_met), "a long, b long")
    with _shuffles_removed(found.sparkSession):
        pairs = base.written(met.groupBy("a", "b").count().where(F.col("count") >= VOTES).select("a", "b"), "media-pairs")
    x, y = (found.select(F.col("id").alias(i), *[F.col(c).alias(f"{i}_{c}") for c in ("d0", "d1", "place")]) for i in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "a_d0", "a_d1", "a_place", "b_d0", "b_d1", "b_place")
    return both.mapInArrow(_compared, "a long, b long, pa long, pb long")


def _parts(place: str) -> tuple[Column, Column, Column, Column]:
    p = F.col(place)
    return F.shiftright(p, 40) / 4.0, F.shiftright(p, 16).bitwiseAND(0xFFFFFF) / 4.0, F.shiftright(p, 8).bitwiseAND(0xFF), p.bitwiseAND(0xFF)


def consensus(found: DataFrame) -> DataFrame:
    """(a, b, inliers) of pictures with a cell of at least INLIERS different corners of both."""
    xa, ya, ta, la = _parts("pa")
    xb, yb, tb, lb = _parts("pb")
    turn = F.pmod(tb - ta, F.lit(TURNS))
    angle = turn * (2 * np.pi / TURNS)
    scale = F.pow(F.lit(2.0), (lb - la) / 2.0)
    dx = xb - scale * (F.cos(angle) * xa - F.sin(angle) * ya)
    dy = yb - scale * (F.sin(angle) * xa + F.cos(angle) * ya)
    rows = found.select("a", "b", "pa", "pb", turn.alias("turn"), (lb - la).alias("zoom"), dx.alias("dx"), dy.alias("dy"))
    cells = [
        F.struct(F.floor(F.pmod(F.col("turn") + t, F.lit(TURNS)) / 2).alias("turn"), F.lit(t).alias("t"), F.floor((F.col("dx") + x * CELL / 2) / CELL).alias("x"), F.lit(x).alias("u"), F.floor((F.col("dy") + y * CELL / 2) / CELL).alias("y"), F.lit(y).alias("v"))
        for t in (0, 1) for x in (0, 1) for y in (0, 1)
    ]
    votes = rows.select("a", "b", "pa", "pb", "zoom", F.explode(F.array(*cells)).alias("cell"))
    counted = votes.groupBy("a", "b", "zoom", "cell").agg(F.least(F.size(F.collect_set("pa")), F.size(F.collect_set("pb"))).alias("n"))
    return counted.where(F.col("n") >= INLIERS).groupBy("a", "b").agg(F.max("n").cast("long").alias("inliers"))


def copies(images: DataFrame, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """(id_a, id_b, inliers): pairs of copies, id_a before id_b; inliers is null for equal bytes.

    The pictures are read once and aren't shuffled; what is, are their digests and
    descriptors.
    """
    with _shuffles_removed(images.sparkSession), base.scratch(images.sparkSession, lambda: known.join(one, "id")):  # the pictures themselves aren't needed behind it
        all_ = base.written(pictures(images, id_col, image_col), "media-pictures")
        digests = all_.groupBy("id").agg(F.min("digest").alias("digest"))
        # the least id of each digest, by a combinable aggregate rather than a window over a hot picture's copies
        least = digests.groupBy("digest").agg(F.min("id").alias("root"))
        known = base.written(digests.join(least, "digest"), "media-digests")
        roots = known.where("id = root").select("id", "digest")
        one = base.written(all_.join(roots, ["id", "digest"], "left_semi").dropDuplicates(["id"]).select("id", "d0", "d1", "place"), "media-descriptors")
    same = known.where("id <> root").select(F.col("root").alias("id_a"), F.col("id").alias("id_b"), F.lit(None).cast("long").alias("inliers"))
    near = consensus(matches(one)).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "inliers")
    return near.unionByName(same)


def draw(vector: np.ndarray) -> np.ndarray:
    """A picture of cloudy texture that a vector seeds, SIDE by SIDE."""
    rng = np.random.default_rng(np.ascontiguousarray(vector, np.float32).view(np.uint32))
    out = np.zeros((1, SIDE, SIDE), np.float32)
    for n, share in ((16, 0.7), (32, 1.0)):
        out += share * resized(rng.random((1, n, n), np.float32), SIDE / n)
    return np.rint((out[0] - out.min()) / (np.ptp(out) or 1) * 235 + 10).astype(np.uint8)


def edited(pixels: np.ndarray, seed: int) -> np.ndarray:
    """A crop, a crop in other tones, a quarter turn, a smaller one, or one with caption and noise."""
    rng = np.random.default_rng(seed)
    kind, (x, y) = seed % 5, rng.integers(2, 14, 2)
    if kind == 0:
        return pixels[y : y + 64, x : x + 64]
    if kind == 1:
        return np.clip(pixels[y : y + 60, x : x + 60] * 0.7 + 30, 0, 255).astype(np.uint8)
    if kind == 2:
        return np.rot90(pixels)
    if kind == 3:
        return np.rint(resized(pixels[None].astype(np.float32), 2**-0.5)[0]).astype(np.uint8)
    out = pixels + rng.integers(-2, 3, pixels.shape)
    out[-14:] = 255
    return np.clip(out, 0, 255).astype(np.uint8)


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            ids, images = [], []
            for i, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                picture = draw(np.nan_to_num(np.array(vector or [0.0], np.float64)))
                ids.append(2 * i)
                images.append(encode_pgm(picture))
                if i % 4 == 1:
                    ids.append(2 * i + 1)
                    images.append(encode_pgm(edited(picture, i // 4)))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], ["id", "image"])


def drawn(vectors: DataFrame) -> DataFrame:
    """(id, image): a picture 2 * vec_id for each row, and its edited copy 2 * vec_id + 1 for some."""
    return base.pick(vectors, id="vec_id", vector="embedding").where("id IS NOT NULL AND vector IS NOT NULL").mapInArrow(_draw, "id long, image binary")


def op5_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of copies among the pictures of the embeddings table."""
    return copies(drawn(base.table(spark, sf_dir, "embeddings")))
