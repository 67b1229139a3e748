"""SimHash near-duplicate search with bit-sliced comparison.

Each text gets a 128-bit SimHash of its two-word shingles (ASCII lower case).
Texts are brought together in blocks that share one of `KEYS` minwise-sampled
five-word shingles, and within a block every signature is compared with every
other by vertical bit planes (``bitslice``). The blocking is approximate (a pair
whose five-word shingles have Jaccard similarity s is met with probability
1 - (1 - s)^KEYS, over 0.97 at 0.3); the comparison is exact, without any cap.
A block passes on its components rather than its pairs, so a family of n copies
costs n edges, and components of those edges are the groups. A block of over `TILE`
members (a shingle that many texts share) becomes tiles that hold each pair of its
sub-blocks, so that its comparisons are spread over tasks and none is left out.

Defined results: a null text or null id is in no group; texts without words are
copies of each other; a shorter text than a shingle is one shingle; equal texts
are always grouped; rows that repeat an id are one document whose signature is
that of its least (signature) row, and `dedup` keeps that of the least text. Of equal
signatures and of a group the least id is kept. Ids are integers. Columns beside id
and text are not looked at, whatever their names; an empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import base, bitslice
from geolith.llm.textops import mix, ranges, span_hash, text_slices, word_spans

RADIUS = 28
KEYS = 10
FEATURE_WORDS = 2
KEY_WORDS = 5
WORDS = 2
TILE = 1 << 17

_SPREAD = np.zeros(256, dtype=np.uint64)
for _k in range(8):
    _SPREAD |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_k)) & np.uint64(1)) << np.uint64(8 * _k)


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, shingles per text) of k consecutive words; fewer words make one."""
    rank = ranges(counts)
    g = h * np.uint64(0x100000001B3)
    starts = np.cumsum(counts) - counts
    for j in range(1, min(k, len(g))):
        g[: len(g) - j] = g[: len(g) - j] * np.uint64(0x100000001B3) + h[j:]
    short = np.flatnonzero((counts > 0) & (counts < k))
    for c in range(1, k):
        rows = starts[short[counts[short] == c]]
        x = h[rows] * np.uint64(0x100000001B3)
        for j in range(1, c):
            x = x * np.uint64(0x100000001B3) + h[rows + j]
        g[rows] = x + np.uint64(c)
    many = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    return mix(g[rank < np.repeat(many, counts)]), many


def simhash(features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, WORDS) majority bits of the features; no features give zeros."""
    out = np.zeros((len(counts), WORDS), dtype=np.uint64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    n = counts[rows]
    runs = (n + 254) // 255
    run_start = np.repeat(np.cumsum(n) - n, runs) + ranges(runs) * 255
    row_start = np.cumsum(runs) - runs
    for w in range(WORDS):
        x = np.ascontiguousarray(mix(features + np.uint64(0x9E3779B97F4A7C15 * (w + 1) & 0xFFFFFFFFFFFFFFFF))).view(np.uint8).reshape(-1, 8)
        word = np.zeros(len(rows), dtype=np.uint64)
        for byte in range(8):
            lanes = np.add.reduceat(_SPREAD[x[:, byte]], run_start)
            sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), row_start, axis=0)
            bits = np.packbits(sums * 2 > n[:, None], axis=1, bitorder="little")[:, 0]
            word |= bits.astype(np.uint64) << np.uint64(8 * byte)
        out[rows, w] = word
    return out


def minima(features: np.ndarray, counts: np.ndarray, keys: int) -> np.ndarray:
    """(texts, keys) least seeded hash of each text's features, 0 without any."""
    out = np.zeros((len(counts), keys), dtype=np.uint64)
    rows = np.flatnonzero(counts)
    if len(rows):
        starts = (np.cumsum(counts) - counts)[rows]
        for k in range(keys):
            seed = np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)
            out[rows, k] = np.minimum.reduceat((features ^ seed) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1), starts)
            out[rows, k] = mix(out[rows, k] + np.uint64(k))
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for a, b, raw, offsets, valid in text_slices(batch.column(1)):
            starts, ends, counts = word_spans(raw, offsets)
            h = span_hash(raw, starts, ends, lower=True)
            sig = simhash(*shingles(h, counts, FEATURE_WORDS))
            keys = minima(*shingles(h, counts, KEY_WORDS), KEYS)
            flat = pa.array(base.signed(keys.reshape(-1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, KEYS, dtype=np.int32)), flat)
            out = pa.record_batch([ids.slice(a, b - a), pa.array(base.signed(sig[:, 0].copy())), pa.array(base.signed(sig[:, 1].copy())), lists], ["id", "s0", "s1", "keys"])
            yield out.filter(pa.array(valid))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, s0, s1, keys) of every text that is not null and has an id."""
    return base.pick(docs, id=id_col, text=text_col).where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(base.tidy(_signatures), "id long, s0 long, s1 long, keys array<long>")


def _block_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([np.asarray(c) for c in batch.columns], axis=1))
            if (held[-1][-1, :2] == held[0][0, :2]).all():
                continue  # one block goes on
            rows = np.concatenate(held)
            end = int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))[-1]) + 1
            held = [rows[end:]]
            yield from edges(rows[:end])
        if held:
            yield from edges(np.concatenate(held))

    def edges(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        counts = np.diff(np.r_[first, len(rows)])
        chosen = np.repeat(counts > 1, counts)
        rows, counts = rows[chosen], counts[counts > 1]
        if not len(rows):
            return
        sigs = np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
        roots = bitslice.block_roots(sigs, counts, radius)
        linked = roots != np.arange(len(roots))
        yield pa.record_batch([pa.array(rows[linked, 2]), pa.array(rows[roots[linked], 2])], ["a", "b"])

    return run


def tiles(blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """Blocks (key, id, s0, s1) with a tile each: (key, tile, id, s0, s1).

    A block of more than `tile` members is dealt to n sub-blocks, and each two of
    them (and each with itself, within the pairs) make a tile, so that no task
    holds a hot block and every pair of its members still meets in some tile.
    """
    sizes = blocks.groupBy("key").count().where(F.col("count") > tile)
    hot = cut_small(sizes)
    if hot is None:
        return blocks.select("key", F.lit(0).cast("long").alias("tile"), "id", "s0", "s1")
    n = (F.floor(F.col("count") / tile) + 1).cast("long")
    dealt = blocks.join(hot, "key").withColumn("n", n).withColumn("i", F.pmod(F.xxhash64("id"), F.col("n")))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).where("i <> j")
    low, high = F.least("i", "j"), F.greatest("i", "j")
    parts = dealt.select("key", (low * F.col("n") + high).alias("tile"), "id", "s0", "s1")
    return blocks.join(hot.select("key"), "key", "left_anti").select("key", F.lit(0).cast("long").alias("tile"), "id", "s0", "s1").union(parts)


def cut_small(df: DataFrame) -> DataFrame | None:
    """A checkpoint of a table that is mostly empty, None where it is."""
    found = base.cut(df)
    return None if found.isEmpty() else found


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(id, root) of every document that is in a group of two or more."""
    sigs = base.written(signatures(docs, id_col, text_col), "signatures")
    one = sigs.groupBy("id").agg(F.min(F.struct("s0", "s1", "keys")).alias("s")).select("id", "s.*")
    # equal signatures first: they need one representative in the search
    alike = one.groupBy("s0", "s1").agg(F.min(F.struct("id", "keys")).alias("m"), F.count("*").alias("n")).select("s0", "s1", F.col("m.id").alias("id"), F.col("m.keys").alias("keys"), "n")
    alike = base.written(alike, "signature-leaders")
    same = one.select("s0", "s1", F.col("id").alias("a")).join(alike.where("n > 1").select("s0", "s1", F.col("id").alias("b")), ["s0", "s1"]).where("a <> b").select("a", "b")
    blocks = alike.select(F.explode(F.array_distinct("keys")).alias("key"), "id", "s0", "s1")
    near = tiles(blocks, tile).repartition("key", "tile").sortWithinPartitions("key", "tile", "id").mapInArrow(base.tidy(_block_edges(radius)), "a long, b long")
    return base.components(same.union(near)).withColumnRenamed("node", "id")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, kept_doc_id, group_size): a row for each document to drop."""
    found = base.cut(groups(docs, id_col, text_col, radius))
    sizes = found.groupBy("root").agg(F.count("*").cast("long").alias("group_size"))
    return found.where("id <> root").join(sizes, "root").select(F.col("id").alias("doc_id"), F.col("root").alias("kept_doc_id"), "group_size")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Documents with one of each near-duplicate group kept, all columns as they were.

    Rows without id or text stay. Of rows that repeat an id, one stays.
    """
    dropped = duplicates(docs, id_col, text_col, radius).select(F.col("doc_id").alias("id"))
    return base.drop_ids(base.unique_ids(docs, id_col, text_col), dropped, id_col)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents and the document that is kept for each."""
    return duplicates(base.table(spark, sf_dir, "documents"))
