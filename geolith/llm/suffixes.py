"""Suffix-array search for passages that repeat within or across documents.

A passage is a run of `MIN_WORDS` words. Of all places that hold the same run the
first, by (doc_id, word), is kept; every other place is a repeat, and overlapping
repeats of a document merge into spans.

1. Each shard (whole documents of one scan partition, up to `SHARD_WORDS` words,
   ordered by id, with a unique end mark behind each document) sorts its suffixes
   by Larsson-Sadakane refinement, takes the common prefixes of neighbours by
   Kasai's method, run in many lanes at once, and so finds the repeats inside the
   shard. What is left are passages that are first in their shard.
2. Every such passage is assigned its least `ANCHOR_WORDS`-word gram. Equal
   passages have equal grams, so only passages whose gram another place shares
   can repeat across shards; the grams, a fraction of the positions, are shuffled
   and counted.
3. Passages of shared grams are fingerprinted (64 bits) and each gram's runs of all
   shards are merged by binary search: a passage whose fingerprint stands earlier in
   the order is a repeat. A merge keeps one entry for each distinct passage of the
   gram and lets the rest pass by. The passages of a gram of more than `HOT` places
   (a line that many texts share) are dealt to tasks by their fingerprints.

Defined results: null texts and null ids are left alone, texts of fewer words
have no passages, repeats inside one document count, a run that repeats with a
short period keeps its first period, and of rows that repeat an id that of the least
text stays. Ids are integers. Of equal passages the first by (id, word) is kept.
A document may be of any length: it is one shard by itself. Columns beside id, text
and length are not looked at, whatever their names; an empty table has no repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.llm import base
from geolith.llm.textops import buffers, mix, powers, ranges, slices, span_hash, string_array, text_slices, word_spans

MIN_WORDS = 50
ANCHOR_WORDS = 25
SHARD_WORDS = 1_500_000
HOT = 1 << 16
LANES = 4096
STEP = 16


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) of tokens whose last one occurs nowhere else.

    Larsson-Sadakane: suffixes are sorted by their first tokens, then groups of
    more than one are sorted by the rank of the suffix `h` further on, with h
    doubling; groups that have become single are never touched again. The
    first sort takes as many tokens as fit into one integer.
    """
    n = len(tokens)
    base_, h, key = int(tokens.max()) + 2 if n else 2, 1, tokens.astype(np.int64) + 1
    first = key.copy()
    while h < min(4, n) and base_ ** (h + 1) < 1 << 62:
        key = key * base_
        key[: n - h] += first[h:]
        h += 1
    del first
    sa = np.argsort(key).astype(_places(n))
    key = key[sa]
    new = np.r_[True, key[1:] != key[:-1]]
    del key
    rank = np.empty(n, sa.dtype)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=sa.dtype), 0))
    while True:
        single = new & np.r_[new[1:], True]
        slots = np.flatnonzero(~single)
        if not len(slots):
            return sa, rank
        p = sa[slots]
        key = rank[p].astype(np.int64) * (n + 1) + rank[np.minimum(p + np.int64(h), n - 1)]
        order = np.argsort(key)
        p, key = p[order], key[order]
        sa[slots] = p
        starts = np.r_[True, key[1:] != key[:-1]]
        new[slots] = starts
        rank[p] = slots[np.maximum.accumulate(np.where(starts, np.arange(len(p)), 0))]
        h *= 2


def _places(n: int) -> type:
    """The integers that hold places of a shard of n tokens."""
    return np.int32 if n < 1 << 31 else np.int64


def common_prefixes(tokens: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[r] of the suffixes sa[r - 1] and sa[r], by Kasai's method.

    Positions are dealt to lanes; each lane walks its stretch of the text and
    carries the prefix over, less one, to the next position.
    """
    n = len(tokens)
    out = np.zeros(n, _places(n))
    lanes = max(1, min(LANES, n // 8))
    bounds = np.linspace(0, n, lanes + 1).astype(np.int64)
    at, stop = bounds[:-1].copy(), bounds[1:]
    h = np.zeros(lanes, np.int64)
    padded = np.r_[tokens, np.full(STEP, -1, tokens.dtype)]
    ahead = np.arange(STEP)
    live = np.flatnonzero(at < stop)
    while len(live):
        i, r, k = at[live], rank[at[live]], h[live]
        j = sa[np.maximum(r - 1, 0)]
        same = padded[(i + k)[:, None] + ahead] == padded[(j + k)[:, None] + ahead]
        m = np.where(same.all(axis=1), STEP, same.argmin(axis=1))
        m = np.where(r > 0, m, 0)
        k = np.where(r > 0, k + m, 0)
        done = m < STEP
        out[r[done]] = k[done]
        h[live] = np.where(done, np.maximum(k - 1, 0), k)
        at[live] += done
        live = live[at[live] < stop[live]]
    return out


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words for each start, without the last k - 1."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    p, q = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * p[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * q[: n - k + 1])


def least_grams(g: np.ndarray, width: int) -> np.ndarray:
    """Start of the least gram among each `width` consecutive ones, leftmost of equals."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(g) > 1 << 24:  # places are packed into 24 bits
        return np.concatenate([a + least_grams(g[a : a + (1 << 24)], width) for a in range(0, n, (1 << 24) - width + 1)])
    x = (g >> np.uint64(24) << np.uint64(24)) | np.arange(len(g), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return (np.minimum(x[:n], x[width - span : width - span + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def shard_repeats(h: np.ndarray, counts: np.ndarray, min_words: int) -> np.ndarray:
    """For each word position: the position of the first equal passage, or -1
    where no passage of min_words starts (too close to its document's end)."""
    n, docs = len(h), len(counts)
    kind = _places(n + docs)
    order = np.argsort(h)
    values = h[order]
    tokens = np.empty(n, kind)
    tokens[order] = np.cumsum(np.r_[False, values[1:] != values[:-1]], dtype=kind)
    known = int(tokens[order[-1]]) + 1
    del order, values
    ends = np.cumsum(counts)
    text = np.insert(tokens, ends, known + np.arange(docs))
    del tokens
    sa, rank = suffix_array(text)
    lcp = common_prefixes(text, sa, rank)
    del rank
    place = np.insert(np.arange(n, dtype=kind), ends, -1)
    starts = np.flatnonzero(np.r_[True, lcp[1:] < min_words])
    del lcp
    first = np.minimum.reduceat(sa, starts)
    out = np.empty(len(text), kind)
    out[sa] = place[np.repeat(first, np.diff(np.r_[starts, len(sa)]))]
    out = out[place >= 0].astype(np.int64)
    out[np.repeat(counts, counts) - ranges(counts) < min_words] = -1
    return out


def _shard(ids: np.ndarray, counts: np.ndarray, h: np.ndarray, min_words: int, anchor_words: int) -> pa.RecordBatch:
    """One row for each document of a shard: its anchors and its repeats."""
    n, docs = len(h), len(ids)
    doc = np.repeat(np.arange(docs), counts)
    offset = ranges(counts)
    first = shard_repeats(h, counts, min_words) if n else np.zeros(0, np.int64)
    leader = np.flatnonzero(first == np.arange(n))
    repeat = np.flatnonzero((first >= 0) & (first != np.arange(n)))
    width = min_words - anchor_words + 1
    g = gram_hash(h, anchor_words)
    anchor = least_grams(g, width)[leader] if len(leader) else leader
    new = np.r_[True, anchor[1:] != anchor[:-1]] if len(anchor) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    bit = np.int64(1) << (anchor - leader)
    masks = np.add.reduceat(bit, begin) if len(begin) else np.zeros(0, np.int64)
    anchor = anchor[begin]
    per_doc = np.bincount(doc[anchor], minlength=docs)
    # repeats whose starts and sources go on together make one interval
    source = first[repeat]
    if len(repeat):
        step = np.r_[True, (repeat[1:] != repeat[:-1] + 1) | (doc[repeat[1:]] != doc[repeat[:-1]]) | (doc[source[1:]] != doc[source[:-1]])]
        a = np.flatnonzero(step)
        z = np.r_[a[1:], len(repeat)] - 1
        s_doc, s_from, s_to, s_src = doc[repeat[a]], offset[repeat[a]], offset[repeat[z]] + min_words, ids[doc[source[a]]]
    else:
        s_doc = s_from = s_to = s_src = np.zeros(0, np.int64)
    spans = np.bincount(s_doc, minlength=docs)

    def lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.ascontiguousarray(values).astype(kind)))

    return pa.record_batch(
        [pa.array(ids), lists(g[anchor].view(np.int64), per_doc, np.int64), lists(offset[anchor], per_doc, np.int32), lists(masks, per_doc, np.int64),
         lists(s_from, spans, np.int32), lists(s_to, spans, np.int32), lists(s_src, spans, np.int64)],
        ["id", "grams", "places", "masks", "starts", "ends", "sources"],
    )


_SHARDS = "id long, grams array<long>, places array<int>, masks array<long>, starts array<int>, ends array<int>, sources array<long>"


def _shards(min_words: int, anchor_words: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        words = 0

        def flush() -> pa.RecordBatch:
            ids, counts, h = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(ids, kind="stable")
            begin = (np.cumsum(counts) - counts)[order]
            counts = counts[order]
            h = h[np.repeat(begin, counts) + ranges(counts)]
            return _shard(ids[order], counts, h, min_words, anchor_words)

        for batch in batches:
            ids = np.asarray(batch.column(0))
            for a, b, raw, offsets, _valid in text_slices(batch.column(1)):
                starts, ends, counts = word_spans(raw, offsets)
                if held and words + len(starts) > shard_words:
                    yield flush()
                    held.clear()
                    words = 0
                held.append((ids[a:b], counts, span_hash(raw, starts, ends)))
                words += len(starts)
        if held:
            yield flush()

    return run


def _fingerprints(min_words: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = string_array(batch.column(1))
            raw, offsets, _ = buffers(array)
            for a, b in slices(np.diff(offsets)):
                o = offsets[a : b + 1]
                piece = raw[o[0] : o[-1]]
                starts, ends, counts = word_spans(piece, o - o[0])
                f = gram_hash(span_hash(piece, starts, ends), min_words)
                anchors = batch.column(2).slice(a, b - a)
                sizes = np.asarray(anchors.value_lengths()).astype(np.int64)
                grams, places, masks, n = (np.asarray(anchors.flatten().field(k)) for k in range(4))
                ids = np.repeat(np.asarray(batch.column(0))[a:b], sizes)
                begin = np.repeat(np.cumsum(counts) - counts, sizes)
                row, shift = _passages(masks)
                values = f[begin[row] + places[row] - shift]
                # the passages of a hot gram are dealt by their fingerprints: equal ones stay together
                salt = (values % (1 + n[row] // hot).astype(np.uint64)).astype(np.int64)
                order = np.lexsort((-shift, salt, row))
                row, shift, values, salt = row[order], shift[order], values[order], salt[order]
                at = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (salt[1:] != salt[:-1])][: len(row)])
                sized = np.diff(np.r_[at, len(row)])
                bits = np.bitwise_or.reduceat(np.int64(1) << shift, at) if len(at) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sized)].astype(np.int32)), pa.array(values.view(np.int64)))
                of = row[at]
                yield pa.record_batch([pa.array(grams[of]), pa.array(salt[at]), pa.array(ids[of]), pa.array(places[of].astype(np.int32)), pa.array(bits), lists], ["gram", "salt", "id", "place", "mask", "prints"])

    return run


def _passages(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, words before the anchor) of the passages in the masks, the earliest start first."""
    row, col = np.nonzero((masks[:, None] >> np.arange(63)[None, ::-1]) & 1) if len(masks) else (np.zeros(0, np.int64),) * 2
    return row, 62 - col


class _Seen:
    """The first source of each fingerprint of a gram, in order of the fingerprints."""

    def __init__(self):
        self.prints, self.sources = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def sources_of(self, prints: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(repeats, their sources): those whose fingerprint came before, found by binary search; the rest is merged in."""
        at = np.minimum(np.searchsorted(self.prints, prints), max(len(self.prints) - 1, 0))
        known = self.prints[at] == prints if len(self.prints) else np.zeros(len(prints), bool)
        fresh = np.flatnonzero(~known)
        values, first, inverse = np.unique(prints[fresh], return_index=True, return_inverse=True)
        source = np.empty(len(prints), np.int64)
        source[known] = self.sources[at[known]]
        source[fresh] = ids[fresh][first][inverse]
        repeat = known.copy()
        repeat[fresh] = np.arange(len(fresh)) != first[inverse]
        if len(values):
            where = np.searchsorted(self.prints, values)
            self.prints = np.insert(self.prints, where, values)
            self.sources = np.insert(self.sources, where, ids[fresh][first])
        return np.flatnonzero(repeat), source


def _merge(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen = None, _Seen()
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, salts = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            new = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (salts[1:] != salts[:-1])])
            ends = np.r_[new[1:], len(grams)]
            lone = 0
            # a gram that goes on from the batch before meets what is kept of it; the others are merged together
            if group == (grams[0], salts[0]):
                yield from repeats(batch.slice(0, ends[0]), seen)
                lone = 1
            if lone < len(new):
                at = int(new[lone])
                body, last = batch.slice(at, int(new[-1]) - at), batch.slice(int(new[-1]))
                if body.num_rows:
                    yield from repeats(body, None)
                group, seen = (grams[-1], salts[-1]), _Seen()
                yield from repeats(last, seen)

    def repeats(t: pa.RecordBatch, seen: _Seen | None) -> Iterator[pa.RecordBatch]:
        ids, places, masks = (np.asarray(t.column(c)) for c in ("id", "place", "mask"))
        prints = np.asarray(t.column("prints").flatten())
        row, shift = _passages(masks)
        start = places[row] - shift
        if seen is None:  # whole grams; equal passages have equal grams
            ordered = np.argsort(prints, kind="stable")  # rows come by (gram, salt, id, place)
            first = np.empty(len(ordered), np.int64)
            first[ordered] = ordered[np.searchsorted(prints[ordered], prints[ordered], side="left")]
            at = np.flatnonzero(first != np.arange(len(first)))
            source = ids[row[first[at]]]
        else:
            at, source = seen.sources_of(prints, ids[row])
            source = source[at]
        if not len(at):
            return
        new = np.r_[True, (row[at][1:] != row[at][:-1]) | (start[at][1:] != start[at][:-1] + 1) | (source[1:] != source[:-1])]
        a = np.flatnonzero(new)
        z = np.r_[a[1:], len(at)] - 1
        yield pa.record_batch([pa.array(ids[row[at[a]]]), pa.array(start[at[a]].astype(np.int32)), pa.array((start[at[z]] + min_words).astype(np.int32)), pa.array(source[a])], ["id", "start", "end", "source"])

    return run


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping or touching spans of a document become one; rows come by (id, start)."""
    held: list[np.ndarray] = []

    def merged(rows: np.ndarray) -> pa.RecordBatch:
        new_doc = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
        group = np.cumsum(new_doc)
        far = np.maximum.accumulate(rows[:, 2] + group * (np.int64(1) << 32)) - group * (np.int64(1) << 32)
        new = new_doc.copy()
        new[1:] |= rows[1:, 1] > far[:-1]
        a = np.flatnonzero(new)
        z = np.r_[a[1:], len(rows)] - 1
        return pa.record_batch([pa.array(rows[a, 0]), pa.array(rows[a, 1]), pa.array(far[z]), pa.array(rows[a, 3])], ["id", "start", "end", "source"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1))
        if held[-1][-1, 0] == held[0][0, 0]:
            continue
        rows = np.concatenate(held)
        end = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1
        held = [rows[end:]]
        yield merged(rows[:end])
    if held:
        yield merged(np.concatenate(held))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(id, start, end, source): word spans of documents that repeat earlier passages.

    `source` is a document that holds the span's first passage earlier. Ids must
    be unique, as `base.unique_ids` makes them.
    """
    if min_words - anchor_words > 61:
        raise ValueError("an anchor must have at least min_words - 61 words")
    texts = base.pick(docs, id=id_col, text=text_col).where("id IS NOT NULL AND text IS NOT NULL")
    index = base.written(texts.mapInArrow(base.tidy(_shards(min_words, anchor_words, shard_words)), _SHARDS), "suffix-shards")
    inside = index.select("id", F.explode(F.arrays_zip("starts", "ends", "sources")).alias("s")).select("id", F.col("s.starts").alias("start"), F.col("s.ends").alias("end"), F.col("s.sources").alias("source"))
    anchors = index.select("id", F.explode(F.arrays_zip("grams", "places", "masks")).alias("s")).select(F.col("s.grams").alias("gram"), "id", F.col("s.places").alias("place"), F.col("s.masks").alias("mask"))
    # counted with partial sums, so that no task holds the places of a hot gram
    often = anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    shared = anchors.join(often, "gram").groupBy("id").agg(F.collect_list(F.struct("gram", "place", "mask", "n")).alias("anchors"))
    prints = texts.join(shared, "id").select("id", "text", "anchors").mapInArrow(base.tidy(_fingerprints(min_words, hot)), "gram long, salt long, id long, place int, mask long, prints array<long>")
    across = prints.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "id", "place").mapInArrow(base.tidy(_merge(min_words)), "id long, start int, end int, source long")
    return inside.union(across).repartition("id").sortWithinPartitions("id", "start", "end", "source").mapInArrow(_join_spans, "id long, start long, end long, source long")


def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts less the words of their spans; what stands between kept words stays. Null texts stay null."""
    raw, offsets, valid = buffers(string_array(texts.fill_null("")))
    starts, _, counts = word_spans(raw, offsets)
    first = np.cumsum(counts) - counts
    sizes = np.asarray(spans.value_lengths().fill_null(0)).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    marks = np.zeros(len(raw) + 1, np.int32)
    for name, sign in (("start", 1), ("end", -1)):
        word = np.asarray(spans.flatten().field(name)).astype(np.int64)
        inner = word < counts[row]
        at = offsets[row + 1].copy()
        at[inner] = starts[first[row[inner]] + word[inner]]
        np.add.at(marks, at, np.int32(sign))
    keep = np.cumsum(marks[:-1]) == 0
    edges = np.r_[0, np.cumsum(keep)][offsets]
    out = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw[keep])])
    return pc.if_else(texts.is_valid(), out, pa.scalar(None, pa.large_string())).cast(pa.string())


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without their repeated passages, all columns as they were.

    A repeated span goes with the white space behind it. The length column, if
    there is one, gets the new length. A document of which no word is left goes.
    Only texts with repeats pass through Python.
    """
    docs = base.unique_ids(docs, id_col, text_col)
    names = docs.columns
    key, text = f"_{base.place(docs, id_col)}", f"_{base.place(docs, text_col)}"
    spans = repeated_spans(docs, id_col, text_col, min_words).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    flat = base.columns_by_place(docs).join(spans, F.col(key) == F.col("id"), "left")
    # told to be nondeterministic, so that the filter behind it doesn't cut a second time
    without = F.arrow_udf(_without, T.StringType()).asNondeterministic()
    cut = F.col("spans").isNotNull()
    flat = flat.withColumn("cut_text", without(F.when(cut, F.col(text)), F.col("spans"))).withColumn("left_over", F.when(cut, F.col("cut_text")).otherwise(F.col(text)))
    flat = flat.where("spans IS NULL OR left_over RLIKE '[^ \\t-\\r]'")
    chars = f"_{base.place(docs, chars_col)}" if chars_col and any(n.lower() == chars_col.lower() for n in names) else None
    out = []
    for i in range(len(names)):
        c = f"_{i}"
        if c == text:
            out.append(F.col("left_over").alias(c))
        elif c == chars:
            out.append(F.when(cut, F.length("left_over").cast(flat.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return flat.select(*out).toDF(*names)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of at least 50 words that repeats an earlier passage, in words."""
    docs = base.unique_ids(base.table(spark, sf_dir, "documents"), "doc_id")
    found = repeated_spans(docs)
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("source").alias("kept_doc_id"))
