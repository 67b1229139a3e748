"""Best-fit packing of documents into sequences of several permitted lengths.

A document has its exact number of token ids and one more for the mark behind it.
What exceeds the greatest permitted length is cut off in full sequences of that
length first; the remainders are packed best fit, longest first: a remainder goes
to the open sequence with the least room that holds it. Where none does, one is
opened at the length of least cost (`cost`) for each id it will hold: of the
lengths that hold the remainder, each counts as full as the ids still to come can
make it. At the end every sequence shrinks to the least permitted length that
holds its contents.

Documents are dealt by a hash of their ids to shards of about `SHARD_DOCS`, each
packed by itself, so that the work is spread out; a shard leaves at most a few
sequences badly filled. Within a shard the order is (length descending, id), so
that the result doesn't depend on how the rows are partitioned.

Defined results: null texts and rows without id aren't packed; an empty text is
its end mark; rows that repeat an id are documents of their own, in the order of
their lengths; an empty table has no sequences. Columns beside id and text are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import base, bpe
from geolith.llm.textops import ranges

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_DOCS = 50_000
LAUNCH, ATTENTION = 64.0, 8192.0


def cost(capacity: int) -> float:
    """What a sequence costs: a launch, work in proportion, and attention by the square."""
    return LAUNCH + capacity + capacity * capacity / ATTENTION


class _Rooms:
    """Open sequences by their room; finds the least room of at least n, by a two-level bitmap."""

    def __init__(self, most: int):
        self.held: list[list[int]] = [[] for _ in range(most + 1)]
        self.words = [0] * (most // 60 + 1)
        self.top = 0

    def add(self, room: int, item: int) -> None:
        self.held[room].append(item)
        self.words[room // 60] |= 1 << room % 60
        self.top |= 1 << room // 60

    def take(self, n: int) -> tuple[int, int] | None:
        at = n // 60
        low = self.words[at] >> n % 60 << n % 60
        if not low:
            rest = self.top >> (at + 1) << (at + 1)
            if not rest:
                return None
            at = (rest & -rest).bit_length() - 1
            low = self.words[at]
        room = at * 60 + (low & -low).bit_length() - 1
        stack = self.held[room]
        item = stack.pop()
        if not stack:
            self.words[at] &= ~(1 << room % 60)
            if not self.words[at]:
                self.top &= ~(1 << at)
        return room, item


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray]:
    """(sequence of each remainder, its start there); lengths descend, none exceeds the greatest capacity."""
    capacities = tuple(sorted(capacities))
    costs = [cost(c) for c in capacities]
    rooms = _Rooms(capacities[-1])
    left = int(lengths.sum())
    bins, starts, size = [], [], []
    for n in lengths.tolist():
        found = rooms.take(n)
        if found is None:
            # a sequence can't be fuller than what is still to come makes it
            _, capacity = min((k / min(c, left), c) for c, k in zip(capacities, costs, strict=True) if c >= n)
            found = capacity, len(size)
            size.append(capacity)
        room, b = found
        bins.append(b)
        starts.append(size[b] - room)
        if room > n:
            rooms.add(room - n, b)
        left -= n
    return np.array(bins, np.int64), np.array(starts, np.int64)


def pack_shard(ids: np.ndarray, lengths: np.ndarray, capacities: tuple[int, ...]) -> dict[str, np.ndarray]:
    """All sequences of a shard: parts (bin, doc, from, n) in order, used and capacity of each bin."""
    most = max(capacities)
    order = np.lexsort((lengths, ids))
    ids, lengths = ids[order], lengths[order]
    full, rest = lengths // most, lengths % most
    doc = np.repeat(np.arange(len(ids)), full)
    whole_from = ranges(full) * most
    order = np.lexsort((lengths, ids, -rest))
    order = order[rest[order] > 0]
    bins, starts = best_fit(rest[order], capacities)
    part_bin = np.r_[np.arange(len(doc)), bins + len(doc)]
    part_doc = np.r_[doc, order]
    part_from = np.r_[whole_from, (full * most)[order]]
    part_n = np.r_[np.full(len(doc), most), rest[order]]
    at = np.lexsort((np.r_[np.zeros(len(doc), np.int64), starts], part_bin))
    count = np.bincount(part_bin) if len(part_bin) else np.zeros(0, np.int64)
    used = np.bincount(part_bin, part_n).astype(np.int64) if len(part_bin) else np.zeros(0, np.int64)
    allowed = np.sort(np.array(capacities))
    return {"doc_ids": ids[part_doc[at]], "from_token": part_from[at], "n_tokens": part_n[at], "count": count, "used": used, "capacity": allowed[np.searchsorted(allowed, used)]}


def _pack(capacities: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([np.asarray(c) for c in batch.columns], axis=1))
            if held[-1][-1, 0] == held[0][0, 0]:
                continue  # one shard goes on
            rows = np.concatenate(held)
            end = int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1
            held = [rows[end:]]
            yield from shards(rows[:end])
        if held:
            yield from shards(np.concatenate(held))

    def shards(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
            p = pack_shard(part[:, 1], part[:, 2], capacities)
            n = len(p["count"])
            edge = pa.array(np.r_[0, np.cumsum(p["count"])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(edge, pa.array(p[c])) for c in ("doc_ids", "from_token", "n_tokens")]
            yield pa.record_batch([pa.array(np.full(n, part[0, 0])), pa.array(np.arange(n)), pa.array(p["capacity"]), pa.array(p["used"]), *lists], ["shard", "bin", "capacity", "used", "doc_ids", "from_token", "n_tokens"])

    return run


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Sequences of (id, n) rows: (shard, bin, capacity, used, doc_ids, from_token, n_tokens).

    n is the number of ids with the end mark. lengths is read twice.
    """
    known = lengths.where("id IS NOT NULL AND n > 0")
    shards = max(1, -(-known.count() // shard_docs))
    rows = known.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.col("id").cast("long"), F.col("n").cast("long"))
    parts = min(shards, 4 * int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_pack(capacities), "shard long, bin long, capacity long, used long, doc_ids array<long>, from_token array<long>, n_tokens array<long>")


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n): exact token counts and one for the end mark, written once."""
    texts = base.pick(docs, id=id_col, text=text_col).where("id IS NOT NULL AND text IS NOT NULL")
    return base.written(bpe.with_counts(texts, "text", "ids").select("id", (F.col("ids") + 1).alias("n")), "token-lengths")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """The packed sequences of a table of documents."""
    return pack(token_lengths(docs, id_col, text_col), capacities)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed sequences of 512 to 4096 ids."""
    return pack_documents(base.table(spark, sf_dir, "documents"))
