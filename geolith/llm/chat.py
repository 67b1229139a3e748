"""Chat formatting by splicing ids: control ids are never made from text.

Each turn of a conversation is one segment of ordinary text, encoded by itself.
Around it come reserved ids beyond the vocabulary (`reserved`): begin, the id of its
role, its ids, end. A control string in a turn's text can't become a control id, as
segments are only ever encoded as plain text; so that it can't be taken for one
in a printed transcript either, it is escaped: a control string `<|name|>`, and
any that stands escaped already, gets one more backslash behind its `<`
(`unescape` takes it off again, so that every text comes back exactly).

The mask of trained ids is a running sum of marks: +1 where an assistant's
content begins, -1 behind its end.

Defined results: turns are in the order of (turn, role, text), nulls first; a
null text is an empty segment; a null or unknown role is `other`; rows without
conversation id belong to no conversation and are left out; a row that repeats is
a turn of its own; an empty table has no conversations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import base, bpe
from geolith.llm.textops import text_slices

ROLES = ("system", "user", "assistant", "tool", "other")
TRAINED = "assistant"
CONTROL = ("begin", "end", *ROLES)
_CONTROL = rf"<(\\*)\|({'|'.join(CONTROL)})\|>"


def reserved(encoder: bpe.Encoder) -> dict[str, int]:
    """The id of each control: behind the vocabulary's ids, whose own end mark keeps the first one."""
    return {name: encoder.size + 1 + i for i, name in enumerate(CONTROL)}


def escape(text: str) -> str:
    """The text with a backslash in each control string."""
    return re.sub(_CONTROL, r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    """What `escape` was given."""
    return re.sub(rf"<\\(\\*)\|({'|'.join(CONTROL)})\|>", r"<\1|\2|>", text)


def escape_array(texts: pa.Array) -> pa.Array:
    """`escape` of a column."""
    return pc.replace_substring_regex(texts, _CONTROL, r"<\\\1|\2|>")


def assemble(encoder: bpe.Encoder, roles: list[str | None], texts: pa.Array, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids, flat mask, ids per conversation) of conversations with so many turns each."""
    control = reserved(encoder)
    known = [r if r in ROLES else "other" for r in roles]
    role = np.array([control[r] for r in known], np.int32)
    trained = np.array([r == TRAINED for r in known])
    parts, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for _a, _b, raw, offsets, _valid in text_slices(escape_array(pc.fill_null(texts, ""))):
        ids, n = encoder.encode_rows(raw, offsets)
        parts.append(ids)
        counts.append(n)
    content, n = np.concatenate(parts), np.concatenate(counts)
    size = n + 3
    stop = np.cumsum(size)
    start = stop - size
    out = np.empty(int(size.sum()), np.int32)
    inside = np.ones(len(out), bool)
    inside[start] = inside[start + 1] = inside[stop - 1] = False
    out[inside] = content
    out[start], out[start + 1], out[stop - 1] = control["begin"], role, control["end"]
    marks = np.zeros(len(out) + 1, np.int32)
    marks[start[trained] + 2] += 1
    marks[stop[trained]] -= 1
    mask = np.cumsum(marks[:-1]).astype(np.int8)
    edge = np.r_[0, stop][np.r_[0, np.cumsum(turns)]]
    return out, mask, np.diff(edge)


def _format(encoder: bpe.Encoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_ = bpe.resident(encoder)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = np.asarray(batch.column(0))
            if held and held[-1].column(0)[-1].as_py() != conv[0]:
                yield made(encoder_, held)
                held = []
            other = np.flatnonzero(conv != conv[-1])
            end = int(other[-1]) + 1 if len(other) else 0
            if end:
                yield made(encoder_, [*held, batch.slice(0, end)])
                held = []
            held.append(batch.slice(end))
        if held:
            yield made(encoder_, held)

    def made(encoder_: bpe.Encoder, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        conv = np.asarray(t["conv"])
        first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        turns = np.diff(np.r_[first, len(conv)])
        texts = t["text"].combine_chunks() if t.num_rows else pa.array([], pa.string())
        ids, mask, sizes = assemble(encoder_, t["role"].to_pylist(), texts, turns)
        edge = np.r_[0, np.cumsum(sizes)]
        trained = np.r_[0, np.cumsum(mask, dtype=np.int64)][edge]
        lists = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(x)) for x in (ids, mask)]
        return pa.record_batch([pa.array(conv[first]), pa.array(turns.astype(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(np.diff(trained)), *lists], ["conv_id", "n_turns", "n_tokens", "n_trained", "ids", "mask"])

    return run


def format_conversations(turns: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(conv_id, n_turns, n_tokens, n_trained, ids, mask): one row for each conversation.

    The turns are shuffled once by conversation, without any join; a conversation
    has to fit into an executor's memory.
    """
    rows = base.pick(turns, conv="conv_id", turn="turn", role="role", text="text").where("conv IS NOT NULL").select(F.col("conv").cast("long").alias("conv"), "turn", "role", "text")
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return ordered.mapInArrow(_format(bpe.Encoder(vocabulary)), "conv_id long, n_turns long, n_tokens long, n_trained long, ids array<int>, mask array<tinyint>")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as ids with the mask of those that are trained on."""
    return format_conversations(base.table(spark, sf_dir, "conversations"))
