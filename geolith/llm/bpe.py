"""Exact byte-level BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece there is exactly one token that its BPE encoding ends
in. It is the longest vocabulary token that ends the prefix and that is
compatible with the unique last token of what stands before it: the two encode,
side by side, to themselves. The matches come from a suffix automaton (a trie of
the vocabulary whose states know their longest proper suffix, and whose tokens
know the next shorter token that ends them); compatibility is tested by undoing
merges. Back-pointers from the end give the ids. Pieces are told apart by the
vocabulary's own splitting pattern, whose rules are worked out here on arrays of
code points, and the distinct pieces of a slice, told apart by their bytes, go
through the program together.

The vocabulary is a file of base64 tokens with ranks; its path is a parameter.

Defined results: a null text has null ids and counts, an empty text none; text is
never cut, however long; rows without id keep their null; a row that repeats is
encoded as often as it comes; there are no ties, as every text has one encoding;
columns beside id and text are not looked at, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import base
from geolith.llm.textops import ranges, text_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG_PIECE = 192
CACHE_BYTES = 16 << 20
CELLS = 1 << 21
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    """The class of each code point in the splitting pattern."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts, pieces per row) that the splitting pattern finds in UTF-8 rows.

    Letters, numbers and other signs make runs that take one blank before them;
    white space before a run's blank is a piece; a run of white space leaves its
    last sign for what follows; and an apostrophe with s, t, m, d, re, ve or ll
    is a piece where a piece starts.
    """
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(rows, np.int64)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    c = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(c)
    kind = _classes()[c]
    edge = np.searchsorted(at, offsets)
    row_start = np.zeros(n + 1, bool)
    row_start[edge[:-1]] = True
    row_start[n] = True
    first = row_start[:n].copy()
    first[1:] |= kind[1:] != kind[:-1]
    starts = first.copy()
    white = kind == SPACE
    ends = np.r_[first[1:], True]
    # the last white sign of a run is a piece or the head of one, if more text follows
    last = white & ends & ~row_start[1:]
    starts |= last
    joined = np.flatnonzero(last & (c == 32)) + 1
    starts[joined] = False
    quote = np.flatnonzero((c == 39) & first & starts & ends & ~row_start[1:])
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        a = c[quote + 1]
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        inside = np.minimum(quote + 2, n - 1)
        b = np.where(row_start[np.minimum(quote + 2, n)], 0, c[inside])
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        hit = one | two
        starts[quote[hit] + 1] = False
        after = (quote + np.where(one, 2, 3))[hit]
        starts[after[after < n]] = True
    found = np.flatnonzero(starts)
    return at[found], np.diff(np.searchsorted(found, edge))


class Table:
    """A fixed map from non-negative integers to int32, probed in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            s = slot[left]
            free = self.keys[s] == -1
            self.keys[s[free]] = keys[left[free]]
            mine = self.keys[s] == keys[left]
            self.values[s[mine]] = values[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 for those that aren't there."""
        s = self._slot(keys)
        have = self.keys[s]
        out = np.where(have == keys, self.values[s], np.int32(-1))
        left = np.flatnonzero((have != keys) & (have != -1))
        while len(left):
            s[left] = (s[left] + 1) & self.mask
            have = self.keys[s[left]]
            hit = have == keys[left]
            out[left[hit]] = self.values[s[left[hit]]]
            left = left[~hit & (have != -1)]
        return out


class Encoder:
    """A byte-level vocabulary whose ids are its merge ranks."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        size = max(ranks.values()) + 1
        self.size = size
        self.lengths = np.zeros(size, np.int64)
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
            self.lengths[rank] = len(token)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.r_[0, np.cumsum(self.lengths)]
        self.split = np.full((size, 2), -1, np.int64)
        for token, rank in ranks.items():
            self.split[rank] = _parts(token, ranks) if len(token) > 1 else (rank, rank)
        two = np.flatnonzero(self.lengths > 1)
        self.pairs = Table(self.split[two, 0] * size + self.split[two, 1], two.astype(np.int32))
        self._automaton(tokens)
        self._clear()

    def _automaton(self, tokens: list[bytes]) -> None:
        """The trie of all tokens with suffix links, breadth first."""
        children: list[dict[int, int]] = [{}]
        token_at = [-1]
        for rank, token in enumerate(tokens):
            state = 0
            for byte in token:
                state = children[state].setdefault(byte, len(children))
                if state == len(children):
                    children.append({})
                    token_at.append(-1)
            if token:
                token_at[state] = rank
        fail, longest = [0] * len(children), [-1] * len(children)
        shorter = np.full(len(tokens), -1, np.int64)
        order = list(children[0].values())
        for state in order:
            longest[state] = token_at[state]
        for state in order:  # grows while it is read
            for byte, child in children[state].items():
                up = fail[state]
                while up and byte not in children[up]:
                    up = fail[up]
                fail[child] = children[up].get(byte, 0)
                own = token_at[child]
                if own >= 0:
                    shorter[own] = longest[fail[child]]
                longest[child] = own if own >= 0 else longest[fail[child]]
                order.append(child)
        self.fail, self.longest, self.shorter = np.array(fail), np.array(longest), shorter
        keys = np.array([s * 256 + b for s, kids in enumerate(children) for b in kids])
        values = np.array([k for kids in children for k in kids.values()], dtype=np.int32)
        self.edges = Table(keys, values)

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.cached_ids, self.cached_counts, self.cached_starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __getstate__(self):
        state = dict(self.__dict__)
        for name in ("known", "held", "cached_ids", "cached_counts", "cached_starts"):
            state.pop(name)
        return state

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._clear()

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b, side by side, are the encoding of their bytes.

        The merges are undone from the latest back: as long as no merge across
        the boundary has a lower rank than the one undone last, the boundary
        stands.
        """
        out = np.ones(len(a), bool)
        left = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.int64(1) << 40)
        while len(left):
            merged = self.pairs.get(a * self.size + b)
            bad = (merged >= 0) & (merged < limit)
            out[left[bad]] = False
            one_a, one_b = self.lengths[a] == 1, self.lengths[b] == 1
            undo_a = ~one_a & (one_b | (a > b))
            stop = bad | (one_a & one_b)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.split[a, 1], a), np.where(undo_a, b, np.where(one_b, b, self.split[b, 0]))
            go = ~stop
            left, a, b, limit = left[go], a[go], b[go], limit[go]
        return out

    def _program(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per piece) of pieces; longest ones must come first."""
        n, most = len(starts), int(lengths[0])
        last = np.full((most + 1, n), -1, np.int32)
        state = np.zeros(n, np.int64)
        reach = np.searchsorted(-lengths, -np.arange(most + 1), side="right")
        for i in range(1, most + 1):
            m = reach[i]
            byte = raw[starts[:m] + i - 1].astype(np.int64)
            s = state[:m]
            step = self.edges.get(s * 256 + byte).astype(np.int64)
            left = np.flatnonzero((step < 0) & (s != 0))
            up = s[left]
            while len(left):
                up = self.fail[up]
                to = self.edges.get(up * 256 + byte[left])
                step[left] = to
                on = (to < 0) & (up != 0)
                left, up = left[on], up[on]
            state[:m] = np.maximum(step, 0)
            token = self.longest[state[:m]]
            left = np.arange(m)
            while len(left):
                t = token[left]
                before = last[i - self.lengths[t], left]
                inner = self.lengths[t] < i
                ok = ~inner
                test = np.flatnonzero(inner & (before >= 0))
                ok[test] = self.compatible(before[test].astype(np.int64), t[test])
                last[i, left[ok]] = t[ok]
                left = left[~ok]
                token[left] = self.shorter[token[left]]
                left = left[token[left] >= 0]
        at, columns = lengths.copy(), np.arange(n)
        back, who = [], []
        while len(columns):
            t = last[at, columns]
            if (t < 0).any():
                raise ValueError("the vocabulary lacks a byte of the text")
            back.append(t)
            who.append(columns)
            at = at - self.lengths[t]
            columns, at = columns[at > 0], at[at > 0]
        count = np.bincount(np.concatenate(who), minlength=n)
        flat = np.empty(int(count.sum()), np.int32)
        end = np.cumsum(count)
        for k, (t, w) in enumerate(zip(back, who, strict=True)):
            flat[end[w] - 1 - k] = t
        return flat, count

    def _one(self, piece: bytes) -> np.ndarray:
        """The same program for one long piece."""
        edge_keys, edge_to, pair_keys, pair_to = map(memoryview, (self.edges.keys, self.edges.values, self.pairs.keys, self.pairs.values))
        fail, longest, shorter, lengths, split = map(memoryview, (self.fail, self.longest, self.shorter, self.lengths, self.split))
        tested: dict[tuple[int, int], bool] = {}

        def find(keys: memoryview, values: memoryview, table: Table, key: int) -> int:
            at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(table.shift)
            while keys[at] != key:
                if keys[at] == -1:
                    return -1
                at = (at + 1) & table.mask
            return values[at]

        def fits(a: int, b: int) -> bool:
            limit = 1 << 40
            while True:
                merged = find(pair_keys, pair_to, self.pairs, a * self.size + b)
                if 0 <= merged < limit:
                    return False
                one_a, one_b = lengths[a] == 1, lengths[b] == 1
                if one_a and one_b:
                    return True
                if not one_a and (one_b or a > b):
                    limit, a = a, split[a, 1]
                else:
                    limit, b = b + 1, split[b, 0]

        last, state = [-1], 0
        for i, byte in enumerate(piece, 1):
            to = find(edge_keys, edge_to, self.edges, state * 256 + byte)
            while to < 0 and state:
                state = fail[state]
                to = find(edge_keys, edge_to, self.edges, state * 256 + byte)
            state = max(to, 0)
            t = longest[state]
            while t >= 0:
                before = last[i - lengths[t]]
                if lengths[t] == i:
                    break
                if before >= 0:
                    key = (before, t)
                    if key not in tested:
                        if len(tested) > 1 << 15:
                            tested.clear()
                        tested[key] = fits(before, t)
                    if tested[key]:
                        break
                t = shorter[t]
            last.append(t)
        out, at = [], len(piece)
        while at:
            if last[at] < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            out.append(last[at])
            at -= lengths[last[at]]
        return np.array(out[::-1], np.int32)

    def encode_pieces(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per piece) of pieces that lie side by side; each distinct one is worked out once.

        Pieces are told apart by their bytes. Results are kept for the next call
        up to about CACHE_BYTES.
        """
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        edges = np.r_[starts, len(raw)].astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        inverse, distinct = np.asarray(found.indices), found.dictionary
        keys = distinct.to_pylist()
        place = np.fromiter((self.known.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if len(new):
            bound = np.frombuffer(distinct.buffers()[1], np.int64)[: len(keys) + 1]
            body = np.frombuffer(distinct.buffers()[2], np.uint8)
            lengths = np.diff(bound)[new]
            order = np.argsort(-lengths, kind="stable")
            new, lengths = new[order], lengths[order]
            begin = bound[new]
            at = int(np.searchsorted(-lengths, -LONG_PIECE, side="left"))
            ids = [self._one(keys[k]) for k in new[:at].tolist()]
            counts = [np.array([len(x) for x in ids], np.int64)]
            while at < len(new):
                step = max(1, CELLS // int(lengths[at] + 1))
                x, c = self._program(body, begin[at : at + step], lengths[at : at + step])
                ids.append(x)
                counts.append(c)
                at += step
            count = np.concatenate(counts)
            first = len(self.cached_counts)
            self.cached_starts = np.r_[self.cached_starts, len(self.cached_ids) + np.cumsum(count) - count]
            self.cached_ids = np.concatenate([self.cached_ids, *ids])
            self.cached_counts = np.r_[self.cached_counts, count]
            place[new] = first + np.arange(len(new))
            self.known.update(zip((keys[i] for i in new.tolist()), range(first, first + len(new)), strict=True))
            self.held += int(lengths.sum()) + 4 * int(count.sum()) + 160 * len(new)
        place = place[inverse]
        counts, starts = self.cached_counts[place], self.cached_starts[place]
        out = self.cached_ids[np.repeat(starts, counts) + ranges(counts)]
        if self.held > CACHE_BYTES:
            self._clear()
        return out, counts

    def encode_rows(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per row) of UTF-8 rows."""
        starts, per_row = pieces(raw, offsets)
        ids, counts = self.encode_pieces(raw, starts)
        total = np.r_[0, np.cumsum(counts)]
        edge = np.r_[0, np.cumsum(per_row)]
        return ids, np.diff(total[edge])

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_rows(raw, np.array([0, len(raw)]))[0].tolist()

    def decode_flat(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        n = self.lengths[ids]
        return self.bytes[np.repeat(self.offsets[ids], n) + ranges(n)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become the replacement sign."""
        return self.decode_flat(np.asarray(ids, np.int64)).tobytes().decode(errors="replace")


def _parts(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int]:
    """The two tokens whose merge is this one: its encoding by lower ranks."""
    own = ranks[token]
    parts = [bytes([b]) for b in token]
    while len(parts) > 2:
        best, at = own, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], own)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    if len(parts) != 2:
        raise ValueError(f"token {own} is no merge of two others")
    return ranks[parts[0]], ranks[parts[1]]


def list_array(values: np.ndarray, counts: np.ndarray, valid: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of the given sizes, null where not valid."""
    offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
    mask = pa.array(~valid) if not valid.all() else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind), mask=mask)


_residents: dict[bytes, Encoder] = {}


def resident(encoder: Encoder) -> Encoder:
    """This Python worker's own copy of an encoder, which keeps its pieces from task to task."""
    return _residents.setdefault(hashlib.sha256(encoder.bytes.tobytes() + encoder.offsets.tobytes()).digest(), encoder)


def _encode_batches(encoder: Encoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_ = resident(encoder)
        for batch in batches:
            for a, b, raw, offsets, valid in text_slices(batch.column(1)):
                ids, counts = encoder_.encode_rows(raw, offsets)
                back = encoder_.decode_flat(ids)
                ends = np.r_[0, np.cumsum(encoder_.lengths[ids])][np.r_[0, np.cumsum(counts)]]
                differ = np.r_[0, np.cumsum(back != raw)] if len(back) == len(raw) else np.arange(len(raw) + 1)
                same = (ends == offsets)[1:] & (np.diff(differ[offsets]) == 0)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64(), mask=~valid), list_array(ids, counts, valid, pa.int32()), pa.array(same, mask=~valid)],
                    ["doc_id", "n_tokens", "ids", "round_trip"],
                )

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): exact ids of whole texts.

    round_trip says whether the ids decode to the very bytes of the text. A null
    text has nulls, a row without id keeps its null.
    """
    run = _encode_batches(Encoder(vocabulary))
    return base.pick(docs, id=id_col, text=text_col).mapInArrow(base.tidy(run), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def _decode_batches(encoder: Encoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            ids = np.asarray(lists.flatten()).astype(np.int64)
            edge = np.r_[0, np.cumsum(sizes)]
            texts = [encoder.decode(ids[edge[i] : edge[i + 1]]) if lists[i].is_valid else None for i in range(len(lists))]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of lists of ids; a null list has a null text."""
    return base.pick(tokens, id=id_col, ids=ids_col).mapInArrow(_decode_batches(Encoder(vocabulary)), "doc_id long, text string")


def _count_batches(encoder: Encoder):
    def run(texts: pa.Array) -> pa.Array:
        encoder_ = resident(encoder)
        out = [pa.array([], pa.int64())]
        for _a, _b, raw, offsets, valid in text_slices(texts):
            _, counts = encoder_.encode_rows(raw, offsets)
            out.append(pa.array(counts, pa.int64(), mask=~valid))
        base.release()
        return pa.concat_arrays(out)

    return run


def with_counts(docs: DataFrame, text: str, name: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The table with the exact number of ids of a text column."""
    return docs.withColumn(name, F.arrow_udf(_count_batches(Encoder(vocabulary)), "long")(F.col(text)))


def op9_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, with the check that they decode to the same bytes."""
    return encode(base.table(spark, sf_dir, "documents"))
