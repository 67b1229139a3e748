"""Toxicity by averaged subword embeddings under a linear softmax.

A word is the bag of its byte n-grams (with marks for its ends) and of itself;
its vector is the mean of their embeddings, so that a misspelling never seen
shares most of its vector with the word it comes from. A window of `WINDOW`
consecutive words is the mean of its words, and a two-way softmax over that mean
tells whether it is toxic. Embeddings and softmax are trained together (Adam on
batches, in numpy) on the labelled documents: first with every window of a toxic document as
toxic, then with only its most toxic window, which is what the label is about. A
document's score is that of its most toxic window, over all windows.

The fit is bounded (`TRAIN_DOCS` labelled documents of each kind and
`TRAIN_WORDS` words, taken in the order of a hash of their ids; a document that
doesn't fit is left out and the next is tried, and both kinds always remain); scoring covers
every word of every text. As the model is linear behind the embeddings, scoring
needs one number for each subword bucket.

The cut-off comes from a quarter of the fitted documents that is held out.

Defined results: null texts and texts without words score 0 and are not toxic;
labels that are null or contradict each other aren't used; without labels of both
kinds nothing is toxic; every row is judged by itself, without an id too; ids may be
of any type that labels share; of labelled rows that repeat an id the least text is
fitted; other columns are left as they are, whatever their names; an empty table
stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.llm import base
from geolith.llm.textops import mix, powers, ranges, slices, span_hash, text_slices, word_spans

BUCKETS = 1 << 17
GRAMS = (3, 4, 5, 6)
DIM = 8
WINDOW = 8
SLICE = 1 << 19
TRAIN_DOCS = 3000
TRAIN_WORDS = 2_500_000
ROUNDS, STEPS, BATCHES = 3, 32, 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def subwords(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat buckets, buckets per word): n-grams of <word> and the word itself."""
    n = ends - starts
    size = n + 2
    total = int(size.sum())
    marked = np.empty(total, np.uint8)
    at = np.cumsum(size) - size
    body = np.ones(total, bool)
    body[at] = body[at + size - 1] = False
    marked[body] = _LOWER[raw[np.repeat(starts, n) + ranges(n)]]
    marked[at], marked[at + size - 1] = 2, 3
    p, q = powers(total + 1)
    sums = np.zeros(total + 1, np.uint64)
    np.cumsum((marked.astype(np.uint64) + np.uint64(1)) * p[:total], out=sums[1:])
    word = np.repeat(np.arange(len(starts)), size)
    room = np.repeat(at + size, size) - np.arange(total)
    parts, owners = [(mix(span_hash(raw, starts, ends, lower=True)) % np.uint64(BUCKETS)).astype(np.int32)], [np.arange(len(starts))]
    for k in GRAMS:
        i = np.flatnonzero(room >= k)
        h = mix((sums[i + k] - sums[i]) * q[i] + np.uint64(k))
        parts.append((h % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(word[i])
    flat, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.bincount(owner, minlength=len(starts))


def _subwords_in_parts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 16384) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`subwords` of many words a part at a time, whose bytes alone are gathered."""
    for a in range(0, len(starts), step):
        n = (ends - starts)[a : a + step]
        stop = np.cumsum(n)
        yield subwords(raw[np.repeat(starts[a : a + step], n) + ranges(n)], stop - n, stop)


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a place for each distinct word, distinct word of each place)."""
    _, first, inverse = np.unique(span_hash(raw, starts, ends, lower=True), return_index=True, return_inverse=True)
    return first, inverse


class Model:
    """One weight for each subword bucket, a bias and a cut-off."""

    def __init__(self, weights: np.ndarray, bias: float, cutoff: float):
        self.weights, self.bias, self.cutoff = weights, bias, cutoff

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The logit of each text's most toxic window, -inf without words."""
        starts, ends, counts = word_spans(raw, offsets)
        out = np.full(len(counts), -np.inf)
        if not len(starts):
            return out
        first, inverse = distinct_words(raw, starts, ends)
        flat, sizes = subwords(raw, starts[first], ends[first])
        word = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes) / sizes
        return window_maxima(word[inverse], counts) + self.bias


def window_maxima(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The greatest mean of WINDOW consecutive values, of all where there are fewer."""
    sums = np.r_[0.0, np.cumsum(values)]
    rows = np.flatnonzero(counts)
    n = counts[rows]
    begin = (np.cumsum(counts) - counts)[rows]
    width = np.minimum(n, WINDOW)
    many = n - width + 1
    at = np.repeat(begin, many) + ranges(many)
    w = np.repeat(width, many)
    means = (sums[at + w] - sums[at]) / w
    out = np.full(len(counts), -np.inf)
    out[rows] = np.maximum.reduceat(means, np.cumsum(many) - many)
    return out


def _adam(gradient: np.ndarray, state: list[np.ndarray], step: int, rate: float) -> np.ndarray:
    m, v = state
    m += 0.1 * (gradient - m)
    v += 0.01 * (gradient * gradient - v)
    return rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def _vocabulary(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts and ends of a place for each distinct word, distinct word of each place, words per row)."""
    starts, ends, hashes, counts = [], [], [], []
    for a, b in slices(np.diff(offsets), SLICE):
        o = offsets[a : b + 1]
        s, e, c = word_spans(raw[o[0] : o[-1]], o - o[0])
        hashes.append(span_hash(raw[o[0] : o[-1]], s, e, lower=True))
        starts.append(s + o[0])
        ends.append(e + o[0])
        counts.append(c)
    _, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    return np.concatenate(starts)[first], np.concatenate(ends)[first], inverse.astype(np.int32), np.concatenate(counts)


def fit(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Model | None:
    """A model of labelled texts, or None without both kinds. Empties the list of texts, to free them."""
    if not (toxic == 1).any() or not (toxic == 0).any():
        return None
    rng = np.random.default_rng(seed)
    raw, offsets = _joined(texts)
    texts.clear()
    starts, ends, inverse, counts = _vocabulary(raw, offsets)
    if not len(inverse):
        return None
    has = counts > 0
    held_out = (np.arange(len(counts)) % 4 == 3) & has
    flat, sizes = (np.concatenate(x) for x in zip(*_subwords_in_parts(raw, starts, ends), strict=True))
    begin = np.cumsum(sizes) - sizes
    # windows of the training documents, without overlap
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    fit_word = ~held_out[doc]
    if not fit_word.any():
        return None
    window = np.cumsum((ranges(counts) % WINDOW == 0)[fit_word], dtype=np.int32) - 1
    words = inverse[fit_word]
    n_windows = int(window[-1]) + 1
    per = np.bincount(window, minlength=n_windows)
    w_start = np.cumsum(per) - per
    w_doc = doc[fit_word][w_start]
    bad = toxic[w_doc] == 1
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    offset = np.zeros(2, np.float32)
    chosen = np.ones(n_windows, bool)
    for round_ in range(ROUNDS):
        sel = np.flatnonzero(chosen)
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (embedding, softmax, offset)]
        for step in range(1, STEPS + 1):
            if step % BATCHES == 1:
                rng.shuffle(sel)
            pick = sel[step % BATCHES :: BATCHES]
            if not len(pick):
                continue
            label = bad[pick].astype(int)
            weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (label == 0).sum())).astype(np.float32)
            n = per[pick]
            ids, local = np.unique(words[np.repeat(w_start[pick], n) + ranges(n)], return_inverse=True)
            w_of, share, s = np.repeat(np.arange(len(pick)), n), n[:, None].astype(np.float32), sizes[ids]
            f = flat[np.repeat(begin[ids], s) + ranges(s)]
            word_vec = np.add.reduceat(embedding[f], np.cumsum(s) - s, axis=0) / s[:, None].astype(np.float32)
            window_vec = np.add.reduceat(word_vec[local], np.cumsum(n) - n, axis=0) / share
            logits = window_vec @ softmax + offset
            logits -= logits.max(axis=1, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(pick)), label] -= 1
            error = prob * weight[:, None]
            g_soft = window_vec.T @ error + 1e-5 * softmax
            g_window = (error @ softmax.T) / share
            g_embed = np.empty_like(embedding)
            for d in range(DIM):
                g_word = np.bincount(local, g_window[w_of, d], minlength=len(ids)) / s
                g_embed[:, d] = np.bincount(f, np.repeat(g_word, s), minlength=BUCKETS)
            embedding -= _adam(g_embed, state[0], step, 0.05)
            softmax -= _adam(g_soft, state[1], step, 0.05)
            offset -= _adam(error.sum(axis=0), state[2], step, 0.05)
        model = Model(embedding @ (softmax[:, 1] - softmax[:, 0]), float(offset[1] - offset[0]), 0.0)
        word = np.add.reduceat(model.weights[flat], begin) / sizes
        score = np.add.reduceat(word[words], w_start) / per
        # the worst window of each toxic document stands for it; clean documents keep all
        order = np.lexsort((score, w_doc))
        last = np.r_[w_doc[order][1:] != w_doc[order][:-1], True]
        chosen = ~bad
        chosen[order[last]] = True
    scores = np.concatenate([model.scores(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(np.diff(offsets), SLICE)])
    return Model(model.weights, model.bias, _cutoff(scores, toxic, held_out if _both(toxic[held_out]) else has))


def _both(toxic: np.ndarray) -> bool:
    return (toxic == 1).any() and (toxic == 0).any()


def _cutoff(scores: np.ndarray, toxic: np.ndarray, used: np.ndarray) -> float:
    """The middle of the gap where few toxic texts are missed at little false alarm."""
    s, y = scores[used], toxic[used]
    order = np.argsort(-s)
    s, y = s[order], y[order]
    gain = np.r_[0, np.cumsum(y == 1) / max(1, (y == 1).sum()) - 20 * np.cumsum(y == 0) / max(1, (y == 0).sum())]
    k = int(np.argmax(gain))
    high = s[k - 1] if k else s[0] + 1
    low = s[k] if k < len(s) else s[-1] - 1
    return float((high + max(low, high - 8)) / 2)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model | None:
    """A model of the labelled documents, within TRAIN_DOCS and TRAIN_WORDS."""
    marks = base.pick(labels, label_id="doc_id", toxic=toxic_col).where("label_id IS NOT NULL AND toxic IN (0, 1)").groupBy("label_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    # the labelled ids within the bound are told apart before any text is moved
    parts = [marks.where(F.col("toxic") == kind).orderBy(F.xxhash64("label_id"), "label_id").limit(TRAIN_DOCS).select("label_id", "toxic") for kind in (0, 1)]
    chosen = parts[0].union(parts[1])
    rows = base.pick(docs, id=id_col, text=text_col).where("text IS NOT NULL").join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    # rows that repeat an id count once, by their least text; chosen bounds the rows from here on
    one = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first(F.xxhash64("label_id")).alias("place"))
    staged = base.written(one.withColumn("words", F.length(F.regexp_replace("text", "[^ \n]", "")) + 1), "toxicity-labelled")
    sizes = staged.select("place", "id", "toxic", "words").orderBy("place", "id").collect()
    keep = [sizes[k] for k in within(np.array([r.words for r in sizes], np.int64), np.array([r.toxic for r in sizes], int), TRAIN_WORDS)]
    if not keep:
        return None
    # only texts within the bound go to the task that fits; neither they nor their arrays come to the driver
    kept = docs.sparkSession.createDataFrame([(n, r.id) for n, r in enumerate(keep)], T.StructType([T.StructField("n", T.LongType()), T.StructField("kept", staged.schema["id"].dataType)]))
    bounded = staged.join(F.broadcast(kept), F.col("id") == F.col("kept")).select("n", "text", "toxic", "words")
    found = bounded.repartition(1).sortWithinPartitions("n").mapInArrow(base.tidy(_fit_batches), "weights binary, bias double, cutoff double").collect()
    return Model(np.frombuffer(bytes(found[0].weights), np.float64), found[0].bias, found[0].cutoff) if found else None


def _first_words(text: str, n: int) -> str:
    """A text up to its n-th blank or line end."""
    at = next(islice(re.finditer("[ \n]", text), n - 1, None), None)
    return text[: at.start()] if at else text


def within(words: np.ndarray, toxic: np.ndarray, most: int) -> np.ndarray:
    """Places, in order, of the documents that fit into `most` words; one that doesn't is left out and the next tried.

    The shortest document of each kind is always among them, if need be by its
    first most // 2 words.
    """
    taken = np.zeros(len(words), bool)
    for kind in (0, 1):
        of = np.flatnonzero(toxic == kind)
        if len(of):
            taken[of[np.argmin(words[of])]] = True
    left = most - int(np.minimum(words[taken], most // 2).sum())
    for k in np.flatnonzero(~taken):
        if words[k] <= left:
            taken[k] = True
            left -= int(words[k])
    return np.flatnonzero(taken)


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A model of all rows (n, text, toxic, words), which come in order and within TRAIN_WORDS; no row without one."""
    texts, toxic = [], []
    for batch in batches:
        for text, words in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            # only the shortest text of a kind can be longer than half the bound
            texts.append(_first_words(text, TRAIN_WORDS // 2) if words > TRAIN_WORDS // 2 else text)
        toxic += batch.column(2).to_pylist()
    if not texts:
        return
    model = fit(texts, np.array(toxic, int))
    if model:
        yield pa.record_batch([pa.array([model.weights.astype(np.float64).tobytes()], pa.binary()), pa.array([float(model.bias)]), pa.array([float(model.cutoff)])], ["weights", "bias", "cutoff"])


def _scorer(model: Model):
    def run(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for _a, _b, raw, offsets, _valid in text_slices(texts, SLICE):
            out.append(model.scores(raw, offsets))
        x = np.concatenate(out)
        base.release()
        return pa.array(1 / (1 + np.exp(np.clip(model.cutoff - x, -700, 700))) * np.isfinite(x), pa.float64())

    return run


def scored(docs: DataFrame, model: Model | None, text_col: str, name: str) -> DataFrame:
    """The table with a score: over 0.5 is toxic."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    # told to be nondeterministic, so that a filter on the score doesn't score a second time, in a worker of its own
    score = F.arrow_udf(_scorer(model), T.DoubleType()).asNondeterministic()
    return docs.withColumn(name, score(F.col(text_col)))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents less the toxic ones, all columns as they were."""
    names = docs.columns
    model = train(docs, labels, id_col, text_col)
    out = scored(base.columns_by_place(docs), model, f"_{base.place(docs, text_col)}", "score").where("score <= 0.5")
    return out.drop("score").toDF(*names)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents with their scores."""
    docs = base.table(spark, sf_dir, "documents")
    model = train(docs, base.table(spark, sf_dir, "labels"))
    return scored(base.pick(docs, doc_id="doc_id", text="text"), model, "text", "score").where("score > 0.5").select("doc_id", "score")
