"""Quality rules whose cut-offs carry a guarantee on falsely rejected documents.

Six rules measure a text (`RULES`); a document is rejected where any of them lies
above its cut-off. Cut-offs are set for each stratum (language) from labelled
documents, which a hash of their id deals to two halves:

1. The fitting half proposes a fixed sequence of cut-off vectors, from lenient to
   strict: at level j each rule's cut-off is the value that a share `LEVELS[j]` of
   the stratum's good documents exceeds. Before them comes a level with `HEADROOM`
   times the good documents' greatest values.
2. The held-out half tests the sequence in that order. A level is certified while
   the exact binomial (Clopper-Pearson) bound on the false rejection of good
   documents stays within `MAX_FALSE`: P(Bin(n, MAX_FALSE) <= rejected) is at most
   `ERROR` divided by the number of strata. The sequence ends at the first level
   that fails, so no further correction is due within a stratum (fixed-sequence
   testing), and Bonferroni's covers the strata: with probability 1 - ERROR every
   stratum's false rejection is within MAX_FALSE.
3. Of the certified levels the one that rejects most of the fitting half's bad
   documents, less `FALSE_COST` times the good ones, is used; of equals the most
   lenient.

All labelled documents count. What comes to the driver is a histogram of at most
1001 bins for each rule and stratum.

Defined results: a null text is a text without words; a text without words is
rejected in every stratum that has a certified level; a null stratum is a stratum
of its own; labels that are null or contradict each other aren't used; a stratum
with too few held-out good documents for any certificate rejects nothing; rows
without id are judged as any other, and each row by itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import base
from geolith.llm.textops import segment_sum, span_hash, text_slices, word_spans

RULES = ("symbols", "capitals", "repeats", "digits", "lines", "length")
MAX_FALSE = 0.05
ERROR = 0.05
FALSE_COST = 20.0
LEVELS = (0.0, 0.0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03)
HEADROOM = 1.25
SCALE = 1000
SLICE = 1 << 19
EMPTY = SCALE + 1

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|!~^=<>{}[]\\_@+/"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER | np.roll(_UPPER, 32)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
# continuation bytes of UTF-8 are no characters of their own
_CHAR = np.ones(256, bool)
_CHAR[128:192] = False


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those that an earlier line of the row equals) per row."""
    ends_line = raw == 10
    cuts = np.union1d(np.flatnonzero(ends_line) + 1, offsets)
    starts, ends = cuts[:-1], cuts[1:]
    row = np.searchsorted(offsets, starts, side="right") - 1
    ends = ends - (ends_line[ends - 1] if len(ends) else 0)
    full = ends > starts
    starts, ends, row = starts[full], ends[full], row[full]
    h = span_hash(raw, starts, ends)
    order = np.lexsort((h, row))
    again = (row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])
    rows = len(offsets) - 1
    return np.bincount(row, minlength=rows), np.bincount(row[order][1:][again], minlength=rows)


def measure(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, rules) values in thousandths, rounded up and at most SCALE; EMPTY without words."""
    starts, ends, counts = word_spans(raw, offsets)
    letters_of_words = _per_row(_CHAR[raw], offsets) - _per_row((raw == 32) | ((raw >= 9) & (raw <= 13)), offsets)
    h = span_hash(raw, starts, ends, lower=True)
    same = np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
    first = (np.cumsum(counts) - counts)[counts > 0]
    same[first] = False
    lines, again = _lines(raw, offsets)
    parts = [
        (_per_row(_SYMBOL[raw], offsets), letters_of_words),
        (_per_row(_UPPER[raw], offsets), _per_row(_LETTER[raw], offsets)),
        (segment_sum(same, counts), counts),
        (_per_row(_DIGIT[raw], offsets), letters_of_words),
        (again, lines),
        (letters_of_words, counts * 64),
    ]
    out = np.empty((len(counts), len(parts)), np.int32)
    for k, (part, whole) in enumerate(parts):
        out[:, k] = np.minimum(-(-part.astype(np.int64) * SCALE // np.maximum(whole, 1)), SCALE)
    out[counts == 0] = EMPTY
    return out


def _measures(texts: pa.Array) -> pa.Array:
    found = [np.zeros((0, len(RULES)), np.int32)]
    found += [measure(raw, offsets) for _a, _b, raw, offsets, _valid in text_slices(texts, SLICE)]
    values = np.concatenate(found)
    base.release()
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(RULES))], list(RULES))


_KIND = "struct<" + ",".join(f"{r}:int" for r in RULES) + ">"


def measured(docs: DataFrame, text: str, name: str = "measure") -> DataFrame:
    """The table with a struct of the rules' values of a text column."""
    return docs.withColumn(name, F.arrow_udf(_measures, _KIND)(F.col(text)))


def certified(rejected: int, n: int, limit: float, error: float) -> bool:
    """Whether P(Bin(n, limit) <= rejected) <= error: the exact upper bound is within the limit."""
    if rejected >= n * limit:
        return False
    log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(limit) + (n - k) * math.log1p(-limit) for k in range(rejected + 1)]
    top = max(log)
    return top + math.log(sum(math.exp(x - top) for x in log)) <= math.log(error)


def proposals(values: np.ndarray, counts: np.ndarray) -> list[int]:
    """For each level the least cut-off that at most that share of the counts exceeds, the first with headroom."""
    order = np.argsort(values)
    v, above = values[order], counts.sum() - np.cumsum(counts[order])
    out = [int(v[np.argmax(above <= level * counts.sum())]) for level in LEVELS]
    return [min(SCALE, math.ceil(out[0] * HEADROOM)), *out[1:]]


def _labelled(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, rules, good, held) of the documents with one clear label."""
    marks = base.pick(labels, label_id="doc_id", quality="quality").where("label_id IS NOT NULL AND quality IN (0, 1)").groupBy("label_id").agg(F.min("quality").alias("good"), F.max("quality").alias("other")).where("good = other")
    rows = values.where("id IS NOT NULL").join(marks, F.col("id") == F.col("label_id"))
    return rows.select("stratum", *[F.col(f"measure.{r}").alias(r) for r in RULES], "good", (F.pmod(F.xxhash64("id"), F.lit(2)) == 1).alias("held"))


def cutoffs(values: DataFrame, labels: DataFrame, max_false: float = MAX_FALSE, error: float = ERROR) -> dict[str | None, tuple[int, ...]]:
    """Certified cut-offs of each stratum; strata without a certificate are missing.

    values: (id, stratum, measure) of all documents.
    """
    known = base.written(_labelled(values, labels), "quality-labelled")
    bins = known.where("NOT held AND good = 1").select("stratum", F.posexplode(F.array(*RULES)).alias("rule", "value")).groupBy("stratum", "rule", "value").count().collect()
    found: dict[tuple, list] = {}
    for r in bins:
        found.setdefault((r["stratum"], r["rule"]), []).append((r["value"], r["count"]))
    cuts: dict[str | None, list[tuple[int, ...]]] = {}
    for stratum in {s for s, _ in found}:
        per_rule = []
        for k in range(len(RULES)):
            pairs = np.array(found[stratum, k])
            per_rule.append(proposals(pairs[:, 0], pairs[:, 1]))
        cuts[stratum] = list(zip(*per_rule, strict=True))
    if not cuts:
        return {}
    spark = values.sparkSession
    table = spark.createDataFrame([(s, [list(c) for c in levels]) for s, levels in cuts.items()], "s string, levels array<array<int>>")
    over = [F.exists(F.arrays_zip(F.array(*RULES).alias("v"), F.col("levels")[j].alias("c")), lambda x: x["v"] > x["c"]) for j in range(len(LEVELS))]
    tests = known.join(F.broadcast(table), F.col("stratum").eqNullSafe(F.col("s"))).groupBy("stratum", "held", "good").agg(F.count("*").alias("n"), *[F.count_if(x).alias(f"r{j}") for j, x in enumerate(over)]).collect()
    counted = {(r["stratum"], r["held"], r["good"]): (r["n"], [r[f"r{j}"] for j in range(len(LEVELS))]) for r in tests}
    none = (0, [0] * len(LEVELS))
    out = {}
    for stratum, levels in cuts.items():
        n, rejected = counted.get((stratum, True, 1), none)
        bad_n, bad = counted.get((stratum, False, 0), none)
        good_n, good = counted.get((stratum, False, 1), none)
        best = None
        for j, level in enumerate(levels):
            if not n or not certified(rejected[j], n, max_false, error / len(cuts)):
                break
            gain = bad[j] / max(1, bad_n) - FALSE_COST * good[j] / max(1, good_n)
            if best is None or gain > best[0]:
                best = gain, level
        if best:
            out[stratum] = best[1]
    return out


def verdict(cuts: dict[str | None, tuple[int, ...]], stratum: Column, measure: str = "measure") -> Column:
    """The first rule whose cut-off a row exceeds, null where it is kept."""
    out = F.lit(None).cast("string")
    for name, limits in cuts.items():
        rule = F.coalesce(*[F.when(F.col(f"{measure}.{r}") > limit, F.lit(r)) for r, limit in zip(RULES, limits, strict=True)])
        out = F.when(stratum.eqNullSafe(F.lit(name).cast("string")), rule).otherwise(out)
    return out


def _values(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    return measured(base.pick(docs, id=id_col, text=text_col, stratum=stratum_col), "text").select("id", F.col("stratum").cast("string").alias("stratum"), "measure")


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Documents less the rejected ones, all columns as they were.

    Texts are measured twice rather than shuffled: for the labelled values, and
    where the rows pass by.
    """
    names = docs.columns
    cuts = cutoffs(_values(docs, id_col, text_col, stratum_col), labels)
    flat = measured(base.columns_by_place(docs), f"_{base.place(docs, text_col)}")
    return flat.where(verdict(cuts, F.col(f"_{base.place(docs, stratum_col)}").cast("string")).isNull()).drop("measure").toDF(*names)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its values, whether it is kept, and the rule that rejects it."""
    values = base.written(_values(base.table(spark, sf_dir, "documents"), "doc_id", "text", "lang"), "quality-values")
    cuts = cutoffs(values, base.table(spark, sf_dir, "labels"))
    rule = verdict(cuts, F.col("stratum"))
    return values.select(F.col("id").alias("doc_id"), F.col("stratum").alias("lang"), *[F.col(f"measure.{r}").alias(r) for r in RULES], rule.isNull().alias("kept"), rule.alias("rejected_by"))
