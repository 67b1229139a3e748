"""Language of web pages by fusing four kinds of evidence in Bayes' rule.

    log P(l | page) = TEMPER * log P(text | l) + log P(declared | l)
                      + log P(suffix | l) + log P(l | host) + const

- The text likelihood is that of byte trigrams (hashed to `BUCKETS`) under each
  language, fitted to about `TRAIN_DOCS` documents of each language whose language
  column tells it (a hash of their id picks them). It is tempered, as overlapping
  trigrams aren't independent.
- The declared markup language is the `lang` of the html element, the suffix is
  the last label of the host. How they go with languages is counted over all pages,
  each page counting by its text's posterior, and smoothed by `PSEUDO` counts.
- The host's prior is hierarchical: the host's own posterior counts are smoothed
  towards its domain's (the last two labels), the domain's towards all pages', with
  `HOST_WEIGHT` and `DOMAIN_WEIGHT` pseudo counts. A page's own count is taken out of
  the host's and the domain's before, so that it is no evidence for itself.

All counts are grouped aggregates over all pages, in thousandths as integers, so
that they don't depend on any order. Texts are scored once; what is aggregated and
joined afterwards has no text. The joins are left to the optimiser, which
broadcasts the count tables only while they are small.

Defined results: a null or empty html has no text and no declaration; a null url,
or one without host, has the host ''; of equal posteriors the language first in
the alphabet is given; without any labelled document every language is null; rows
that repeat count as often as they come; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import base
from geolith.llm.textops import ranges, text_slices

BUCKETS = 1 << 15
TRAIN_DOCS = 1500
TEMPER = 0.1
PSEUDO = 1000
HOST_WEIGHT, DOMAIN_WEIGHT = 5_000, 20_000
UNIT = 1000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[:65] = _GAP[91:97] = _GAP[123:128] = True


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat buckets, trigrams per row); all bytes that are no letters are one and the same."""
    x = np.where(_GAP[raw], np.uint8(32), _LOWER[raw]).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    key = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)
    counts = np.maximum(np.diff(offsets) - 2, 0)
    at = np.repeat(offsets[:-1], counts) + ranges(counts)
    flat = (key[at] >> np.uint32(32 - 15)).astype(np.int32)
    blank = (x[at] == 32) & (x[at + 1] == 32) | (x[at + 1] == 32) & (x[at + 2] == 32)
    keep = ~blank
    sums = np.r_[0, np.cumsum(keep)]
    edge = np.r_[0, np.cumsum(counts)]
    return flat[keep], np.diff(sums[edge])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language in a partition."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for a, b, raw, offsets, _valid in text_slices(batch.column(1)):
            flat, counts = trigrams(raw, offsets)
            row = np.repeat(np.arange(b - a), counts)
            for lang in dict.fromkeys(langs[a:b]):
                mine = langs[a:b] == lang
                found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                found[lang] += np.bincount(flat[mine[row]], minlength=BUCKETS)
    for lang, counts in found.items():
        hit = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(counts[hit])], ["lang", "bucket", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of each bucket): (n, BUCKETS) from about TRAIN_DOCS documents each."""
    rows = base.pick(docs, id=id_col, text=text_col, lang=lang_col).where("text IS NOT NULL AND lang IS NOT NULL AND id IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS))
    share = F.lit(0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, TRAIN_DOCS / sizes[lang]) * (1 << 30)))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).select("lang", "text")
    counts = sample.mapInArrow(_count_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(langs), BUCKETS))
    place = {lang: k for k, lang in enumerate(langs)}
    table[[place[x] for x in counts["lang"].to_pylist()], np.asarray(counts["bucket"])] = np.asarray(counts["n"])
    table += 0.5
    return langs, np.log(table) - np.log(table.sum(axis=1, keepdims=True))


def text_scores(table: np.ndarray):
    """A function from a text column to the languages' tempered log likelihoods, greatest zero, in thousandths."""
    gains = np.ascontiguousarray(table.T)

    def run(texts: pa.Array) -> pa.Array:
        out = [np.zeros((0, table.shape[0]), np.int64)]
        for a, b, raw, offsets, _valid in text_slices(texts):
            flat, counts = trigrams(raw, offsets)
            score = np.empty((b - a, table.shape[0]))
            row = np.repeat(np.arange(b - a), counts)
            for k in range(table.shape[0]):
                score[:, k] = np.bincount(row, gains[flat, k], minlength=b - a)
            score = TEMPER * (score - score.max(axis=1, keepdims=True))
            out.append(np.rint(score * UNIT).astype(np.int64))
        flat = np.concatenate(out)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, table.shape[0], dtype=np.int32)), pa.array(flat.reshape(-1)))

    return run


def visible(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments, tags or entities."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&#?[a-z0-9]+;", " ")


def host(url: Column) -> Column:
    """The lower-case host of an address, '' without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def declared(html: Column) -> Column:
    """The primary subtag of the html element's lang, '' without one."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))


def evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(page_id, score, own, declared, suffix, host, domain): what each page says by itself.

    score: the text's log likelihoods; own: its posterior under equal priors; both in thousandths.
    """
    rows = base.pick(pages, page_id="page_id", url="url", html="html")
    rows = rows.select("page_id", F.arrow_udf(text_scores(table), "array<long>")(visible(F.col("html"))).alias("score"), declared(F.col("html")).alias("declared"), host(F.col("url")).alias("host"))
    weight = F.transform("score", lambda x: F.exp(x / UNIT))
    rows = rows.withColumn("weight", weight).withColumn("total", F.aggregate("weight", F.lit(0.0), lambda a, x: a + x))
    own = F.transform("weight", lambda x: F.round(x / F.col("total") * UNIT).cast("long"))
    suffix = F.regexp_extract("host", r"([^.]*)$", 1)
    domain = F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1)
    return rows.select("page_id", "score", own.alias("own"), "declared", suffix.alias("suffix"), "host", F.when(domain == "", F.col("host")).otherwise(domain).alias("domain"))


def _sums(rows: DataFrame, key: list[str], n: int, name: str) -> DataFrame:
    """Posterior counts of each key as an array."""
    return rows.groupBy(*key).agg(F.array(*[F.sum(F.col("own")[k]) for k in range(n)]).alias(name))


def fused(rows: DataFrame, langs: list[str]) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host) of evidence rows, which are read several times."""
    n = len(langs)
    overall = rows.agg(*[F.coalesce(F.sum(F.col("own")[k]), F.lit(0)).alias(f"t{k}") for k in range(n)], F.count_distinct("declared").alias("d"), F.count_distinct("suffix").alias("s")).first()
    total = [overall[f"t{k}"] for k in range(n)]
    grand = sum(total) or 1
    for key, name in (("declared", "by_declared"), ("suffix", "by_suffix"), ("host", "by_host"), ("domain", "by_domain")):
        rows = rows.join(_sums(rows, [key], n, name), key)
    score = []
    for k in range(n):
        own = F.col("own")[k]
        said = F.log((F.col("by_declared")[k] - own + PSEUDO) / (F.lit(total[k]) - own + PSEUDO * max(1, overall["d"])))
        ends = F.log((F.col("by_suffix")[k] - own + PSEUDO) / (F.lit(total[k]) - own + PSEUDO * max(1, overall["s"])))
        # the page itself counts nowhere; a page's own shares sum to about UNIT
        base_ = F.lit((total[k] + PSEUDO) / (grand + PSEUDO * n))
        all_domain = F.aggregate("by_domain", F.lit(0).cast("long"), lambda a, x: a + x) - F.col("mass")
        all_host = F.aggregate("by_host", F.lit(0).cast("long"), lambda a, x: a + x) - F.col("mass")
        domain = (F.col("by_domain")[k] - own + DOMAIN_WEIGHT * base_) / (all_domain + DOMAIN_WEIGHT)
        prior = (F.col("by_host")[k] - own + HOST_WEIGHT * domain) / (all_host + HOST_WEIGHT)
        score.append(F.col("score")[k] / UNIT + said + ends + F.log(prior))
    rows = rows.withColumn("mass", F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("final", F.transform(F.array(*score), lambda x: F.round(x, 6)))
    top = F.array_max("final")
    names = F.array(*[F.lit(x) for x in langs])
    mass = F.aggregate(F.transform("final", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "page_id", F.element_at(names, F.array_position("final", top).cast("int")).alias("lang"), F.round(1 / mass, 6).alias("probability"),
        F.element_at(names, F.array_position("score", F.array_max("score")).cast("int")).alias("text_lang"), "declared", "host",
    )


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """The language of every page, by a model fitted to labelled documents."""
    langs, table = train(docs)
    if not langs:
        rows = base.pick(pages, page_id="page_id", url="url", html="html")
        none = F.lit(None).cast("string")
        return rows.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), declared(F.col("html")).alias("declared"), host(F.col("url")).alias("host"))
    return fused(base.written(evidence(pages, langs, table), "page-evidence"), langs)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all pages with its probability."""
    return identify(base.table(spark, sf_dir, "pages"), base.table(spark, sf_dir, "documents"))
