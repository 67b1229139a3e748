"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return the
columns of documents as they came, extra ones included, whatever their names.

Defined results, stage by stage:

- quality_rules: a null or empty text has no words and is rejected where its language
  has certified cut-offs; a null language is a stratum of its own; a row without id is
  judged as any other; repeated rows are judged alike.
- toxicity: a null or empty text stays; a row without id is judged as any other.
- simhash_near_dedup: rows without id or text stay; of rows that repeat an id that of
  the least text stays; of a group, and among equal texts, the least id stays.
- suffix_array_dedup: rows without id or text stay as they are; of equal passages the
  first by (id, word) stays; a document of which no word is left goes.
- best_fit_packing: rows without id or text are left out, as the sequences name their
  ids; an empty text is its end mark.

Texts of any length are worked on whole, and empty tables come out empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geolith.llm import base, packing, quality, simhash, suffixes, toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; its cut-offs come from the labelled ones."""
    return quality.reject(docs, base.table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the model is fitted to the labelled ones."""
    return toxicity.reject(docs, base.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash near-duplicate group stays."""
    return simhash.dedup(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out."""
    return suffixes.dedup(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as best-fit packed sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxic), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", passage_dedup), ("best_fit_packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of sf_dir."""
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with base.scratch(spark, lambda: docs):  # what a stage wrote for itself goes, its result stays
            docs = base.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
