"""Token ids as ORC: run-length coded integers, row indexes and Bloom filters.

`write` lays (doc_id, n_tokens, ids) rows down as ORC files. ORC codes integers by
run lengths and deltas itself; every stripe has an index with least and greatest
values for each `ROW_STRIDE` rows, and a Bloom filter over the document ids, so
that a reader looking for some ids skips files, stripes and row groups by their
metadata. Rows are sorted by id within each file, without a shuffle: what lies in
one task's input stays in one file. Readers split files at stripes (`STRIPE`
bytes), so that one file is read by many tasks.

`read` gives the rows back, of some ids if asked; the filter is pushed down to the
index. `stripes` tells what the files' metadata say.

Defined results: a null text is a row with null ids and zero tokens kept as null;
an empty text has an empty list; rows without id are stored and match no filter;
ids that repeat are stored as often as they come; an empty table reads back as an
empty table with the same columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pfs
import pyarrow.orc as orc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import base, bpe
from geolith.llm.textops import text_slices

STRIPE = 16 << 20
ROW_STRIDE = 2_000
FALSE_POSITIVES = 0.01
KIND = "doc_id long, n_tokens long, ids array<int>"


def _ids(encoder: bpe.Encoder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_ = bpe.resident(encoder)
        for batch in batches:
            for a, b, raw, offsets, valid in text_slices(batch.column(1)):
                ids, counts = encoder_.encode_rows(raw, offsets)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64(), mask=~valid), bpe.list_array(ids, counts, valid, pa.int32())], ["doc_id", "n_tokens", "ids"])

    return run


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids) of whole texts."""
    return base.pick(docs, id=id_col, text=text_col).mapInArrow(base.tidy(_ids(bpe.Encoder(vocabulary))), KIND)


def write(tokens: DataFrame, path: str, stripe: int = STRIPE, row_stride: int = ROW_STRIDE) -> None:
    """Store (doc_id, n_tokens, ids) rows at a path that isn't there yet."""
    options = {
        "compression": "zstd", "orc.stripe.size": str(stripe), "orc.create.index": "true", "orc.row.index.stride": str(row_stride),
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE_POSITIVES),
    }
    tokens.sortWithinPartitions("doc_id").write.options(**options).orc(path)


def read(spark: SparkSession, path: str, ids: Iterable[int] | None = None) -> DataFrame:
    """The stored rows, or those of some ids."""
    rows = spark.read.schema(KIND).orc(path)
    return rows if ids is None else rows.where(F.col("doc_id").isin(sorted({int(i) for i in ids})))


def stripes(spark: SparkSession, path: str) -> DataFrame:
    """(file, stripes, rows, bytes, row_stride, compression) from the files' metadata, read in parallel."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, at = pfs.FileSystem.from_uri(name)
                with system.open_input_file(at) as f:
                    o = orc.ORCFile(f)
                    yield pa.record_batch([[name], [o.nstripes], [o.nrows], [o.file_length], [o.row_index_stride], [str(o.compression)]], ["file", "stripes", "rows", "bytes", "row_stride", "compression"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.orc").load(path).select("path")
    return files.mapInArrow(describe, "file string, stripes long, rows long, bytes long, row_stride long, compression string")


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents, written as ORC to the shared folder and read again."""
    path = f"{base.shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(tokenised(base.table(spark, sf_dir, "documents")), path)
    return read(spark, path)
