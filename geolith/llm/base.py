"""What the operators of this subpackage share: tables, columns, lineage cuts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a local master, which has one machine, gets a temporary folder of its own
    where nothing is set.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="geolith-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that isn't there yet."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    if (paths := _scratch.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, keep: Callable[[], DataFrame]) -> Iterator[None]:
    """Delete, at the end, what `written` wrote meanwhile, but for what `keep()` reads."""
    before, paths = _scratch.get(), []
    _scratch.set(paths)
    try:
        yield
        read = {f.rsplit("/", 2)[1] for f in keep().inputFiles()}
        for path in paths:
            if path.rsplit("/", 1)[1] not in read:
                remove(spark, path)
    finally:
        _scratch.set(before)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """The same partition function, which gives its memory back at its end: Python workers live on."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return lean


def release() -> None:
    """Return freed memory to the system; the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names, however other columns are called.

    A name is matched exactly first and regardless of case otherwise; the first
    match counts. Columns are taken by place, so that names which differ only in
    case, or repeat, cannot clash.
    """
    return columns_by_place(df).select(*[F.col(f"_{place(df, old)}").alias(new) for new, old in columns.items()])


def place(df: DataFrame, name: str) -> int:
    names = df.columns
    for same in (lambda x: x == name, lambda x: x.lower() == name.lower()):
        for i, x in enumerate(names):
            if same(x):
                return i
    raise ValueError(f"no column {name} among {names}")


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, unless the session sets their size itself.

    By default a batch is 10,000 rows however long they are, and several copies of it
    are held on both sides of a Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, str(2**31 - 1), f"{2**31 - 1}b", str(2**63 - 1)):
        spark.conf.set(key, str(BATCH_BYTES))


def columns_by_place(df: DataFrame) -> DataFrame:
    """Columns renamed _0, _1 and so on."""
    small_batches(df.sparkSession)
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as the signed integers Spark stores."""
    return x.view(np.int64)


def unique_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each id, that of the least text (nulls first); rows without an id stay.

    Of rows with equal ids and texts that of the least hash stays. The texts are only
    shuffled where some id does repeat.
    """
    key = pick(docs, id=id_col).where("id IS NOT NULL")
    if key.groupBy("id").count().where("count > 1").isEmpty():
        return docs
    names, at, text = docs.columns, f"_{place(docs, id_col)}", f"_{place(docs, text_col)}"
    flat = columns_by_place(docs)
    hashed = [f.name for f in flat.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    order = F.struct(F.col(text).isNotNull(), F.col(text), F.xxhash64(*hashed))
    one = flat.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("key")).agg(F.min_by(F.struct(*flat.columns), order).alias("row"))
    return one.select(*[F.col("row")[c].alias(c) for c in flat.columns]).unionByName(flat.where(F.col(at).isNull())).toDF(*names)


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id isn't in ids (column `id`); null ids stay."""
    names = docs.columns
    key = f"_{place(docs, id_col)}"
    kept = columns_by_place(docs).join(ids.select(F.col("id").alias("dropped")), F.col(key) == F.col("dropped"), "left_anti")
    return kept.toDF(*names)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root).

    Root is the least node of the component. Labels spread to neighbours and
    jump to the label of their label, so that the rounds grow with the logarithm
    of a component's width; each round's labels are checkpointed.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        spread = labels.join(near, labels.node == near.a).select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        ends = labels.select(F.col("node").alias("mid"), F.col("root").alias("end"))
        after = cut(spread.join(ends, spread.root == ends.mid, "left").select("node", F.least("root", "end").alias("root"), "old"))
        if after.where("root <> old").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")
