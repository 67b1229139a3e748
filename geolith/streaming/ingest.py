"""Continuous ingest of copy text files into a store's table, and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geolith.operators import layout
from geolith.sources import copytext
from geolith.sources.store import Store


def ingest(store: Store, table: str, folder: str, checkpoint: str, name: str = "ingest") -> StreamingQuery:
    """Publish the rows of each file that comes into a folder; ends when all there are have been.

    Lines are decoded where they are read. A batch and its number are published in one
    manifest, so that a batch that is played again after a failure adds nothing.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = store.schema(table)
    arrow = to_arrow_schema(schema)
    mark = f"stream:{name}"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():  # a file, with an end mark of its own
                for rows in copytext.batches(copytext.decode([content], schema)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def publish(df: DataFrame, number: int) -> None:
        m = store.manifest(table)
        if int(m.comments.get(mark, -1)) >= number:
            return
        # what comes in is fitted like any other rows: no nulls where none may be, bounds that follow the geometry
        mine = [c for c in df.columns if c.lower() not in layout.COLUMNS] if layout.inspect(schema) else df.columns
        store._publish(table, m, files=m.files + store._write(table, store._fitted(table, df.select(*mine), True)), comments=m.comments | {mark: str(number)})

    files = store.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = files.select("content").mapInArrow(decode, schema)
    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """(start, key, n) of tumbling windows; on a stream, rows later than `late` are left out."""
    known = events.withWatermark(at, late) if events.isStreaming else events
    return known.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
