"""Incremental consumption: row cursors, batch streams and a stream of a table's change sets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from braidlake.catalog import columns
from braidlake.operators.overlay import DELETED
from braidlake.session import Session
from braidlake.types import struct


def rows(df: DataFrame, prefetch: bool = True) -> Iterator[Row]:
    """A lazy row cursor: the driver holds one partition at a time."""
    return df.toLocalIterator(prefetchPartitions=prefetch)


def batches(df: DataFrame, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `size` rows, made on the executors and fetched partition by partition."""

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for at in range(0, b.num_rows, size):
                sink = pa.BufferOutputStream()
                one = b.slice(at, size)
                with pa.ipc.new_stream(sink, one.schema) as w:
                    w.write_batch(one)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["ipc"])

    for r in df.mapInArrow(packed, "ipc binary").toLocalIterator(prefetchPartitions=True):
        with pa.ipc.open_stream(bytes(r["ipc"])) as reader:
            yield from reader


def changes(session: Session, table: str) -> DataFrame:
    """A streaming DataFrame of a table's change sets: its columns, whether the row was deleted, and the file.

    These are all that is written for tables of this name, on any branch: a statement's rows show before its commit, and those of one that
    has failed may show before they are deleted. Base files have no deletion mark and are left out.
    """
    entry = session._entry(table)
    schema = struct(columns(entry)).add(DELETED, "boolean")
    own = f"{session.catalog.root}/data/{session.catalog.mark(entry['name'])}-*"
    stream = session.spark.readStream.schema(schema).parquet(own)
    return stream.withColumn("__file", F.col("_metadata.file_path")).filter(F.col(DELETED).isNotNull())


def to_table(stream: DataFrame, session: Session, table: str, checkpoint: str, conflict: str | None = "update") -> StreamingQuery:
    """Writes a stream into a versioned table, one change set per micro-batch. By upsert on the key a batch that is tried again writes the same rows."""
    names = [c["name"] for c in columns(session._entry(table))]
    pk = session._entry(table)["pk"]
    assign = {n: f"excluded.{n}" for n in names if n not in pk}

    def put(batch: DataFrame, _: int) -> None:
        session.put(table, batch.select(*names), None, conflict, assign)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, size: str, late: str, keys: list[str], aggregates: dict, slide: str | None = None) -> DataFrame:
    """Event-time windows with a watermark: rows later than `late` are left out, state is dropped behind it."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(*[a.alias(n) for n, a in aggregates.items()])


def read(spark: SparkSession, path: str, schema: str, names: str | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder. names: a glob pattern of file names."""
    stream = spark.readStream.schema(schema)
    return (stream.option("pathGlobFilter", names) if names else stream).parquet(path)
