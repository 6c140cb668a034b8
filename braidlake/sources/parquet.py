"""Parquet source and sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write(df: DataFrame, path: str, sort: Sequence[str] | None = None, partition: Sequence[str] | None = None, group_bytes: int | None = None, codec: str | None = None) -> None:
    """Writes df; sorted within tasks, so that row-group statistics prune range filters. group_bytes: the size of a row group, 128 MB by default; codec: zstd, snappy, ..."""
    w = (df.sortWithinPartitions(*sort) if sort else df).write
    if group_bytes:
        w = w.option("parquet.block.size", group_bytes)
    if codec:
        w = w.option("compression", codec)
    (w.partitionBy(*partition) if partition else w).parquet(path)
