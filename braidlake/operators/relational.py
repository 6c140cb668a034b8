"""Joins, sub-queries, windows, set operations and top-n with the engine's semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def anti_null_aware(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """NOT IN: no rows at all if the right side has a null, and a left null only passes an empty right side.

    Written as a plain anti join plus two scalar facts on the right side: Spark's own null-aware anti join is limited
    to a broadcast, which a right side of unknown size must not be.
    """
    facts = right.agg(F.count("*").alias("__n"), F.count(right_key).alias("__known"))  # one row
    keep = left.join(right.select(F.col(right_key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
    return keep.join(F.broadcast(facts), (F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & F.col(key).isNotNull())).drop("__n", "__known")


def semi(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """IN as a conjunct."""
    return left.join(right.select(F.col(right_key).alias("__k")), F.col(key) == F.col("__k"), "left_semi")


def marked(left: DataFrame, key: str, right: DataFrame, right_key: str, mark: str) -> DataFrame:
    """IN under OR: left with a boolean column, true where the key is on the right side. A join on distinct keys, so rows are not multiplied."""
    keys = right.select(F.col(right_key).alias("__k")).filter("__k is not null").distinct().withColumn("__hit", F.lit(True))
    return left.join(keys, F.col(key) == F.col("__k"), "left").withColumn(mark, F.coalesce("__hit", F.lit(False))).drop("__k", "__hit")


def scalar(df: DataFrame, value: str) -> DataFrame:
    """A scalar sub-query as one row: null without rows, an error with more than one."""
    one = df.agg(F.count("*").alias("__n"), F.max(value).alias(value))
    return one.select(F.when(F.col("__n") > 1, F.raise_error(F.lit("21000: more than one row in a scalar sub-query")).cast(df.schema[value].dataType)).otherwise(F.col(value)).alias(value))


def ranking(partition: Sequence[str | Column], order: Sequence[Column]) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order)


def over_partition(*partition: str | Column) -> WindowSpec:
    """The frame of window aggregates: the whole partition, also where an order is given."""
    return Window.partitionBy(*partition).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def total_over(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """OVER (): totals of all rows beside every row. One partial aggregate and a one-row broadcast instead of a window, which would bring all rows to one task."""
    return df.join(F.broadcast(df.agg(*[c.alias(n) for n, c in aggregates.items()])))


def top_n(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """LIMIT over a sort; Spark keeps limit + offset rows per task."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()
