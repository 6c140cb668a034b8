"""Versions of rows by primary key: overlays of changes, merges of segments and the three-way merge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETED, SEQ = "__deleted", "__seq"


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def latest(changes: DataFrame, pk: Sequence[str]) -> DataFrame:
    """The newest version (largest __seq) of each key, tombstones included. Aggregation, so a key with many versions is combined before the shuffle."""
    rest = [c for c in changes.columns if c not in pk]
    one = changes.groupBy(*pk).agg(F.max_by(F.struct(*rest), F.col(SEQ)).alias("__row"))
    return one.select(*pk, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def overlaid(base: DataFrame, changes: DataFrame, pk: Sequence[str]) -> DataFrame:
    """base with changes (its columns, __seq and __deleted) on top: the newest change of a key replaces the base's row, a tombstone removes it."""
    newest = latest(changes, pk)
    kept = base.join(newest.select(*[F.col(k).alias(f"__{k}") for k in pk]), reduce(lambda x, y: x & y, [_same(F.col(k), F.col(f"__{k}")) for k in pk]), "left_anti")
    return kept.select(*base.columns).union(newest.filter(~F.col(DELETED)).select(*base.columns))


def merged_segments(segments: Sequence[DataFrame], pk: Sequence[str]) -> DataFrame:
    """Rows of segments from old to new, each with __deleted: per key the newest, unless it is a tombstone."""
    every = reduce(DataFrame.unionByName, [s.withColumn(SEQ, F.lit(k)) for k, s in enumerate(segments)])
    return latest(every, pk).filter(~F.col(DELETED)).drop(SEQ, DELETED)


def three_way(base: DataFrame, left: DataFrame, right: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Row-level three-way merge by key: all columns of the key's row, and __state 'keep', 'gone' or 'conflict'.

    A side that differs from the base wins over one that doesn't; equal changes converge; different changes, or a change
    against a deletion, conflict. Two full outer joins on the key; rows are compared null-safe.
    """
    cols = [c for c in base.columns if c not in pk]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*pk, F.struct(F.lit(1).alias("__there"), *cols).alias(name))

    every = side(base, "b").join(side(left, "l"), list(pk), "full_outer").join(side(right, "r"), list(pk), "full_outer")
    b, x, y = F.col("b"), F.col("l"), F.col("r")
    pick = F.when(_same(x, b), y).when(_same(y, b), x).when(_same(x, y), x)
    conflict = ~_same(x, b) & ~_same(y, b) & ~_same(x, y)
    out = every.select(*pk, pick.alias("__row"), conflict.alias("__conflict"))
    state = F.when(F.col("__conflict"), "conflict").when(F.col("__row").isNull(), "gone").otherwise("keep")
    return out.select(*pk, *[F.col(f"__row.`{c}`").alias(c) for c in cols], state.alias("__state")).select(*base.columns, "__state")
