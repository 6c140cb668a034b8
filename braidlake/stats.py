"""ANALYZE: per column the nulls, distinct values, most common values and an equi-height histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COMMON, BUCKETS = 32, 64


def analyze(df: DataFrame) -> dict:
    """Two passes: one for the counts and histograms of all columns, one for their most common values, which are counted together by column and value; only the top ones reach the driver."""
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double")]
    parts = [F.count("*").alias("n")]
    for k, c in enumerate(df.columns):
        parts += [F.count(f"`{c}`").alias(f"k{k}"), F.approx_count_distinct(f"`{c}`").alias(f"d{k}"), F.min(f"`{c}`").cast("string").alias(f"a{k}"), F.max(f"`{c}`").cast("string").alias(f"z{k}")]
        if c in numeric:
            parts.append(F.percentile_approx(f"`{c}`", [i / BUCKETS for i in range(BUCKETS + 1)]).alias(f"h{k}"))
    r = df.agg(*parts).first()
    out = {"rows": r["n"], "columns": {}}
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for k, c in enumerate(df.columns)])).alias("x")).select("x.k", "x.v")
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("count"), "v"))  # Spark keeps the first COMMON of each task before it shuffles them
    top = pairs.filter("v is not null").groupBy("k", "v").count().withColumn("place", place).filter(F.col("place") <= COMMON).orderBy("k", "place").collect()
    for k, c in enumerate(df.columns):
        common = [[x["v"], x["count"]] for x in top if x["k"] == k]
        out["columns"][c] = {"nulls": r["n"] - r[f"k{k}"], "distinct": r[f"d{k}"], "min": r[f"a{k}"], "max": r[f"z{k}"], "common": common, "histogram": list(r[f"h{k}"] or []) if c in numeric else []}
    return out
