"""Every registered query of the engine's own operators and its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.plans import core, scalars, statements, surface, versioned

_MODULES = (core, scalars, statements, surface, versioned)  # each registers its queries
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(core.QUERIES)
ORACLE: dict[str, str] = dict(core.ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation: four tables, a date range, grouping, HAVING and a total order. The lines are shuffled once, by order, and never broadcast."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    named = t("nation").join(t("customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    orders = t("orders").filter(F.col("o_orderdate") >= "1995-01-01").join(named, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "n_name")
    rows = t("lineitem").join(orders.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = rows.groupBy("n_name").agg(F.count("*").alias("n_lines"), F.round(F.sum(amount), 2).alias("revenue"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"))
    return out.filter(F.col("n_lines") > 1).orderBy(F.desc_nulls_first("revenue"), F.asc_nulls_last("n_name")).limit(20)


QUERIES["flagship"] = flagship
ORACLE["flagship"] = """
select n_name, count(*) as n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_quantity), 4) as avg_qty
from nation join customer on n_nationkey = c_nationkey join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
where o_orderdate >= timestamp '1995-01-01' group by n_name having count(*) > 1 order by revenue desc nulls first, n_name asc nulls last limit 20"""
