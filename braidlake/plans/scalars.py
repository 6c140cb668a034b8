"""One query for each scalar function, operator and cast."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidlake.functions import parity as P
from braidlake.plans.core import c, query, t


def _register(name: str, sql: str, table: str, build) -> None:
    def f(spark, d):
        return t(spark, d, table).select(*build())

    f.__name__ = name
    query(sql)(f)


def _n():
    return F.nullif(c("p_size"), F.lit(7))


_register("fn_abs", "select p_partkey, abs(p_size - 25) as a, abs(p_retailprice - 1000) as b from part", "part", lambda: ["p_partkey", F.abs(c("p_size") - 25).alias("a"), F.abs(c("p_retailprice") - 1000).alias("b")])
_register("fn_round", "select c_custkey, round(cast(c_custkey as double) / 2) as a, round(c_acctbal, 1) as b, round(cast(c_nationkey as double)) as d from customer", "customer", lambda: ["c_custkey", P.round_half_up(c("c_custkey").cast("double") / 2).alias("a"), P.round_half_up(c("c_acctbal"), 1).alias("b"), P.round_half_up(c("c_nationkey")).alias("d")])
_register("fn_floor", "select c_custkey, floor(c_acctbal) as a, floor(cast(c_nationkey as double)) as b from customer", "customer", lambda: ["c_custkey", P.floor(c("c_acctbal")).alias("a"), P.floor(c("c_nationkey")).alias("b")])
_register("fn_ceil", "select c_custkey, ceil(c_acctbal) as a, ceil(cast(c_nationkey as double)) as b from customer", "customer", lambda: ["c_custkey", P.ceil(c("c_acctbal")).alias("a"), P.ceil(c("c_nationkey")).alias("b")])
_register("fn_sqrt", "select p_partkey, sqrt(p_size) as a from part", "part", lambda: ["p_partkey", F.sqrt("p_size").alias("a")])
_register("fn_pow", "select p_partkey, pow(p_size, 2) as a, round(power(p_retailprice, 0.5), 6) as b from part", "part", lambda: ["p_partkey", F.pow("p_size", F.lit(2)).alias("a"), F.round(F.pow("p_retailprice", F.lit(0.5)), 6).alias("b")])
_register("fn_length", "select doc_id, cast(length(text) as int) as n from documents", "documents", lambda: ["doc_id", F.length("text").alias("n")])
_register("fn_upper", "select p_partkey, upper(p_name) as a from part", "part", lambda: ["p_partkey", F.upper("p_name").alias("a")])
_register("fn_lower", "select p_partkey, lower(p_type) as a from part", "part", lambda: ["p_partkey", F.lower("p_type").alias("a")])
_register(
    "fn_substr",
    "select p_partkey, substr(p_name, 1, 4) as a, substr(p_name, 1, 3) as b, substr(p_name, 4) as d, substr(p_name, greatest(p_size - 20, 1), 2) as e from part",
    "part",
    lambda: ["p_partkey", P.substr(c("p_name"), 0, 4).alias("a"), P.substr(c("p_name"), -5, 3).alias("b"), P.substr(c("p_name"), 4).alias("d"), P.substr(c("p_name"), c("p_size") - 20, 2).alias("e")],
)
_register("fn_concat", "select p_partkey, concat(p_brand, nullif(p_size, 7), '-', p_type) as a from part", "part", lambda: ["p_partkey", P.concat(c("p_brand"), _n(), F.lit("-"), c("p_type")).alias("a")])
_register("op_concat", "select p_partkey, p_brand || cast(nullif(p_size, 7) as varchar) || p_type as a from part", "part", lambda: ["p_partkey", P.strict_concat(c("p_brand"), _n(), c("p_type")).alias("a")])
_PADDED = "chr(9) || ' ' || p_name || chr(10) || ' '"


def _padded():
    return F.concat(F.lit("\t "), c("p_name"), F.lit("\n "))


_register("fn_trim", f"select p_partkey, regexp_replace({_PADDED}, '^\\s+|\\s+$', '', 'g') as a from part", "part", lambda: ["p_partkey", P.trim(_padded()).alias("a")])
_register("fn_ltrim", f"select p_partkey, regexp_replace({_PADDED}, '^\\s+', '') as a from part", "part", lambda: ["p_partkey", P.ltrim(_padded()).alias("a")])
_register("fn_rtrim", f"select p_partkey, regexp_replace({_PADDED}, '\\s+$', '') as a from part", "part", lambda: ["p_partkey", P.rtrim(_padded()).alias("a")])
_register("fn_replace", "select p_partkey, replace(p_name, 'e', 'EE') as a from part", "part", lambda: ["p_partkey", F.replace("p_name", F.lit("e"), F.lit("EE")).alias("a")])
_register("fn_coalesce", "select p_partkey, coalesce(nullif(p_size, 7), nullif(p_size + 1, 8), -1) as a from part", "part", lambda: ["p_partkey", F.coalesce(_n(), F.nullif(c("p_size") + 1, F.lit(8)), F.lit(-1)).alias("a")])
_register("fn_nullif", "select p_partkey, nullif(p_brand, 'Brand#11') as a, nullif(p_size, 7) as b from part", "part", lambda: ["p_partkey", F.nullif(c("p_brand"), F.lit("Brand#11")).alias("a"), _n().alias("b")])
_register("fn_greatest", "select p_partkey, greatest(nullif(p_size, 7), 20) as a from part", "part", lambda: ["p_partkey", F.greatest(_n(), F.lit(20)).alias("a")])
_register("fn_least", "select p_partkey, least(nullif(p_size, 7), 20, nullif(p_size, 3)) as a from part", "part", lambda: ["p_partkey", F.least(_n(), F.lit(20), F.nullif(c("p_size"), F.lit(3))).alias("a")])
_register("fn_mod", "select p_partkey, cast(((p_size - 25) % 7 + 7) % 7 as bigint) as a, cast(-(((p_size - 25) % 4 + 4) % 4) as bigint) as b from part", "part", lambda: ["p_partkey", P.mod(c("p_size") - 25, F.lit(7)).alias("a"), P.mod(c("p_size") - 25, F.lit(-4)).alias("b")])
_register("op_add", "select p_partkey, cast(p_size as bigint) + 2000000000 + 2000000000 as a, p_size + p_retailprice as b from part", "part", lambda: ["p_partkey", (P.widened(c("p_size")) + P.widened(F.lit(2000000000)) + P.widened(F.lit(2000000000))).alias("a"), (c("p_size") + c("p_retailprice")).alias("b")])
_register("op_sub", "select p_partkey, cast(p_size as bigint) - 3 as a, p_size - p_retailprice as b from part", "part", lambda: ["p_partkey", (P.widened(c("p_size")) - 3).alias("a"), (c("p_size") - c("p_retailprice")).alias("b")])
_register("op_mul", "select p_partkey, cast(p_size as bigint) * 1000000000 as a, p_size * p_retailprice as b from part", "part", lambda: ["p_partkey", (P.widened(c("p_size")) * 1000000000).alias("a"), (c("p_size") * c("p_retailprice")).alias("b")])
_register("op_int_div", "select p_partkey, cast(trunc((p_size - 25) / 7) as bigint) as a from part", "part", lambda: ["p_partkey", P.int_div(c("p_size") - 25, F.lit(7)).alias("a")])
_register("op_div", "select p_partkey, p_retailprice / nullif(p_size, 0) as a from part", "part", lambda: ["p_partkey", (c("p_retailprice") / F.nullif(c("p_size"), F.lit(0))).alias("a")])
_register("op_rem", "select p_partkey, cast((p_size - 25) % 7 as bigint) as a from part", "part", lambda: ["p_partkey", (P.widened(c("p_size") - 25) % 7).alias("a")])
_register("op_neg", "select p_partkey, -p_size as a, +p_retailprice as b, not (p_size > 10) as d from part", "part", lambda: ["p_partkey", (-c("p_size")).alias("a"), c("p_retailprice").alias("b"), (~(c("p_size") > 10)).alias("d")])
_register(
    "fn_cast",
    "select o_orderkey, cast(o_orderkey as int) as a, cast(o_orderkey as double) as b, cast(o_orderkey as varchar) as d, cast(o_orderdate as date) as e, cast('2020-02-03 04:05:06' as timestamp) as f from orders",
    "orders",
    lambda: ["o_orderkey", c("o_orderkey").cast("int").alias("a"), c("o_orderkey").cast("double").alias("b"), c("o_orderkey").cast("string").alias("d"), c("o_orderdate").cast("date").alias("e"), F.lit("2020-02-03 04:05:06").cast("timestamp_ntz").alias("f")],
)
_register("fn_try_cast", "select p_partkey, try_cast(p_brand as int) as a, try_cast(cast(p_size as varchar) as bigint) as b from part", "part", lambda: ["p_partkey", c("p_brand").try_cast("int").alias("a"), c("p_size").cast("string").try_cast("bigint").alias("b")])
_register("lit_typed", "select o_orderkey, date '1995-03-15' as a, timestamp '1995-03-15 10:20:30' as b, o_orderdate < timestamp '1995-03-15 00:00:00' as d from orders", "orders", lambda: ["o_orderkey", F.lit("1995-03-15").cast("date").alias("a"), F.lit("1995-03-15 10:20:30").cast("timestamp_ntz").alias("b"), (c("o_orderdate") < F.lit("1995-03-15 00:00:00").cast("timestamp_ntz")).alias("d")])
