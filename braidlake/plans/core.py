"""Queries over scans, filters, joins, aggregates, windows, sorts, set operations and recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidlake.functions import parity as P
from braidlake.operators import recursive
from braidlake.operators import relational as R
from braidlake.operators.overlay import DELETED, SEQ, merged_segments, overlaid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name with the SQL that must give the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- A. scans


@query("select * from nation")
def scan_table(spark, d):
    return t(spark, d, "nation")


@query("select o_orderkey, o_totalprice from orders where o_orderkey in (7, 11, 13, 1000000007)")
def point_lookup(spark, d):
    return t(spark, d, "orders").filter(c("o_orderkey").isin(7, 11, 13, 1000000007)).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_orderstatus from orders where o_orderkey >= 100 and o_orderkey < 200")
def range_scan(spark, d):
    return t(spark, d, "orders").filter((c("o_orderkey") >= 100) & (c("o_orderkey") < 200)).select("o_orderkey", "o_orderstatus")


@query("""
select o_orderkey, case when o_orderkey % 7 = 1 then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderkey % 10 <> 3
union all select -o_orderkey, 'N' from orders where o_orderkey % 100 = 5""")
def delta_overlay(spark, d):
    base = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    no, yes = F.lit(False).alias(DELETED), F.lit(True).alias(DELETED)
    first = base.filter("o_orderkey % 7 = 1").select("o_orderkey", F.lit("W").alias("o_orderstatus"), no, F.lit(0).alias(SEQ))
    second = base.filter("o_orderkey % 7 = 1").select("o_orderkey", F.lit("X").alias("o_orderstatus"), no, F.lit(1).alias(SEQ))
    gone = base.filter("o_orderkey % 10 = 3").select("o_orderkey", "o_orderstatus", yes, F.lit(2).alias(SEQ))
    new = base.filter("o_orderkey % 100 = 5").select((-c("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), no, F.lit(1).alias(SEQ))
    return overlaid(base, first.union(second).union(gone).union(new), ["o_orderkey"])


@query("select c_custkey, case when c_custkey % 4 = 0 then 'new' else 'old' end as v from customer where not (c_custkey % 6 = 0 and c_custkey % 5 = 0)")
def segment_merge(spark, d):
    keys = t(spark, d, "customer").select("c_custkey")
    live, dead = F.lit(False).alias(DELETED), F.lit(True).alias(DELETED)
    old = keys.select("c_custkey", F.lit("old").alias("v"), live)
    new = keys.filter("c_custkey % 4 = 0").select("c_custkey", F.lit("new").alias("v"), live)
    gone = keys.filter("c_custkey % 6 = 0 and c_custkey % 5 = 0").select("c_custkey", F.lit(None).cast("string").alias("v"), dead)
    return merged_segments([old, new, gone], ["c_custkey"])


@query("select * from (values (1, 'a'), (2, 'b'), (3, null)) v(column1, column2)")
def values_rows(spark, d):
    return spark.sql("select * from values (1, 'a'), (2, 'b'), (3, null) as v(column1, column2)")


@query("select 1 as one, 'x' as text, cast(null as varchar) as nothing, 2.5::double as d")
def select_const(spark, d):
    return spark.range(1).select(F.lit(1).alias("one"), F.lit("x").alias("text"), F.lit(None).cast("string").alias("nothing"), F.lit(2.5).alias("d"))


@query("select s.k, s.n from (select c_nationkey as k, count(*) as n from customer group by c_nationkey) as s where s.n > 3")
def derived_table(spark, d):
    return t(spark, d, "customer").groupBy(c("c_nationkey").alias("k")).agg(F.count("*").alias("n")).alias("s").filter("s.n > 3").select("s.k", "s.n")


# ---------------------------------------------------------------- B. projection and filters


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net, l_quantity > 25 as big from lineitem")
def project_expr(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_extendedprice") * (1 - c("l_discount"))).alias("net"), (c("l_quantity") > 25).alias("big"))


@query("select s.*, s_suppkey * 2 as twice from supplier s")
def project_star(spark, d):
    return t(spark, d, "supplier").alias("s").select("s.*", (c("s_suppkey") * 2).alias("twice"))


@query("select p_partkey, p_name from part where p_size > 20 and p_brand = 'Brand#11'")
def filter_basic(spark, d):
    return t(spark, d, "part").filter((c("p_size") > 20) & (c("p_brand") == "Brand#11")).select("p_partkey", "p_name")


@query("select p_partkey from part where p_size <> 10 and p_size <= 30 and p_retailprice >= 950 and p_size < p_retailprice and p_type > 'M'")
def filter_cmp(spark, d):
    return t(spark, d, "part").filter((c("p_size") != 10) & (c("p_size") <= 30) & (c("p_retailprice") >= 950) & (c("p_size") < c("p_retailprice")) & (c("p_type") > "M")).select("p_partkey")


@query("select c_custkey from customer where not (nullif(c_mktsegment, 'BUILDING') = 'MACHINERY' or c_acctbal < 0)")
def filter_bool(spark, d):
    return t(spark, d, "customer").filter(~((F.nullif(c("c_mktsegment"), F.lit("BUILDING")) == "MACHINERY") | (c("c_acctbal") < 0))).select("c_custkey")


@query("""select c_custkey, nullif(c_nationkey, 3) is null as n, nullif(c_nationkey, 3) is not null as nn,
  (nullif(c_nationkey, 3) > 10) is true as yes, (nullif(c_nationkey, 3) > 10) is false as no from customer""")
def is_tests(spark, d):
    x = F.nullif(c("c_nationkey"), F.lit(3))
    return t(spark, d, "customer").select("c_custkey", x.isNull().alias("n"), x.isNotNull().alias("nn"), (x > 10).eqNullSafe(True).alias("yes"), (x > 10).eqNullSafe(False).alias("no"))


@query("""select o_orderkey, o_orderstatus in ('F', null) as a, o_orderstatus not in ('F', 'O') as b from orders
where o_orderpriority in ('1-URGENT', '5-LOW')""")
def in_list(spark, d):
    a = F.expr("o_orderstatus in ('F', null)")
    return t(spark, d, "orders").filter(c("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey", a.alias("a"), (~c("o_orderstatus").isin("F", "O")).alias("b"))


@query("select p_partkey, nullif(p_size, 7) between 5 and 15 as a, p_size not between 5 and 15 as b from part where p_retailprice between 900 and 1200")
def between(spark, d):
    return t(spark, d, "part").filter(c("p_retailprice").between(900, 1200)).select("p_partkey", F.nullif(c("p_size"), F.lit(7)).between(5, 15).alias("a"), (~c("p_size").between(5, 15)).alias("b"))


@query("select p_partkey from part where p_name like '%ring%' and p_brand not like 'Brand#1_' or p_type like 'S!_%' escape '!' or p_name like '%e%a%'")
def like_ops(spark, d):
    return t(spark, d, "part").filter(P.like(c("p_name"), "%ring%") & ~P.like(c("p_brand"), "Brand#1_") | P.like(c("p_type"), "S!_%", "!") | P.like(c("p_name"), "%e%a%")).select("p_partkey")


@query("""select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then 'open' end as simple,
  case when o_totalprice > 300000 then 3 when o_totalprice > 100000 then 2 else 1 end as searched from orders""")
def case_expr(spark, d):
    s = c("o_orderstatus")
    return t(spark, d, "orders").select("o_orderkey", F.when(s == "F", "final").when(s == "O", "open").alias("simple"), F.when(c("o_totalprice") > 300000, 3).when(c("o_totalprice") > 100000, 2).otherwise(1).alias("searched"))


@query("select o_orderkey from orders where 1 = 0 union all select o_orderkey from orders where null")
def const_false(spark, d):
    o = t(spark, d, "orders").select("o_orderkey")
    return o.filter(F.lit(1) == F.lit(0)).union(o.filter(F.lit(None).cast("boolean")))


@query("select c_custkey, c_name from customer where c_nationkey = 5 and c_acctbal > 1000.5")
def params(spark, d):
    return spark.sql("select c_custkey, c_name from {x} where c_nationkey = :nation and c_acctbal > :least", args={"nation": 5, "least": 1000.5}, x=t(spark, d, "customer"))


@query("select c_custkey as rowid, c_custkey as ctid, c_name from customer where c_custkey < 20")
def row_id_alias(spark, d):
    return t(spark, d, "customer").select(c("c_custkey").alias("rowid"), c("c_custkey").alias("ctid"), "c_name").filter("rowid < 20")


# ---------------------------------------------------------------- C. joins and sub-queries


@query("select n.n_name, c.c_custkey from customer c join nation n on c.c_nationkey = n.n_nationkey")
def join_inner(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).select("n_name", "c_custkey")


@query("select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 400000")
def join_left(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), (c("c_custkey") == c("o_custkey")) & (c("o_totalprice") > 400000), "left").select("c_custkey", "o_orderkey")


@query("select o.o_orderkey, c.c_custkey from orders o join customer c on o.o_custkey = c.c_custkey and o.o_totalprice > c.c_acctbal * 40")
def join_residual(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "customer"), (c("o_custkey") == c("c_custkey")) & (c("o_totalprice") > c("c_acctbal") * 40)).select("o_orderkey", "c_custkey")


@query("""select a.l_orderkey, a.l_linenumber, count(*) as n from lineitem a join (select distinct l_partkey, l_suppkey from lineitem where l_quantity > 45) b
on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey group by a.l_orderkey, a.l_linenumber""")
def join_composite(spark, d):
    a = t(spark, d, "lineitem")
    b = a.filter("l_quantity > 45").select("l_partkey", "l_suppkey").distinct()
    return a.join(b, ["l_partkey", "l_suppkey"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("""select r_name, count(*) as n, round(sum(o_totalprice), 2) as total from region join nation on r_regionkey = n_regionkey
join customer on n_nationkey = c_nationkey join orders on c_custkey = o_custkey group by r_name""")
def join_chain(spark, d):
    j = t(spark, d, "orders").join(t(spark, d, "customer"), c("o_custkey") == c("c_custkey")).join(t(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(t(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return j.groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def semi_join(spark, d):
    return R.semi(t(spark, d, "customer"), "c_custkey", t(spark, d, "orders").filter("o_orderpriority = '1-URGENT'"), "o_custkey").select("c_custkey")


@query("""select c_custkey, 'null on the right' as which from customer where c_custkey not in (select nullif(o_custkey, 1) from orders)
union all select c_custkey, 'none' from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)
union all select c_custkey, 'null on the left' from customer where nullif(c_custkey, 3) not in (select o_custkey from orders where o_totalprice > 200000)
union all select c_custkey, 'empty' from customer where nullif(c_custkey, 3) not in (select o_custkey from orders where o_totalprice < 0)""")
def anti_join_null_aware(spark, d):
    cust, o = t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders")
    holes = cust.withColumn("k", F.nullif(c("c_custkey"), F.lit(3)))
    parts = [
        R.anti_null_aware(cust, "c_custkey", o.select(F.nullif(c("o_custkey"), F.lit(1)).alias("x")), "x").select("c_custkey", F.lit("null on the right").alias("which")),
        R.anti_null_aware(cust, "c_custkey", o.filter("o_totalprice > 100000"), "o_custkey").select("c_custkey", F.lit("none").alias("which")),
        R.anti_null_aware(holes, "k", o.filter("o_totalprice > 200000"), "o_custkey").select("c_custkey", F.lit("null on the left").alias("which")),
        R.anti_null_aware(holes, "k", o.filter("o_totalprice < 0"), "o_custkey").select("c_custkey", F.lit("empty").alias("which")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("select c.c_custkey from customer c left join orders o on c.c_custkey = o.o_custkey where o.o_custkey is null")
def anti_join_outer(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("""select s_suppkey, 1 as k from supplier s where exists (select 1 from lineitem l where l.l_suppkey = s.s_suppkey and l.l_returnflag = 'R')
union all select s_suppkey, 0 from supplier s where not exists (select 1 from lineitem l where l.l_suppkey = s.s_suppkey and l.l_quantity > 49)""")
def exists_corr(spark, d):
    s, l = t(spark, d, "supplier"), t(spark, d, "lineitem")
    on = c("l_suppkey") == c("s_suppkey")
    return s.join(l.filter("l_returnflag = 'R'"), on, "left_semi").select("s_suppkey", F.lit(1).alias("k")).union(s.join(l.filter("l_quantity > 49"), on, "left_anti").select("s_suppkey", F.lit(0).alias("k")))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F') or c_acctbal > 9000")
def in_under_or(spark, d):
    return R.marked(t(spark, d, "customer"), "c_custkey", t(spark, d, "orders").filter("o_orderstatus = 'F'"), "o_custkey", "hit").filter(c("hit") | (c("c_acctbal") > 9000)).select("c_custkey")


@query("select c_custkey, (select max(o_totalprice) from orders) as top, (select n_name from nation where n_nationkey = -1) as none from customer where c_acctbal > (select avg(c_acctbal) from customer)")
def scalar_subquery(spark, d):
    cust = t(spark, d, "customer")
    top = R.scalar(t(spark, d, "orders").agg(F.max("o_totalprice").alias("top")), "top")
    none = R.scalar(t(spark, d, "nation").filter("n_nationkey = -1").select(c("n_name").alias("none")), "none")
    mean = cust.agg(F.avg("c_acctbal").alias("mean"))
    return cust.join(F.broadcast(mean), c("c_acctbal") > c("mean")).join(F.broadcast(top)).join(F.broadcast(none)).select("c_custkey", "top", "none")


@query("select o.o_orderkey from orders o where o.o_totalprice = (select max(x.o_totalprice) from orders x where x.o_custkey = o.o_custkey)")
def scalar_corr(spark, d):
    o = t(spark, d, "orders")
    best = o.groupBy(c("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("best"))
    return o.join(best, (c("o_custkey") == c("k")) & (c("o_totalprice") == c("best"))).select("o_orderkey")


@query("""select n.n_name from nation n where exists (select 1 from customer c where c.c_nationkey = n.n_nationkey and exists
  (select 1 from supplier s where s.s_nationkey = n.n_nationkey and s.s_acctbal > c.c_acctbal))""")
def nested_corr(spark, d):
    # the inner query reaches the outermost row: the same as one join on both conditions
    n = t(spark, d, "nation")
    low = t(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("low"))
    high = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("high"))
    return n.join(low, c("n_nationkey") == c("c_nationkey")).join(high, c("n_nationkey") == c("s_nationkey")).filter("high > low").select("n_name")


@query("select a.k, a.v as av, b.v as bv from (select c_nationkey as k, count(*) as v from customer group by 1) a join (select s_nationkey as k, count(*) as v from supplier group by 1) b on a.k = b.k where a.v > b.v")
def join_dup_names(spark, d):
    a = t(spark, d, "customer").groupBy(c("c_nationkey").alias("k")).agg(F.count("*").alias("v")).alias("a")
    b = t(spark, d, "supplier").groupBy(c("s_nationkey").alias("k")).agg(F.count("*").alias("v")).alias("b")
    return a.join(b, c("a.k") == c("b.k")).filter(c("a.v") > c("b.v")).select("a.k", c("a.v").alias("av"), c("b.v").alias("bv"))


@query("select a.n_name as x, b.n_name as y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def self_join(spark, d):
    a, b = t(spark, d, "nation").alias("a"), t(spark, d, "nation").alias("b")
    return a.join(b, (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("x"), c("b.n_name").alias("y"))


# ---------------------------------------------------------------- D. aggregation


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as q, round(avg(l_discount), 6) as d from lineitem group by l_returnflag, l_linestatus")
def group_agg(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.avg("l_discount"), 6).alias("d"))


@query("select count(*) as n, round(sum(o_totalprice), 2) as s, min(o_orderkey) as lo, max(o_orderkey) as hi from orders")
def global_agg(spark, d):
    return t(spark, d, "orders").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("select count(*) as n, max(o_custkey) as m, sum(o_totalprice) as s, avg(o_totalprice) as a from orders where 1 = 0")
def agg_empty(spark, d):
    return t(spark, d, "orders").filter(F.lit(False)).agg(F.count("*").alias("n"), F.max("o_custkey").alias("m"), F.sum("o_totalprice").alias("s"), F.avg("o_totalprice").alias("a"))


@query("select c_mktsegment, count(*) as n, count(nullif(c_nationkey, 3)) as known from customer group by c_mktsegment")
def agg_count(spark, d):
    return t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count(F.nullif(c("c_nationkey"), F.lit(3))).alias("known"))


@query("select p_brand, cast(sum(p_size) as bigint) as s, round(sum(p_retailprice), 2) as r, cast(sum(case when p_size < 0 then p_size end) as bigint) as none from part group by p_brand")
def agg_sum(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.sum("p_size").alias("s"), F.round(F.sum("p_retailprice"), 2).alias("r"), F.sum(F.when(c("p_size") < 0, c("p_size"))).alias("none"))


@query("select p_brand, round(avg(p_size), 6) as a, round(avg(nullif(p_size, 7)), 6) as b from part group by p_brand")
def agg_avg(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("a"), F.round(F.avg(F.nullif(c("p_size"), F.lit(7))), 6).alias("b"))


@query("select o_orderstatus, min(o_orderpriority) as a, max(o_orderpriority) as b, min(o_orderdate) as c, max(o_totalprice) as d from orders group by o_orderstatus")
def agg_minmax(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(F.min("o_orderpriority").alias("a"), F.max("o_orderpriority").alias("b"), F.min("o_orderdate").alias("c"), F.max("o_totalprice").alias("d"))


@query("select o_orderstatus, count(distinct o_custkey) as c, cast(sum(distinct o_custkey) as bigint) as s, round(avg(distinct o_custkey), 6) as a from orders group by o_orderstatus")
def agg_distinct(spark, d):
    # one row per (group, value) first, so that the distinct values are counted by plain partial aggregation
    one = t(spark, d, "orders").select("o_orderstatus", "o_custkey").distinct()
    return one.groupBy("o_orderstatus").agg(F.count("o_custkey").alias("c"), F.sum("o_custkey").alias("s"), F.round(F.avg("o_custkey"), 6).alias("a"))


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
def having(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12")


@query("select count(*) as n from orders having count(*) > 1000000000")
def having_no_group(spark, d):
    return t(spark, d, "orders").agg(F.count("*").alias("n")).filter("n > 1000000000")


@query("select l_orderkey % 10 as k, upper(l_returnflag) as f, count(*) as n from lineitem group by l_orderkey % 10, upper(l_returnflag)")
def group_expr(spark, d):
    return t(spark, d, "lineitem").groupBy((c("l_orderkey") % 10).alias("k"), F.upper("l_returnflag").alias("f")).agg(F.count("*").alias("n"))


@query("select case when c_acctbal > 0 then 'pos' else 'neg' end as k, count(*) as n from customer group by k")
def group_alias(spark, d):
    return t(spark, d, "customer").groupBy(F.when(c("c_acctbal") > 0, "pos").otherwise("neg").alias("k")).agg(F.count("*").alias("n"))


@query("select nullif(c_mktsegment, 'BUILDING') as k, count(*) as n, min(c_custkey) as m from customer group by 1")
def group_null(spark, d):
    return t(spark, d, "customer").groupBy(F.nullif(c("c_mktsegment"), F.lit("BUILDING")).alias("k")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("m"))


@query("select l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 4) as unit from lineitem group by l_returnflag")
def agg_ratio(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 4).alias("unit"))


@query("select distinct o_orderstatus, o_orderpriority from orders")
def distinct_rows(spark, d):
    return t(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


# ---------------------------------------------------------------- E. windows


@query("select o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderkey desc) as bigint) as rn from orders")
def win_row_number(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.row_number().over(R.ranking(["o_custkey"], [P.desc("o_orderkey")])).cast("bigint").alias("rn"))


@query("select p_partkey, cast(rank() over (partition by p_brand order by p_size asc nulls last) as bigint) as r from part")
def win_rank(spark, d):
    return t(spark, d, "part").select("p_partkey", F.rank().over(R.ranking(["p_brand"], [P.asc("p_size")])).cast("bigint").alias("r"))


@query("select p_partkey, cast(dense_rank() over (partition by p_brand order by nullif(p_size, 9) desc nulls first) as bigint) as r from part")
def win_dense_rank(spark, d):
    return t(spark, d, "part").select("p_partkey", F.dense_rank().over(R.ranking(["p_brand"], [P.desc(F.nullif(c("p_size"), F.lit(9)))])).cast("bigint").alias("r"))


@query("""select s_suppkey, round(sum(s_acctbal) over w, 2) as s, count(*) over w as n, min(s_acctbal) over w as lo, max(s_acctbal) over w as hi, round(avg(s_acctbal) over w, 4) as a
from supplier window w as (partition by s_nationkey)""")
def win_sum_partition(spark, d):
    w = R.over_partition("s_nationkey")
    x = c("s_acctbal")
    return t(spark, d, "supplier").select("s_suppkey", F.round(F.sum(x).over(w), 2).alias("s"), F.count("*").over(w).alias("n"), F.min(x).over(w).alias("lo"), F.max(x).over(w).alias("hi"), F.round(F.avg(x).over(w), 4).alias("a"))


@query("select n_name, count(*) over () as n, max(n_nationkey) over () as m from nation")
def win_over_empty(spark, d):
    return R.total_over(t(spark, d, "nation").select("n_name", "n_nationkey"), {"n": F.count("*"), "m": F.max("n_nationkey")}).select("n_name", "n", "m")


@query("""select c_custkey, c_custkey * 10 + row_number() over (partition by c_nationkey order by c_acctbal desc nulls first, c_custkey) as x,
  round(c_acctbal / max(abs(c_acctbal)) over (partition by c_nationkey), 6) as share from customer""")
def win_in_expr(spark, d):
    rn = F.row_number().over(R.ranking(["c_nationkey"], [P.desc("c_acctbal"), P.asc("c_custkey")]))
    return t(spark, d, "customer").select("c_custkey", (c("c_custkey") * 10 + rn).alias("x"), F.round(c("c_acctbal") / F.max(F.abs("c_acctbal")).over(Window.partitionBy("c_nationkey")), 6).alias("share"))


# ---------------------------------------------------------------- F. sort and limit


@query("select o_orderkey, nullif(o_orderstatus, 'F') as s from orders order by s asc nulls last, o_orderkey limit 20")
def sort_nulls(spark, d):
    return R.top_n(t(spark, d, "orders").select("o_orderkey", F.nullif(c("o_orderstatus"), F.lit("F")).alias("s")), [P.asc("s"), P.asc("o_orderkey")], 20)


@query("select p_partkey, p_size * 2 as twice from part order by twice desc nulls first, p_retailprice, length(p_name), 1 limit 25")
def sort_keys(spark, d):
    p = t(spark, d, "part").withColumn("twice", c("p_size") * 2)
    return R.top_n(p, [P.desc("twice"), P.asc("p_retailprice"), P.asc(F.length("p_name")), P.asc("p_partkey")], 25).select("p_partkey", "twice")


@query("select o_orderkey from orders order by o_orderkey limit 10 offset 30")
def limit_offset(spark, d):
    return R.top_n(t(spark, d, "orders").select("o_orderkey"), [P.asc("o_orderkey")], 10, 30)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls first, o_orderkey asc nulls last limit 10 offset 5")
def top_n(spark, d):
    return R.top_n(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [P.desc("o_totalprice"), P.asc("o_orderkey")], 10, 5)


# ---------------------------------------------------------------- G. set operations and CTEs


def _keys(spark, d):
    return t(spark, d, "customer").select(c("c_nationkey").alias("k")), t(spark, d, "supplier").select(c("s_nationkey").alias("k"))


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def union_distinct(spark, d):
    return R.union_distinct(*_keys(spark, d))


@query("select c_nationkey as k from customer union all select s_nationkey from supplier")
def union_all(spark, d):
    a, b = _keys(spark, d)
    return a.union(b)


@query("select nullif(c_nationkey, 4) as k from customer except select s_nationkey from supplier where s_nationkey < 12")
def except_distinct(spark, d):
    a, b = _keys(spark, d)
    return a.select(F.nullif(c("k"), F.lit(4)).alias("k")).subtract(b.filter("k < 12"))


@query("select c_nationkey as k from customer except all select s_nationkey from supplier")
def except_all(spark, d):
    a, b = _keys(spark, d)
    return a.exceptAll(b)


@query("select c_nationkey as k from customer where c_nationkey > 3 intersect select s_nationkey from supplier")
def intersect_distinct(spark, d):
    a, b = _keys(spark, d)
    return a.filter("k > 3").intersect(b)


@query("select c_nationkey as k from customer intersect all select s_nationkey from supplier")
def intersect_all(spark, d):
    a, b = _keys(spark, d)
    return a.intersectAll(b)


@query("select c_custkey as k from customer union select o_orderkey from orders order by k desc nulls first limit 15 offset 2")
def setop_order_limit(spark, d):
    return R.top_n(R.union_distinct(t(spark, d, "customer").select(c("c_custkey").alias("k")), t(spark, d, "orders").select("o_orderkey")), [P.desc("k")], 15, 2)


@query("""with big(k, v) as (select o_custkey, sum(o_totalprice) from orders group by 1), top as (select k from big where v > (select avg(v) from big))
select n_name, count(*) as n from top join customer on k = c_custkey join nation on c_nationkey = n_nationkey group by n_name""")
def cte_chain(spark, d):
    big = t(spark, d, "orders").groupBy(c("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    top = big.join(F.broadcast(big.agg(F.avg("v").alias("mean"))), c("v") > c("mean")).select("k")
    return top.join(t(spark, d, "customer"), c("k") == c("c_custkey")).join(t(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("with recursive r as (select cast(1 as bigint) as n union all select n + 1 from r where n < 50) select n, n * n as sq from r")
def cte_recursive(spark, d):
    return spark.sql("with recursive r(n) as (select cast(1 as bigint) union all select n + 1 from r where n < 50) select n, n * n as sq from r")


@query("""with recursive r(x, y) as (select n_nationkey, (n_nationkey * 7 + 3) % 25 from nation where n_nationkey < 5
union select r.y, (r.y * 7 + 3) % 25 from r) select x, y from r""")
def cte_recursive_distinct(spark, d):
    start = t(spark, d, "nation").filter("n_nationkey < 5").select(c("n_nationkey").alias("x"), ((c("n_nationkey") * 7 + 3) % 25).alias("y"))
    return recursive.fixpoint(start, lambda new: new.select(c("y").alias("x"), ((c("y") * 7 + 3) % 25).alias("y")), rows=1000)
