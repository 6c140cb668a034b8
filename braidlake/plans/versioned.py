"""Queries through the versioned SQL session: DDL, DML, branches, merge, time travel, transactions, key-value and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidlake.kv import KV
from braidlake.plans.core import c, query, t
from braidlake.session import Session
from braidlake.sources import parquet as files
from braidlake.sources.csv import write_csv
from braidlake.storage import scratch


def _session(spark) -> Session:
    return Session(spark, scratch(spark, "engine"))


def _nations(spark, d) -> Session:
    s = _session(spark)
    s.sql("create table n (k int primary key, name text not null, r int)")
    s.put("n", t(spark, d, "nation"))
    return s


@query("select n_nationkey as k, case when n_nationkey < 5 then 'X' || n_name else n_name end as name, n_regionkey as r from nation where n_nationkey <> 7")
def dml_update_delete(spark, d):
    s = _nations(spark, d)
    s.sql("update n set name = 'X' || name where k < 5")
    s.sql("delete from n where k = 7")
    return s.sql("select * from n")


@query("select n_nationkey as k, case when n_nationkey < 3 then 'new' || n_nationkey || n_name else n_name end as name, n_regionkey as r from nation union all select 100, 'fresh', 1")
def dml_upsert(spark, d):
    s = _nations(spark, d)
    s.sql("insert into n values (0, 'new0', 9), (1, 'new1', 9), (2, 'new2', 9), (100, 'fresh', 1) on conflict (k) do update set name = excluded(name) || name")
    s.sql("insert into n values (3, 'lost', 9) on conflict do nothing")
    return s.sql("select * from n")


@query("select n_nationkey + 1000 as k, upper(n_name) as name, cast(null as int) as r from nation where n_regionkey = 1")
def dml_insert_select(spark, d):
    s = _nations(spark, d)
    s.sql("create table m (k int primary key, name text, r int)")
    s.sql("insert into m (name, k) select upper(name), k + 1000 from n where r = 1")
    return s.sql("select * from m")


@query("select n_nationkey as k, n_name as name, n_regionkey as r, cast(null as varchar) as note, cast(null as double) as score from nation where n_nationkey > 1 union all select 500, 'late', 0, 'hello', 1.5")
def ddl_add_column(spark, d):
    s = _nations(spark, d)
    s.sql("alter table n add column note text")
    s.sql("attach extension marks (score double) to n")
    s.sql("insert into n values (500, 'late', 0, 'hello', 1.5)")
    s.sql("delete from n where k < 2")
    return s.sql("select * from n")


@query("select 'main' as b, n_nationkey as k, n_name as name from nation union all select 'dev', n_nationkey, case when n_nationkey = 3 then 'three' else n_name end from nation where n_nationkey <> 4")
def branch_isolation(spark, d):
    s = _nations(spark, d)
    s.sql("create branch dev from main")
    s.sql("use branch dev")
    s.sql("update n set name = 'three' where k = 3")
    s.sql("delete from n where k = 4")
    dev = s.sql("select 'dev' as b, k, name from n")
    s.sql("use branch main")
    return s.sql("select 'main' as b, k, name from n").union(dev)


@query("""select n_nationkey as k, case when n_nationkey % 5 = 0 then 'left' when n_nationkey % 5 = 1 then 'right' when n_nationkey = 12 then 'both' else n_name end as name, n_regionkey as r
from nation where n_nationkey not in (3, 13) union all select 200, 'added', 1""")
def merge_branches(spark, d):
    s = _nations(spark, d)
    s.sql("create branch dev")
    s.sql("update n set name = 'left' where k % 5 = 0")
    s.sql("update n set name = 'both' where k = 12")
    s.sql("delete from n where k = 3")
    s.sql("use branch dev")
    s.sql("update n set name = 'right' where k % 5 = 1")
    s.sql("update n set name = 'both' where k = 12")
    s.sql("delete from n where k = 13")
    s.sql("insert into n values (200, 'added', 1)")
    s.sql("use branch main")
    s.sql("merge branch dev into main")
    return s.sql("select * from n")


@query("select 'then' as at, count(*) as n, min(n_name) as first from nation union all select 'now', count(*), min(n_name) from nation where n_nationkey > 9")
def time_travel(spark, d):
    s = _nations(spark, d)
    name = s.sql("checkpoint").first()["commit"]
    s.sql("delete from n where k <= 9")
    s.sql("checkpoint")
    then = s.sql(f"select 'then' as at, count(*) as n, min(name) as first from n for system_time as of '{name}'")
    return then.union(s.sql("select 'now' as at, count(*) as n, min(name) as first from n"))


@query("select height, message from (values (0, 'root'), (1, 'checkpoint'), (2, 'checkpoint')) v(height, message)".replace("select height", "select cast(height as bigint) as height"))
def commit_log(spark, d):
    s = _nations(spark, d)
    s.sql("checkpoint")
    s.sql("delete from n where k = 1")
    s.sql("checkpoint")
    return s.sql("select height, message from commit_log")


@query("select n_nationkey as k, n_name as name, n_regionkey as r from nation where n_nationkey <> 2 union all select 300, 'kept', 1")
def transactions(spark, d):
    s = _nations(spark, d)
    s.execute("begin; delete from n where k = 1; rollback; begin; delete from n where k = 2; insert into n values (300, 'kept', 1); commit")
    return s.sql("select * from n")


@query("select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey where n_nationkey > 2 group by r_name")
def view_query(spark, d):
    s = _nations(spark, d)
    s.sql("create table r (k int primary key, name text)")
    s.put("r", t(spark, d, "region"))
    s.sql("create view late as select * from n where k > 2")
    s.sql("create view named as select r.name as r_name, late.k from late join r on late.r = r.k")
    return s.sql("select r_name, count(*) as n from named group by r_name")


@query("select c_custkey as id, c_name || chr(10) || '\"q\", x' as name, case when c_custkey % 10 = 0 then null else c_acctbal end as bal from customer")
def copy_csv(spark, d):
    s = _session(spark)
    path = scratch(spark, "csv")
    rows = t(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit('\n"q", x')), F.when(c("c_custkey") % 20 == 0, F.lit("bad")).when(c("c_custkey") % 10 == 0, F.lit("")).otherwise(c("c_acctbal").cast("string")))
    write_csv(rows, path)
    s.sql("create table cust (id bigint primary key, name text, bal double)")
    s.sql(f"copy cust from '{path}'")
    return s.sql("select * from cust")


@query("select o_orderkey, o_totalprice from orders where o_orderkey between 50 and 90")
def sink_parquet(spark, d):
    path = scratch(spark, "sink")
    files.write(t(spark, d, "orders"), path, sort=["o_orderkey"])
    return files.read(spark, path, ["o_orderkey", "o_totalprice"]).filter("o_orderkey between 50 and 90")


@query("select encode(n_name) as k, encode(cast(n_regionkey as varchar)) as v from nation where n_name >= 'NATION_1' and n_name < 'NATION_2' and n_nationkey <> 10 order by 1")
def kv_scan(spark, d):
    kv = KV(_session(spark))
    kv.put_all(t(spark, d, "nation").select(c("n_name").cast("binary").alias("k"), c("n_regionkey").cast("string").cast("binary").alias("v")))
    kv.delete(t(spark, d, "nation").filter("n_nationkey = 10").first()["n_name"].encode())
    return kv.scan(b"NATION_1", b"NATION_2")


@query("select count(*) as \"rows\", count(distinct n_regionkey) as regions, min(n_name) as first, max(n_name) as last from nation")
def analyze_stats(spark, d):
    s = _nations(spark, d)
    s.sql("analyze n")
    x = s._entry("n")["stats"]
    return spark.createDataFrame([(x["rows"], x["columns"]["r"]["distinct"], x["columns"]["name"]["min"], x["columns"]["name"]["max"])], "rows long, regions long, first string, last string")


@query("select 1 as k, 'a' as what where false union all select cast(n_nationkey as int), n_name from nation where n_nationkey in (3, 4, 5)")
def cursor_fetch(spark, d):
    s = _nations(spark, d)
    s.sql("declare x cursor for select k, name as what from n order by k")
    s.sql("fetch 3 from x")
    return s.sql("fetch 3 from x")
