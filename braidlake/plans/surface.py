"""Queries over what surrounds the rows: expressions in constraints, table life cycles, rights, options, prepared statements, plans, streams and cursors."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidlake import streaming
from braidlake.kv import KV
from braidlake.plans.core import query, t
from braidlake.plans.statements import _codes, _values
from braidlake.plans.versioned import _nations, _session
from braidlake.session import Session
from braidlake.sources import parquet as files
from braidlake.storage import scratch


@query(_values({"half of three": "23514", "half of four": "ok", "null": "ok", "update": "23514"}))
def check_expressions(spark, d):
    s = _session(spark)
    s.sql("create table h (id bigint primary key, v int check (v / 2 > 1), w text check (concat(w, null) <> ''))")
    return _codes(
        spark,
        {
            "half of three": lambda: s.sql("insert into h values (1, 3, 'w')"),
            "half of four": lambda: s.sql("insert into h values (1, 4, 'w')"),
            "null": lambda: s.sql("insert into h values (2, null, 'w')"),
            "update": lambda: s.sql("update h set w = '' where id = 1"),
        },
    )


@query("""select cast(n_nationkey as int) as k, case when n_nationkey between 6 and 9 then n_name || '+new' else n_name end as name,
case when n_nationkey between 6 and 9 then cast(trunc(n_nationkey / 2) as int) else n_regionkey end as r from nation""")
def upsert_expressions(spark, d):
    s = _nations(spark, d)
    s.put("n", t(spark, d, "nation").filter("n_nationkey < 10").selectExpr("n_nationkey", "'new'", "n_nationkey"), None, "update", {"name": "concat(name, null, '+', excluded.name)", "r": "excluded.r / 2"}, "k / 3 > 1")
    return s.sql("select * from n")


@query(_values({"index": "ok", "index again": "42P07", "index of no column": "42703", "drop index": "ok", "no index": "42P01", "unique index": "23505", "truncate": "ok", "drop": "ok", "no table": "42P01", "if exists": "ok", "in a transaction": "25001"}))
def table_life(spark, d):
    s = _nations(spark, d)
    run = lambda *texts: lambda: [s.sql(x).collect() for x in texts]

    def inside() -> None:
        s.sql("begin")
        try:
            s.sql("create table x (k int primary key)")
        finally:
            s.sql("rollback")

    return _codes(
        spark,
        {
            "index": run("create index i on n (name)", "create index if not exists i on n (name)"),
            "index again": run("create index i on n (r)"),
            "index of no column": run("create index j on n (nothing)"),
            "drop index": run("drop index i", "drop index if exists i"),
            "no index": run("drop index i"),
            "unique index": run("create unique index u on n (r)"),
            "truncate": run("truncate table n", "insert into n values (1, 'one', 1)"),
            "drop": run("drop table n"),
            "no table": run("select * from n"),
            "if exists": run("drop table if exists n", "create table n (k int primary key)", "create table if not exists n (k int primary key)"),
            "in a transaction": inside,
        },
    )


@query(_values({"read": "42501", "read by grant": "ok", "write": "42501", "write by public grant": "ok", "delete": "42501", "read after revoke": "42501", "grant by another": "42501"}))
def rights(spark, d):
    s = _nations(spark, d)
    bob = Session(spark, s.catalog.root, user="bob", superuser=False)
    read, write = "select count(*) from n", "insert into n values (90, 'bob', 1)"

    def after(text: str, then: str):
        def run() -> None:
            s.sql(text)
            bob.sql(then).collect()

        return run

    return _codes(
        spark,
        {
            "read": lambda: bob.sql(read),
            "read by grant": after("grant select on n to bob", read),
            "write": lambda: bob.sql(write),
            "write by public grant": after("grant insert on n to public", write),
            "delete": lambda: bob.sql("delete from n where k = 90"),
            "read after revoke": after("revoke select on n from bob", read),
            "grant by another": lambda: bob.sql("grant all on n to bob"),
        },
    )


@query("select 'timeout' as what, '60000' as code union all select 'branch', 'main' union all select 'branches', 'dev,main' union all select 'gone', '3D000' union all select 'main stays', '22023' union all select 'tables', 'n' union all select 'plan', 'Scan' union all select 'rows', 'rows: ' || (select count(*) from nation where n_nationkey > 3)")
def show_and_explain(spark, d):
    s = _nations(spark, d)
    s.sql("set statement_timeout = 60000")
    one = lambda text, k=1: s.sql(text).first()[k]
    out = [("timeout", one("show statement_timeout")), ("branch", one("show branch"))]
    s.sql("set statement_timeout = 0")
    s.sql("create branch dev")
    out.append(("branches", ",".join(sorted(r["branch"] for r in s.sql("show branches").collect()))))
    s.sql("drop branch dev")
    failed = _codes(spark, {"gone": lambda: s.sql("use branch dev"), "main stays": lambda: s.sql("drop branch main")})
    out += [("tables", one("show tables", 0)), ("plan", "Scan" if any("Scan" in r[0] for r in s.sql("explain select k from n").collect()) else "")]
    out.append(("rows", one("explain analyze select k from n where k > 3", 0)))
    return spark.createDataFrame(out, "what string, code string").union(failed)


@query(_values({"slow": "57014", "quick": "ok"}))
def statement_timeout(spark, d):
    s = _session(spark)

    def slow() -> None:
        s.sql("set statement_timeout = 200")
        s.sql("select count(*) from range(1000000000000) where id % 7 = 3")

    def quick() -> None:
        s.sql("set statement_timeout = 60000")
        s.sql("select 1")

    return _codes(spark, {"slow": slow, "quick": quick})


@query("select cast(n_nationkey as int) as k, n_name as name from nation where n_nationkey >= 5 and n_regionkey = 1 union all select n_nationkey, n_name from nation where n_nationkey >= 20 and n_regionkey = 2 union all select 77, 'put'")
def prepared_statements(spark, d):
    s = _nations(spark, d)
    s.prepare("q", "select k, name from n where k >= $1 and r = $2 and k < 50")
    s.prepare("i", "insert into n values (?, ?, ?)")
    s.run_prepared("i", [77, "put", 1]).collect()
    return s.run_prepared("q", [5, 1]).union(s.run_prepared("q", [20, 2])).union(s.sql("select k, name from n where k = 77"))


@query("select 'main' as b, 'a' as k, '1' as v union all select 'dev', 'a', '2' union all select 'dev', 'b', '3'")
def kv_branches(spark, d):
    kv = KV(_session(spark))
    kv.put(b"a", b"1")
    kv.begin()
    kv.put(b"lost", b"x")
    kv.rollback()
    kv.session.sql("create branch dev")
    kv.use_branch("dev")
    kv.begin()
    kv.put(b"a", b"2")
    kv.put(b"b", b"3")
    kv.commit()
    shown = lambda b: kv.scan().select(F.lit(b).alias("b"), F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"))
    dev = shown("dev")
    kv.use_branch("main")
    return dev.union(shown("main"))


@query("select cast(n_nationkey as bigint) as k, cast(trunc(n_nationkey / 2) as bigint) as half, n_name || ';' as name from nation where n_nationkey > 1")
def sql_unparse(spark, d):
    s = _nations(spark, d)
    return s.spark.sql(s.unparse("select cast(k as bigint) as k, cast(k as bigint) / 2 as half, concat(name, null, ';') as name from n where rowid > 1 order by half desc"))


@query("select event_id as id, user_id as u, value as v from events union all select 0 - 1, 0 - 1, 0.5")
def stream_to_table(spark, d):
    """Rows that a stream brings again replace themselves; others stay."""
    s = _session(spark)
    s.sql("create table e (id bigint primary key, u bigint, v double)")
    s.sql("insert into e values (-1, -1, 0.5)")
    s.put("e", t(spark, d, "events").filter("event_id % 10 = 1").selectExpr("event_id", "-2", "0"))
    schema = t(spark, d, "events").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    arriving = streaming.read(s.spark, d, schema, "events.parquet").selectExpr("event_id as id", "user_id as u", "value as v")
    streaming.to_table(arriving, s, "e", scratch(spark, "stream")).awaitTermination()
    return s.sql("select id, u, v from e")


@query("""with w as (select date_trunc('hour', ts) as h, event_type, count(*) as n, max(event_id) as last from events group by all)
select strftime(h, '%Y-%m-%d %H:%M') as hour, event_type, n, last from w where h + interval 1 hour <= (select max(ts) - interval 2 hour from events)""")
def stream_windows(spark, d):
    """Windows that the watermark has passed are written, each once; the others stay in the state."""
    out, events = scratch(spark, "windows"), t(spark, d, "events")
    schema = events.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    arriving = streaming.read(spark, d, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streaming.windowed(arriving, "ts", "1 hour", "2 hours", ["event_type"], {"n": F.count("*"), "last": F.max("event_id")})
    found = found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", "last")
    found.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("hour string, event_type string, n long, last long").parquet(out)


@query("select cast(n_nationkey as int) as k, n_name as name, false as gone from nation union all select 3, 'three', false union all select n_nationkey, n_name, true from nation where n_nationkey = 4")
def stream_changes(spark, d):
    s = _nations(spark, d)
    s.sql("create table other (k int primary key, name text)")
    s.sql("update n set name = 'three' where k = 3")
    s.sql("insert into other values (1, 'not in the stream')")
    s.sql("delete from n where k = 4")
    out = scratch(spark, "changes")
    log = streaming.changes(s, "n").select("k", "name", F.col(streaming.DELETED).alias("gone"))
    log.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("k int, name string, gone boolean").parquet(out)


@query("select 'batches' as way, count(*) as n, cast(sum(n_nationkey) as bigint) as total, 10 as most from nation union all select 'rows', 5, 0 + 1 + 2 + 3 + 4, 1")
def cursor_streams(spark, d):
    """Arrow batches of a bounded size, and a row cursor that is left early."""
    nations = t(spark, d, "nation").select("n_nationkey")
    parts = [(b.num_rows, sum(b.column(0).to_pylist())) for b in streaming.batches(nations, 10)]
    it = streaming.rows(nations.orderBy("n_nationkey"))
    first = [next(it)[0] for _ in range(5)]
    rows = [("batches", sum(n for n, _ in parts), sum(x for _, x in parts), max(n for n, _ in parts)), ("rows", len(first), sum(first), 1)]
    return spark.createDataFrame(rows, "way string, n long, total long, most int")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey < 200 and o_orderstatus = 'F'")
def sink_row_groups(spark, d):
    """Sorted files of small row groups by partitions: a filter on key and partition reads few of them."""
    path = scratch(spark, "groups")
    files.write(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, sort=["o_orderkey"], partition=["o_orderstatus"], group_bytes=1 << 16, codec="zstd")
    return files.read(spark, path, ["o_orderkey", "o_orderstatus", "o_totalprice"]).filter("o_orderkey < 200 and o_orderstatus = 'F'")
