"""Queries whose text goes through the session: the engine's own semantics of SQL, constraints, conflicts, system relations, differences and copies."""

from __future__ import annotations

from collections.abc import Callable

from braidlake.errors import SqlError
from braidlake.kv import KV
from braidlake.plans.core import query, t
from braidlake.plans.versioned import _nations, _session
from braidlake.session import Session
from braidlake.storage import scratch


def _codes(spark, cases: dict[str, Callable]):
    """(what, code) of each case: the SQLSTATE it fails with, or ok."""
    rows = []
    for what, f in cases.items():
        try:
            f()
            rows.append((what, "ok"))
        except SqlError as e:
            rows.append((what, e.sqlstate))
    return spark.createDataFrame(rows, "what string, code string")


def _values(rows: dict[str, str]) -> str:
    return "select what, code from (values " + ", ".join(f"('{k}', '{v}')" for k, v in rows.items()) + ") v(what, code)"


def _numbers(spark, d) -> Session:
    s = _session(spark)
    s.sql("create table p (id bigint primary key, size int, price double, name text)")
    s.put("p", t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_name"))
    return s


@query("select p_partkey as id, cast(trunc((p_size - 25) / 7) as bigint) as a, p_retailprice / 2 as b, cast(trunc(trunc((p_size + 100) / 3) / 2) as bigint) as c from part")
def sql_division(spark, d):
    return _numbers(spark, d).sql("select id, (size - 25) / 7 as a, price / 2 as b, (size + 100) / 3 / 2 as c from p")


@query("select p_partkey as id, cast(p_size as bigint) * 1000000000 + 2000000000 as a, cast(p_size as bigint) - 2147483647 - 10 as b from part")
def sql_widening(spark, d):
    return _numbers(spark, d).sql("select id, size * 1000000000 + 2000000000 as a, size - 2147483647 - 10 as b from p")


@query("""select p_partkey as id, round(p_size / 2) as a, floor(p_retailprice) as b, cast(ceil(cast(p_size as double)) as double) as c, substr(p_name, 1, 3) as d, substr(p_name, 2, 4) as e,
cast(((p_size - 25) % 7 + 7) % 7 as bigint) as f, concat(p_name, nullif(p_size, 7), '-') as g, p_name || ' round(1)' as h from part""")
def sql_functions(spark, d):
    return _numbers(spark, d).sql("""select id, round(cast(size as double) / 2) as a, floor(price) as b, ceil(size) as c, substr(name, -5, 3) as d, substring(name from 2 for 4) as e,
mod(size - 25, 7) as f, concat(name, nullif(size, 7), '-') as g, trim(concat(' \t', name, ' \n')) || ' round(1)' as h from p""")


@query("select nullif(p_size, 7) as s, p_partkey as id from part order by s desc nulls first, id nulls last limit 30")
def sql_null_order(spark, d):
    return _numbers(spark, d).sql("select nullif(size, 7) as s, id from p order by s desc, id limit 30")


@query("select p_partkey as id, cast(sum(p_partkey) over (partition by p_size) as bigint) as total, row_number() over (partition by p_size order by nullif(p_partkey % 5, 0) nulls last, p_partkey) as place from part")
def sql_window_frame(spark, d):
    return _numbers(spark, d).sql("select id, sum(id) over (partition by size order by id) as total, row_number() over (partition by size order by nullif(id % 5, 0), id) as place from p")


@query("select c_custkey as id, c_custkey as twice, c_name as name from customer where c_custkey < 20")
def sql_row_ids(spark, d):
    s = _session(spark)
    s.sql("create table cust (id bigint primary key, name text)")
    s.put("cust", t(spark, d, "customer").select("c_custkey", "c_name"))
    return s.sql("select rowid, c.ctid as twice, name from cust c where _rowid_ < 20")


@query("with recursive r(n) as (select cast(1 as bigint) union select (n * 3) % 11 from r) select n from r")
def sql_recursive_union(spark, d):
    return _session(spark).sql("with recursive r(n) as (select 1 union select (n * 3) % 11 from r) select cast(n as bigint) as n from r")


@query(_values({"rows": "54000", "ends": "ok"}))
def sql_recursion_guard(spark, d):
    s = _session(spark)

    def rows() -> None:
        s.sql("set recursion_rows = 4")
        s.sql("with recursive r(n) as (select 1 union select n + 1 from r where n < 9) select n from r").collect()

    def ends() -> None:
        s.sql("set recursion_rows = 0")
        s.sql("with recursive r(n) as (select 1 union select n + 1 from r where n < 3) select n from r").collect()

    return _codes(spark, {"rows": rows, "ends": ends})


@query("select cast(n_nationkey as int) as k, cast(trunc(n_nationkey / 2) as int) as half, concat(n_name, '!') as name from nation where cast(trunc(n_nationkey / 4) as int) <> 3")
def sql_update_expressions(spark, d):
    s = _session(spark)
    s.sql("create table n (k int primary key, half int, name text)")
    s.put("n", t(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name"))
    s.sql("update n set half = k / 2, name = concat(name, null, '!')")
    s.sql("delete from n where k / 4 = 3")
    return s.sql("select * from n")


@query(_values({"not null": "23502", "check": "23514", "unique": "23505", "foreign key": "23503", "primary key": "23505", "duplicate": "23505", "good": "ok"}))
def dml_constraints(spark, d):
    s = _nations(spark, d)
    s.sql("create table o (id bigint primary key, pid int references n(k), v int check (v > 0), u text unique, w text not null)")
    s.sql("insert into o values (1, 1, 5, 'x', 'w')")
    put = lambda v: lambda: s.sql(f"insert into o values {v}")
    return _codes(
        spark,
        {
            "not null": put("(2, 1, 1, 'y', null)"),
            "check": put("(2, 1, 0, 'y', 'w')"),
            "unique": put("(2, 1, 1, 'x', 'w')"),
            "foreign key": put("(2, 99, 1, 'y', 'w')"),
            "primary key": put("(1, 1, 1, 'y', 'w')"),
            "duplicate": put("(3, 1, 1, null, 'w'), (3, 1, 1, null, 'w')"),
            "good": put("(2, null, null, null, 'w'), (3, 24, 1, 'z', 'w')"),
        },
    )


@query(_values({"same row": "40001", "same unique value": "23505", "parent gone": "23503", "other rows": "ok", "after a failure": "25P02"}))
def txn_conflicts(spark, d):
    s = _nations(spark, d)
    s.sql("create table o (id bigint primary key, pid int references n(k), u text unique)")
    s.sql("insert into o values (1, 1, 'a'), (2, 2, 'b')")
    other = Session(spark, s.catalog.root)

    def both(mine: str, theirs: str) -> Callable[[], None]:
        def run() -> None:
            s.sql("begin")
            s.sql(mine)
            other.sql(theirs)
            s.sql("commit")

        return run

    def failed() -> None:
        s.sql("begin")
        try:
            s.sql("insert into o values (1, 1, 'again')")
        except SqlError:
            pass
        try:
            s.sql("select * from o")
        finally:
            s.sql("rollback")

    return _codes(
        spark,
        {
            "same row": both("update o set u = 'x' where id = 1", "update o set u = 'y' where id = 1"),
            "same unique value": both("insert into o values (10, 1, 'u')", "insert into o values (11, 1, 'u')"),
            "parent gone": both("insert into o values (12, 24, 'p')", "delete from n where k = 24"),
            "other rows": both("update o set u = 'z' where id = 1", "update o set u = 'w' where id = 2"),
            "after a failure": failed,
        },
    )


@query("select cast(n_nationkey as int) as k, n_name as name from nation union all select 50, 'left' union all select 51, 'right' union all select 99, 'late'")
def merge_keeps_commits(spark, d):
    """A commit of another session while MERGE is at work is kept."""
    s = _nations(spark, d)
    s.sql("create branch dev")
    s.sql("insert into n values (50, 'left', 1)")
    s.sql("use branch dev")
    s.sql("insert into n values (51, 'right', 1)")
    s.sql("use branch main")
    other, write, done = Session(spark, s.catalog.root), s.catalog._commit, []

    def slow(tables, parents, branch, message, *rest):
        if message.startswith("merge") and not done:
            done.append(True)
            other.sql("insert into n values (99, 'late', 1)")
        return write(tables, parents, branch, message, *rest)

    s.catalog._commit = slow
    s.sql("merge branch dev into main")
    s.catalog._commit = write
    return s.sql("select k, name from n")


@query(_values({"unique": "23505", "conflict": "40001"}))
def merge_checks(spark, d):
    s = _session(spark)
    s.sql("create table u (id bigint primary key, v text unique)")
    s.sql("insert into u values (1, 'a')")
    s.sql("create branch dev")
    s.sql("insert into u values (2, 'same')")
    s.sql("use branch dev")
    s.sql("insert into u values (3, 'same')")
    s.sql("use branch main")
    out = {"unique": lambda: s.sql("merge branch dev into main")}

    def conflict() -> None:
        s.sql("create branch other")
        s.sql("update u set v = 'm' where id = 1")
        s.sql("use branch other")
        s.sql("update u set v = 'o' where id = 1")
        s.sql("use branch main")
        s.sql("merge branch other into main")

    return _codes(spark, out | {"conflict": conflict})


@query("select cast(n_nationkey as int) as k, case when n_nationkey = 4 then null else n_name end as before, case when n_nationkey = 3 then 'three' when n_nationkey = 2 then null else n_name end as after from nation where n_nationkey in (2, 3) union all select 70, null, 'new'")
def version_difference(spark, d):
    s = _nations(spark, d)
    old = s._entry("n")
    s.sql("update n set name = 'three' where k = 3")
    s.sql("update n set name = name where k = 5")
    s.sql("delete from n where k = 2")
    s.sql("insert into n values (70, 'new', 0)")
    return s.catalog.difference(old, s._entry("n")).selectExpr("k", "old.name as before", "new.name as after")


@query("select 'main' as b, cast(n_nationkey as int) as k, n_name as name from nation where n_nationkey <> 1 union all select 'dev', n_nationkey, n_name from nation")
def backup_copy(spark, d):
    s = _nations(spark, d)
    s.sql("create branch dev")
    s.sql("delete from n where k = 1")
    there = scratch(spark, "backup")
    s.catalog.backup(there)
    s.sql("delete from n where k > 1")
    copy = Session(spark, there)
    main = copy.sql("select 'main' as b, k, name from n")
    copy.sql("use branch dev")
    return main.union(copy.sql("select 'dev' as b, k, name from n"))


@query("select cast(n_nationkey as int) as k, n_name as name from nation union all select 60, 'open'")
def vacuum_open_transaction(spark, d):
    s = _nations(spark, d)
    s.sql("begin")
    s.sql("insert into n values (60, 'open', 1)")
    Session(spark, s.catalog.root).catalog.vacuum()
    s.sql("commit")
    return s.sql("select k, name from n")


@query("select 'a' as k, '2' as v, true as done union all select 'b', null, false union all select 'c', '1', true")
def kv_cas(spark, d):
    kv = KV(_session(spark))
    kv.put(b"a", b"1")
    done = {b"a": kv.cas(b"a", b"1", b"2"), b"b": kv.cas(b"b", b"1", b"2"), b"c": kv.cas(b"c", None, b"1")}
    rows = [(k.decode(), None if (v := kv.get(k)) is None else v.decode(), x) for k, x in done.items()]
    return spark.createDataFrame(rows, "k string, v string, done boolean")


@query("select what, cast(n as bigint) as n from (values ('branches', 2), ('columns', 3), ('tables', 1), ('commit_log', 2), ('memory_usage', 1), ('pg_settings', 3), ('after drop', 1)) v(what, n)")
def system_relations(spark, d):
    s = _nations(spark, d)
    s.sql("create branch dev")
    count = lambda name: s.sql(f"select count(*) from {name}").first()[0]
    rows = [(x, count(x)) for x in ("branches", "columns", "tables", "commit_log", "pg_settings")] + [("memory_usage", min(1, count("memory_usage")))]
    s.sql("drop branch dev")
    return spark.createDataFrame([*rows, ("after drop", count("branches"))], "what string, n long")


@query(_values({"same": "true", "other": "false", "text": "true"}))
def plan_compare(spark, d):
    s = _nations(spark, d)
    same = s.same_plan("select k + 1 as x from n where k > 3", "select (k + 1) as x from n where (k > 3)")
    other = s.same_plan("select k from n where k > 3", "select k from n where k > 4")
    text = s.plan_text("select k from n where k > 3")
    return spark.createDataFrame([("same", str(same).lower()), ("other", str(other).lower()), ("text", str("Filter" in text).lower())], "what string, code string")


@query(_values({"cursors": "54000", "branches": "54000", "prepared": "54000", "transaction": "54000"}))
def session_limits(spark, d):
    s = _nations(spark, d)
    s.limits |= {"cursors": 1, "branches": 2, "prepared": 1, "transaction_rows": 10}

    def cursors() -> None:
        s.sql("declare a cursor for select k from n")
        s.sql("declare b cursor for select k from n")

    def branches() -> None:
        s.sql("create branch b1")
        s.sql("create branch b2")

    def prepared() -> None:
        s.prepare("a", "select 1")
        s.prepare("b", "select 1")

    def transaction() -> None:
        s.sql("begin")
        try:
            s.sql("update n set r = 1")
        finally:
            s.sql("rollback")

    return _codes(spark, {"cursors": cursors, "branches": branches, "prepared": prepared, "transaction": transaction})

