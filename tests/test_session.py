import random

import pytest

from braidlake.errors import SqlError
from braidlake.kv import KV
from braidlake.session import Session


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}/engine")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def fails(state, f):
    with pytest.raises(SqlError) as e:
        f()
    assert e.value.sqlstate == state


def test_constraints(s):
    s.sql("create table p (id bigint primary key, name text not null)")
    s.sql("create table o (id bigint primary key, pid bigint references p(id), v int check (v > 0), u text unique, check (v < id * 100))")
    s.sql("insert into p values (1, 'a'), (2, 'b')")
    s.sql("insert into o values (1, 1, 5, 'x'), (2, null, null, null), (3, 2, 7, null)")
    fails("23502", lambda: s.sql("insert into p values (3, null)"))
    fails("23505", lambda: s.sql("insert into p values (1, 'again')"))
    fails("23505", lambda: s.sql("insert into p values (4, 'a'), (4, 'b')"))
    fails("23503", lambda: s.sql("insert into o values (4, 9, 1, 'y')"))
    fails("23514", lambda: s.sql("insert into o values (4, 1, 0, 'y')"))
    fails("23514", lambda: s.sql("insert into o values (4, 1, 400, 'y')"))
    fails("23505", lambda: s.sql("insert into o values (4, 1, 1, 'x')"))
    fails("23502", lambda: s.sql("update p set name = null where id = 1"))
    fails("23505", lambda: s.sql("update o set u = 'x' where id = 3"))
    fails("0A000", lambda: s.sql("update p set id = 9"))
    fails("42601", lambda: s.sql("insert into p values (1)"))
    fails("42703", lambda: s.sql("insert into p (id, nope) values (1, 2)"))
    fails("42P01", lambda: s.sql("select * from missing"))
    fails("42P07", lambda: s.sql("create table p (id int primary key)"))
    fails("42601", lambda: s.sql("create table q (id int)"))
    s.sql("delete from p where id = 2")
    s.sql("insert into p values (2, 'back')")
    assert rows(s.sql("select * from p")) == [(1, "a"), (2, "back")]
    assert len(rows(s.sql("select * from o"))) == 3


def test_types_and_errors(s):
    s.sql("create table e (id bigint primary key, s text, n bigint, f double, b bytea, d date, t timestamp, k boolean)")
    s.sql("insert into e values (1, '', 9223372036854775807, 1.5, X'00ff', date '2020-01-02', timestamp_ntz '2020-01-02 03:04:05', true), (2, null, null, null, null, null, null, null)")
    assert s.sql("select count(*) from e where s = ''").first()[0] == 1
    s.sql("create table z (id bigint primary key)")
    fails("22003", lambda: s.sql("insert into z select n + 1 from e where id = 1"))
    fails("22012", lambda: s.sql("insert into z select id div 0 from e"))
    fails("0A000", lambda: s.sql("create table w (id geometry primary key)"))


def test_upsert(s):
    s.sql("create table up (id bigint primary key, v int, w text)")
    s.sql("insert into up values (1, 10, 'x')")
    assert s.sql("insert into up values (1, 99, 'z'), (2, 20, 'y') on conflict do nothing").first()["affected"] == 1
    s.sql("insert into up values (1, 5, 'q') on conflict (id) do update set v = v + 1, w = excluded(w)")
    assert rows(s.sql("select * from up")) == [(1, 11, "q"), (2, 20, "y")]
    s.sql("insert into up values (1, 5, 'r'), (2, 6, 's') on conflict (id) do update set v = excluded.v where up.v > 15")
    assert rows(s.sql("select * from up")) == [(1, 11, "q"), (2, 6, "y")]


def test_branches(s):
    s.sql("create table d (id bigint primary key, body text)")
    s.sql("insert into d values (1, 'one'), (2, 'two')")
    s.sql("create branch dev")
    s.sql("use branch dev")
    s.sql("update d set body = 'dev' where id = 1")
    s.sql("use branch main")
    assert rows(s.sql("select body from d")) == [("one",), ("two",)]
    s.sql("update d set body = 'main' where id = 1")
    before = s.catalog.head("main")[1]
    fails("40001", lambda: s.sql("merge branch dev into main"))
    assert rows(s.sql("select body from d")) == [("main",), ("two",)]
    assert before["tables"] == s.catalog.head("main")[1]["tables"]
    assert {r["branch"] for r in s.sql("show branches").collect()} == {"main", "dev"}
    s.sql("drop branch dev")
    fails("3D000", lambda: s.sql("use branch dev"))
    fails("22023", lambda: s.sql("drop branch main"))
    s.sql("drop branch if exists dev")


def test_time_travel(s):
    s.sql("create table tt (id bigint primary key, v text)")
    s.sql("insert into tt values (1, 'a'), (2, 'b')")
    first = s.sql("checkpoint").first()["commit"]
    s.sql("insert into tt values (3, 'c')")
    ts = s.catalog.commit(first)["ts_ms"]
    count = lambda when: s.sql(f"select count(*) from tt for system_time as of '{when}'").first()[0]
    assert count("2999-01-01 00:00:00") == 2  # what is not yet checkpointed is not seen
    s.sql("checkpoint")
    assert (count(first), count(ts), count("2999-01-01 00:00:00")) == (2, 2, 3)
    fails("22023", lambda: count(ts - 1))
    fails("22023", lambda: count("rubbish"))
    s.sql("create view v as select * from tt")
    fails("0A000", lambda: s.sql(f"select * from v for system_time as of '{first}'"))
    assert [r["height"] for r in s.sql("select * from commit_log order by height").collect()] == [0, 1, 2]


def test_transactions(spark, s):
    s.sql("create table x (id bigint primary key, v int)")
    s.sql("insert into x values (1, 1), (2, 2), (3, 3)")
    other = Session(spark, s.catalog.root)
    s.sql("begin")
    s.sql("update x set v = 10 where id = 1")
    assert rows(s.sql("select v from x where id = 1")) == [(10,)]
    assert rows(other.sql("select v from x where id = 1")) == [(1,)]
    other.sql("update x set v = 20 where id = 2")
    s.sql("commit")  # other rows: no conflict
    assert rows(other.sql("select * from x")) == [(1, 10), (2, 20), (3, 3)]
    s.sql("begin")
    s.sql("update x set v = 0 where id = 3")
    other.sql("delete from x where id = 3")
    fails("40001", lambda: s.sql("commit"))
    assert rows(s.sql("select * from x")) == [(1, 10), (2, 20)]
    s.sql("begin")
    fails("23505", lambda: s.sql("insert into x values (1, 1)"))
    fails("25P02", lambda: s.sql("select * from x"))
    assert s.sql("commit").first()["tag"] == "ROLLBACK"
    s.sql("begin")
    fails("25001", lambda: s.sql("create table y (id int primary key)"))
    s.sql("rollback")


def test_cursors_and_parameters(s):
    s.sql("create table n (id bigint primary key)")
    s.sql("insert into n select id from range(10)")
    s.sql("declare c cursor for select id from n order by id")
    s.sql("delete from n where id > 3")  # the cursor does not see it
    assert rows(s.sql("fetch 4 from c")) == [(0,), (1,), (2,), (3,)]
    assert rows(s.sql("fetch next from c")) == [(4,)]
    assert len(rows(s.sql("fetch all from c"))) == 5
    s.sql("close c")
    fails("34000", lambda: s.sql("fetch 1 from c"))
    assert rows(s.sql("select id from n where id > $2 and id < $1", [3, 0])) == [(1,), (2,)]
    s.prepare("q", "select id from n where id = ?")
    assert rows(s.run_prepared("q", [2])) == [(2,)]


def test_grants(spark, s):
    s.sql("create table g (id bigint primary key)")
    u = Session(spark, s.catalog.root, user="bob", superuser=False)
    fails("42501", lambda: u.sql("select * from g"))
    s.sql("grant select, insert on g to bob")
    u.sql("insert into g values (1)")
    assert rows(u.sql("select * from g")) == [(1,)]
    fails("42501", lambda: u.sql("delete from g"))
    s.sql("revoke select on g from bob")
    fails("42501", lambda: u.sql("select * from g"))


def test_views_ddl_explain(s):
    s.sql("create table a (id bigint primary key, v int)")
    s.sql("insert into a values (1, 1), (2, null)")
    s.sql("create view v1 as select id from a where v is null")
    s.sql("create view v2 as select id + 1 as id from v1")
    assert rows(s.sql("select * from v2")) == [(3,)]
    fails("42P07", lambda: s.sql("create view v1 as select 1 as x"))
    s.sql("create or replace view v1 as select id from a")
    assert len(rows(s.sql("select * from v2"))) == 2
    s.sql("attach extension e (note text) to a")
    fails("42701", lambda: s.sql("alter table a add column note text"))
    s.sql("detach extension e from a")
    s.sql("create index i on a (v)")
    s.sql("drop index i")
    assert "rows: 2" in [r[0] for r in s.sql("explain analyze select * from a").collect()]
    assert s.sql("analyze a").first()["affected"] == 2
    assert s._entry("a")["stats"]["columns"]["v"] == {"nulls": 1, "distinct": 1, "min": "1", "max": "1", "common": [["1", 1]], "histogram": [1] * 65}
    s.sql("truncate a")
    assert rows(s.sql("select * from a")) == []
    s.sql("drop table a")
    fails("42P01", lambda: s.sql("select * from a"))
    fails("0A000", lambda: s.sql("create function f() as 1"))


def test_timeout(s):
    s.sql("set statement_timeout = 300000")
    assert s.sql("select 1 as x").collect() == [(1,)]


def test_kv(s):
    kv = KV(s)
    for k, v in ((b"b", b"2"), (b"a", b"1"), (b"\xff", b"3")):
        kv.put(k, v)
    assert kv.get(b"a") == b"1" and kv.get(b"z") is None
    assert [bytes(r["k"]) for r in kv.scan(b"a", b"c").collect()] == [b"a", b"b"]
    assert kv.cas(b"a", b"1", b"9") and not kv.cas(b"a", b"1", b"8") and kv.cas(b"n", None, b"0")
    assert kv.delete(b"b") and kv.get(b"b") is None
    s.sql("create branch k2")
    kv.use_branch("k2")
    kv.put(b"a", b"k2")
    kv.use_branch("main")
    assert kv.get(b"a") == b"9"


def test_vacuum_and_folding(s):
    s.sql("create table f (id bigint primary key, v int)")
    for k in range(10):
        s.sql(f"insert into f values ({k % 3}, {k}) on conflict (id) do update set v = excluded.v")
    s.sql("checkpoint")
    assert len(s._entry("f")["changes"]) == 0 and len(s._entry("f")["base"]) == 1
    assert s.catalog.vacuum(0) >= 9
    assert rows(s.sql("select * from f")) == [(0, 9), (1, 7), (2, 8)]


def _play(rng, s, model):
    for _ in range(3):
        k, v = rng.randrange(6), rng.randrange(100)
        op = rng.choice(["put", "delete"])
        if op == "put":
            s.sql(f"insert into m values ({k}, {v}) on conflict (id) do update set v = excluded.v")
            model[k] = v
        else:
            s.sql(f"delete from m where id = {k}")
            model.pop(k, None)


@pytest.mark.parametrize("seed", range(3))
def test_random_merge(s, seed):
    """Branches against dictionaries."""
    rng = random.Random(seed)
    s.sql("create table m (id bigint primary key, v int)")
    s.sql("insert into m values (0, 0), (1, 1), (2, 2), (3, 3)")
    base = {k: k for k in range(4)}
    s.sql("create branch dev")
    left, right = dict(base), dict(base)
    _play(rng, s, left)
    s.sql("use branch dev")
    _play(rng, s, right)
    s.sql("use branch main")
    conflict = any(left.get(k) != base.get(k) and right.get(k) != base.get(k) and left.get(k) != right.get(k) for k in range(6))
    if conflict:
        fails("40001", lambda: s.sql("merge branch dev into main"))
        want = left
    else:
        s.sql("merge branch dev into main")
        want = {k: v for k in range(6) if (v := right.get(k) if left.get(k) == base.get(k) else left.get(k)) is not None}
    assert rows(s.sql("select * from m")) == sorted(want.items())


def test_half_written_head(s):
    """A head that another program has left empty or cut off wedges nothing."""
    s.sql("create table h (id bigint primary key)")
    s.sql("insert into h values (1)")
    n = s.catalog.head("main")[0]
    folder = s.catalog.root.removeprefix("file://") + "/refs/main"
    for k, text in ((n + 1, ""), (n + 2, '{"commit": ')):
        with open(f"{folder}/{k:012d}.json", "w") as f:
            f.write(text)
    assert rows(s.sql("select * from h")) == [(1,)]
    s.sql("insert into h values (2)")
    assert rows(s.sql("select * from h")) == [(1,), (2,)] and s.catalog.head("main")[0] == n + 3


def test_files_are_whole_or_absent(s):
    f = s.catalog.files
    assert f.create("x/a.json", {"n": 1}) and not f.create("x/a.json", {"n": 2}) and f.read("x/a.json") == {"n": 1}
    f.write("x/a.json", {"n": 3})
    f.write("x/a.json", {"n": 4})
    assert f.read("x/a.json") == {"n": 4} and f.names("x") == ["a.json"]


def test_views_of_two_sessions(spark, s):
    other = Session(spark, s.catalog.root)
    s.sql("create view v1 as select 1 as x")
    other.sql("create view v2 as select 2 as x")
    assert set(s.catalog.views()) == {"v1", "v2"}


def test_timeout_is_hit(s):
    s.sql("set statement_timeout = 300")
    fails("57014", lambda: s.sql("select count(*) from range(100000) a join range(100000) b on a.id * b.id % 7 = 3"))
    s.sql("set statement_timeout = 0")
    assert s.sql("select 1 as x").collect() == [(1,)]


def test_failed_write_leaves_nothing(s):
    s.sql("create table c (id bigint primary key, v int check (v > 0))")
    s.sql("insert into c values (1, 1)")
    before = s.catalog.files.names("data")
    fails("23514", lambda: s.sql("insert into c values (2, 0)"))
    fails("23514", lambda: s.sql("update c set v = 0"))
    assert s.catalog.files.names("data") == before


def test_parameters_in_values(s):
    s.sql("create table pv (id bigint primary key, a text, b text)")
    s.sql("insert into pv values (?, ?, ?), (?, ?, ?)", [1, "a", "b", 2, "c", "d"])
    assert rows(s.sql("select * from pv")) == [(1, "a", "b"), (2, "c", "d")]


def test_texts_that_look_like_syntax(s):
    s.sql("create table q (id bigint primary key, w text)")
    s.sql("insert into q values (1, 'q for system_time as of ''x'''), (2, '7/2 order by rowid'), (3, 'floor(1) || 1.5')")
    got = dict(rows(s.sql("select id, w from q -- order by 7/2\n order by id")))
    assert got == {1: "q for system_time as of 'x'", 2: "7/2 order by rowid", 3: "floor(1) || 1.5"}
    assert rows(s.sql("select 'q for system_time as of ''1''' as w, (id + 1) / 2 as h from q where w like '7/2%'")) == [("q for system_time as of '1'", 1)]
    s.sql("create view halves as select id / 2 as h, w from q")
    assert rows(s.sql("select h / 1 as h from halves where w <> '/'")) == [(0,), (1,), (1,)]
    assert s.sql("select count(*) as n, avg(id) / 2 as m, -7 / 2 as k, cast(7 as double) / 2 as d from q").first() == (3, 1.0, -3, 3.5)


def test_unparse(spark, s):
    s.sql("create table p (id bigint primary key, v int)")
    s.sql("insert into p values (1, 7), (2, null)")
    text = s.unparse("select id, v / 2 as h from p order by v")
    assert " div " in text and "nulls last" in text
    assert rows(s.spark.sql(text)) == rows(s.sql("select id, v / 2 as h from p order by v")) == [(1, 3), (2, None)]
    fails("0A000", lambda: s.unparse("with recursive r(n) as (select 1 union select n % 3 + 1 from r) select n from r"))


def test_expressions_of_constraints_and_upserts(spark, s):
    s.sql("create table p (id bigint primary key, v int check (v / 2 <> 1), w text)")
    for v in (2, 3):
        fails("23514", lambda v=v: s.sql(f"insert into p values (1, {v}, 'a')"))
    s.sql("insert into p values (1, 4, 'a'), (2, null, null)")
    s.sql("insert into p values (1, 9, 'b'), (2, 9, 'b') on conflict (id) do update set v = excluded.v / 2, w = concat(w, excluded.w, null) where id / 2 = 0")
    assert sorted(rows(s.sql("select * from p"))) == [(1, 4, "ab"), (2, None, None)]
    fails("42703", lambda: s.sql("insert into p values (1, 9, 'b') on conflict (id) do update set v = nothing"))
    assert not [x for x in s.spark.catalog.listTables("global_temp") if x.name.startswith("__dml")]
