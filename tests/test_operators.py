import pytest
from pyspark.sql import functions as F

from braidlake.errors import SqlError
from braidlake.functions import parity as P
from braidlake.operators import recursive
from braidlake.operators import relational as R
from braidlake.operators.overlay import three_way
from braidlake.sources.csv import read_csv


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: P.mod(F.lit(-7), F.lit(3)), 2),
        (lambda: P.mod(F.lit(7), F.lit(-3)), -1),
        (lambda: P.int_div(F.lit(-7), F.lit(2)), -3),
        (lambda: P.int_div(F.lit(9223372036854775807), F.lit(2)), 4611686018427387903),
        (lambda: P.round_half_up(F.lit(2.5)), 3.0),
        (lambda: P.round_half_up(F.lit(-2.5)), -3.0),
        (lambda: P.floor(F.lit(-1.5)), -2.0),
        (lambda: P.substr(F.lit("hello"), 0, 3), "hel"),
        (lambda: P.substr(F.lit("hello"), -4, 2), "he"),
        (lambda: P.concat(F.lit("a"), F.lit(None), F.lit(1)), "a1"),
        (lambda: P.strict_concat(F.lit("a"), F.lit(None)), None),
        (lambda: P.trim(F.lit("\t  x  \n")), "x"),
        (lambda: P.like(F.lit("a\\b"), "a\\%"), True),
        (lambda: P.like(F.lit("a%"), "a!%", "!"), True),
    ],
)
def test_parity(spark, column, want):
    assert one(spark, column()) == want


def test_null_order(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 1)], "id long, x long")
    assert [r["x"] for r in df.orderBy(P.desc("x"), "id").collect()] == [None, None, 5, 1]
    assert [r["x"] for r in df.orderBy(P.asc("x"), "id").collect()] == [1, 5, None, None]


def test_scalar_and_guard(spark):
    with pytest.raises(Exception, match="21000"):
        R.scalar(spark.range(2).toDF("v"), "v").collect()
    assert R.scalar(spark.range(0).toDF("v"), "v").collect() == [(None,)]
    with pytest.raises(SqlError):
        recursive.fixpoint(spark.range(1).toDF("n"), lambda d: d.select((F.col("n") + 1).alias("n")), rounds=3)


def test_three_way(spark):
    make = lambda rows: spark.createDataFrame(rows, "k long, v string")
    base = make([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "e")])
    left = make([(1, "A"), (2, "b"), (4, None), (5, "x"), (6, "n")])
    right = make([(1, "a"), (2, "B"), (3, "c"), (4, "set"), (5, "y"), (6, "n")])
    got = {r["k"]: (r["v"], r["__state"]) for r in three_way(base, left, right, ["k"]).collect()}
    assert got == {1: ("A", "keep"), 2: ("B", "keep"), 3: (None, "gone"), 4: ("set", "keep"), 5: (None, "conflict"), 6: ("n", "keep")}


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('1,"a ""q"", \nb",2.5\n2,,bad\n3,plain,\n')
    cols = [{"name": "id", "type": "bigint"}, {"name": "s", "type": "string"}, {"name": "f", "type": "double"}]
    assert sorted(tuple(r) for r in read_csv(spark, f"file://{tmp_path}/x.csv", cols).collect()) == [(1, 'a "q", \nb', 2.5), (2, None, None), (3, "plain", None)]


def test_streams(spark, tmp_path):
    from braidlake import streaming
    from braidlake.session import Session

    s = Session(spark, f"file://{tmp_path}/engine")
    s.sql("create table e (id bigint primary key, v int)")
    spark.range(20).select("id", (F.col("id") * 2).cast("int").alias("v")).write.parquet(f"{tmp_path}/in")
    q = streaming.to_table(streaming.read(s.spark, f"{tmp_path}/in", "id long, v int"), s, "e", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert s.sql("select sum(v) from e").first()[0] == 380
    assert sum(b.num_rows for b in streaming.batches(s.table("e"), 7)) == 20
    assert len(list(streaming.rows(s.table("e")))) == 20
