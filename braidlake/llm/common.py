"""Shared pieces of the training-data operators: tables in the cluster's shared folder, text buffers, hot-key-safe components."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null integer identifier, which thus counts as the largest of all.
NO_ID = 2**63 - 1
#: A node of more children than HUB is a hub in components(), which broadcasts at most HUBS of them.
HUB, HUBS = 500, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the session's checkpoint folder. Where neither is set, a local
    master gets a temporary folder; a cluster, whose machines would each write to a disk of their own, gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="braidlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/braidlake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that stored() has written and that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_or_max(name: str) -> Column:
    """An integer identifier as a long, null as the largest one. Text is read as a number; what is none is an error that says so."""
    c, number = F.col(f"`{name}`"), F.col(f"`{name}`").try_cast("long")
    return F.when(c.isNull(), NO_ID).when(number.isNull(), F.raise_error(F.concat(F.lit(f"no integer identifier in {name}: "), c.cast("string"))).cast("long")).otherwise(number)


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns renamed to c0, c1, ..., so that no column of a user's can clash with an operator's own, and these names. named() undoes it."""
    inner = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*inner), inner


def named(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns c0, c1, ... of df under their names again; other columns go."""
    return df.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])


def id_or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(NO_ID))


def remainder(name: str, modulus: int = 5) -> Column:
    """crc32 of the identifier as text, modulo modulus; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus


def byte_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of each text without decoding them; null gives empty bytes."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not (pa.types.is_string(chunk.type) or pa.types.is_large_string(chunk.type)):
            chunk = chunk.cast(pa.large_string())
        wide = pa.types.is_large_string(chunk.type)
        at = np.frombuffer(chunk.buffers()[1], dtype=np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist() if len(chunk) else [0]
        data = memoryview(chunk.buffers()[2] or b"")
        valid = chunk.is_valid().to_pylist() if chunk.null_count else None
        for i in range(len(chunk)):
            yield b"" if valid and not valid[i] else bytes(data[at[i] : at[i + 1]])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph of long node ids: (node, root) for each node that has an edge to another one.

    root is the smallest id of the component. Each round hangs every node under its smallest neighbour, links its
    other smaller neighbours to that one and halves the paths, all by aggregation and equi-joins keyed by the larger
    end. Nodes of very many neighbours are the hot keys: those of more than max(HUB, rows / HUBS) children or parents, of
    which there are at most HUBS, are broadcast, so the rows of their neighbours stay where they are. Rounds grow
    with the logarithm of the longest path. Every round is written to the shared folder and the last but one removed.
    """
    e = edges.select(F.greatest(a, b).alias("c"), F.least(a, b).alias("p")).filter("c <> p").distinct()
    e = stored(e, "edges")
    for _ in range(most_rounds):
        least = stored(e.groupBy("c").agg(F.min("p").alias("r"), F.max("p").alias("x"), F.count("*").alias("n")), "least")
        up = least.select(F.col("c").alias("r"), F.col("r").alias("rr"))
        crowd = max(HUB, e.count() // HUBS)
        hubs = least.groupBy("r").count().filter(F.col("count") > crowd).select("r")  # at most HUBS rows
        hubs = hubs.join(up, "r", "left").select(F.col("r").alias("hub"), F.col("rr").alias("hub_up"))
        split = least.join(F.broadcast(hubs), F.col("r") == F.col("hub"), "left")
        calm = split.filter("hub is null").select("c", "r", "x").join(up, "r", "left")
        crowded = split.filter("hub is not null").select("r", "c", "x", F.col("hub_up").alias("rr"))
        jumped = calm.unionByName(crowded).select("c", F.coalesce("rr", "r").alias("p"), F.expr("rr is not null or x <> r").alias("moved"))
        # only nodes with several parents send links on; joined per node, those of very many by broadcast
        more = least.filter("x <> r").select(F.col("c").alias("node"), "r", "n")
        wide = e.join(F.broadcast(more.filter(F.col("n") > crowd)), F.col("c") == F.col("node"), "left").select("c", "p", "r")  # at most HUBS nodes
        few = wide.filter("r is null").select("c", "p").join(more.filter(F.col("n") <= crowd), F.col("c") == F.col("node"))
        links = wide.filter("r is not null").select("p", "r").union(few.select("p", "r")).filter("p <> r").select(F.col("p").alias("c"), F.col("r").alias("p"), F.lit(True).alias("moved"))
        after = stored(jumped.union(links).groupBy("c", "p").agg(F.max("moved").alias("moved")), "edges")
        moved = after.filter("moved").limit(1).count()
        for old in (e, least):
            dropped(old)
        e = after
        if not moved:
            return e.select(F.col("c").alias("node"), F.col("p").alias("root")).union(e.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct())
    raise RuntimeError(f"the components did not settle in {most_rounds} rounds")


def blocks_for(n: int, per_block: int) -> int:
    return max(1, math.ceil(n / per_block))
