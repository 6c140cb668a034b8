"""Exact deduplication by content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlake.llm.common import id_or_max, id_or_null, named, numbered, stored

#: Characters that equality ignores.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

_RUNS = "id long, cp long, keep_id long, group_size long, kept boolean, open boolean, pos long, text_sha256 string"


def normalised(text: str) -> Column:
    out = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    for x in BLANKS:
        out = F.replace(out, F.lit(x), F.lit(""))
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range: neighbours are compared as a whole; only ids, lengths and digests are held."""
    ids, cps, first, shas = [], [], [], []
    last: pa.Array | None = None
    for b in batches:
        if not b.num_rows:
            continue
        norm = b.column("norm")
        new = np.ones(b.num_rows, dtype=bool)
        new[1:] = pc.not_equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
        if last is not None:
            new[0] = last[0] != norm[0]
        last = pa.array([norm[-1].as_py()], type=norm.type)
        shas += [hashlib.sha256(norm[i].as_buffer()).hexdigest() for i in np.flatnonzero(new)]
        ids.append(b.column("id").to_numpy())
        cps.append(b.column("cp").to_numpy())
        first.append(new)
    if not ids:
        return
    ids, cps, run = np.concatenate(ids), np.concatenate(cps), np.cumsum(np.concatenate(first)) - 1
    n, at = len(ids), np.flatnonzero(np.diff(run, prepend=-1))
    sizes = np.diff(at, append=n)
    order = np.lexsort((np.arange(n), ids, -cps, run))  # per run: most code points, then smallest id
    best = order[at]
    is_open = (run == 0) | (run == run[-1])
    pos = (np.int64(TaskContext.get().partitionId()) << 33) + np.arange(n)
    kept = np.zeros(n, dtype=bool)
    kept[best] = True
    for i in range(0, n, 20_000):
        s = slice(i, i + 20_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[s]), pa.array(cps[s]), pa.array(ids[best][run[s]]), pa.array(sizes[run[s]]), pa.array(kept[s]), pa.array(is_open[s]), pa.array(pos[s]), pa.array([shas[r] for r in run[s]])],
            names=["id", "cp", "keep_id", "group_size", "kept", "open", "pos", "text_sha256"],
        )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 32) -> DataFrame:
    """One row per row of df: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after deleting the characters of BLANKS; of equal texts the row with the most code
    points, then the smallest id, stays. Method: content sort. Sampled splitters (Spark's range partitioner) deal the
    normalised bytes into ranges by their first `prefix` characters, ties by the hash of all of them and then the id;
    an external sort (prefix, hash, whole bytes, id) puts equals next to each other, and neighbours are compared in
    full. The id in the range key lets one group of equal texts spread over many ranges: a run that touches the end
    of its range is settled afterwards by aggregation over its digest. At most two runs per range are such, so their
    table has a proven bound of twice the shuffle partitions and is broadcast.

    Null texts count as empty, empty texts are equal to each other; a null id counts as the largest one; of repeated
    rows that tie in all respects exactly one is kept; an empty table gives an empty result; other columns are not read.
    """
    rows = df.select(id_or_max(id_col).alias("id"), F.length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("long").alias("cp"), normalised(text_col).alias("norm"))
    keyed = rows.select("*", F.substring("norm", 1, prefix).alias("head"), F.xxhash64("norm").alias("h"))
    dealt = keyed.repartitionByRange("head", "h", "id").sortWithinPartitions("head", "h", "norm", "id").select("id", "cp", "norm")
    runs = stored(dealt.mapInArrow(_runs, _RUNS), "runs")
    rank = F.struct("cp", (-F.col("id")).alias("neg"), (-F.col("pos")).alias("negpos"))
    whole = runs.filter("open").groupBy(F.col("text_sha256").alias("whole_sha")).agg(F.max(rank).alias("top"), F.count("*").alias("whole_size"))
    out = runs.join(F.broadcast(whole), F.col("open") & (F.col("text_sha256") == F.col("whole_sha")), "left")
    return out.select(
        id_or_null(F.col("id")).alias(id_col),
        id_or_null(F.coalesce(-F.col("top.neg"), F.col("keep_id"))).alias("keep_id"),
        F.coalesce("whole_size", "group_size").alias("group_size"),
        F.coalesce(-F.col("top.negpos") == F.col("pos"), F.col("kept")).alias("kept"),
        "text_sha256",
    )


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range: of each run of equal texts the row that stays as far as this range knows, with its rank, its digest and whether the
    run touches the range's first or last row. One row is held from batch to batch."""
    held: pa.RecordBatch | None = None  # the best row of the run that may go on, without norm
    last: pa.Array | None = None
    first, n, sha = True, 0, ""

    def out(rows: pa.RecordBatch, shas: list[str], opens: list[bool]) -> pa.RecordBatch:
        cols = [c for c, name in zip(rows.columns, rows.schema.names, strict=True) if name != "norm"]
        names = [x for x in rows.schema.names if x != "norm"]
        return pa.RecordBatch.from_arrays([*cols, pa.array(shas, pa.string()), pa.array(opens, pa.bool_())], names=[*names, "sha", "open"])

    base = np.int64(TaskContext.get().partitionId()) << 33
    for b in batches:
        if not b.num_rows:
            continue
        norm, size = b.column(b.schema.get_field_index("norm")), b.num_rows
        new = np.ones(size, dtype=bool)
        new[1:] = pc.not_equal(norm.slice(1), norm.slice(0, size - 1)).to_numpy(zero_copy_only=False)
        goes_on = last is not None and last[0] == norm[0]
        run = np.cumsum(new) - 1
        ids, cps = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("id", "cp"))
        pos = base + n + np.arange(size)
        b = b.set_column(b.schema.get_field_index("pos"), "pos", pa.array(pos))
        order = np.lexsort((pos, ids, -cps, run))
        at = np.flatnonzero(new)
        best = b.take(pa.array(order[at]))
        shas = [hashlib.sha256(norm[i].as_buffer()).hexdigest() for i in at]
        if held is not None:
            if goes_on:
                old, now = ((-x.column(x.schema.get_field_index("cp"))[0].as_py(), x.column(x.schema.get_field_index("id"))[0].as_py(), x.column(x.schema.get_field_index("pos"))[0].as_py()) for x in (held, best))
                if old < now:
                    best = pa.Table.from_batches([held, best.slice(1)]).combine_chunks().to_batches()[0]
            else:
                yield out(held, [sha], [first])
                first = False
        if best.num_rows > 1:
            yield out(best.slice(0, best.num_rows - 1), shas[:-1], [first] + [False] * (best.num_rows - 2))
            first = False
        held, sha = best.slice(best.num_rows - 1), shas[-1]
        last = pa.array([norm[-1].as_py()], type=norm.type)
        n += size
    if held is not None:
        yield out(held, [sha], [True])


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 32) -> DataFrame:
    """The rows of df that exact_dedup keeps, with their columns: of equal texts that with the most code points, then the smallest id.

    The content sort of exact_dedup on whole rows, which are shuffled once: each range leaves one row for a run of equal
    texts, and runs that touch the end of their range are settled by their digests, at most two for each range, which are
    broadcast.

    Null texts count as empty, and one row of all empty texts stays; a null id counts as the largest one; of rows that tie in
    all respects exactly one stays; texts are compared as a whole however long; an empty table gives an empty result;
    columns may have any name, and any type that Arrow has.
    """
    rows, inner = numbered(df)
    at = {n: c for n, c in zip(df.columns, inner, strict=True)}
    text = at[text_col]
    keyed = rows.select("*", id_or_max(at[id_col]).alias("id"), F.length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long").alias("cp"), F.lit(0).cast("long").alias("pos"))
    keyed = keyed.select("*", F.substring(normalised(text), 1, prefix).alias("head"), F.xxhash64(normalised(text)).alias("h"))
    # the normalised text is made again behind the shuffle, which so carries each text once
    dealt = keyed.repartitionByRange("head", "h", "id").withColumn("norm", normalised(text)).sortWithinPartitions("head", "h", "norm", "id").drop("head", "h")
    schema = dealt.drop("norm").schema.add("sha", "string").add("open", "boolean")
    best = stored(dealt.mapInArrow(_best, schema), "best")
    rank = F.struct("cp", (-F.col("id")).alias("neg"), (-F.col("pos")).alias("negpos"))
    whole = best.filter("open").groupBy(F.col("sha").alias("whole_sha")).agg(F.max(rank).alias("top"))
    out = best.join(F.broadcast(whole), F.col("open") & (F.col("sha") == F.col("whole_sha")), "left").filter(F.col("top").isNull() | (-F.col("top.negpos") == F.col("pos")))
    return named(out, df.columns)
