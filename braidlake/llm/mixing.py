"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidlake.llm.common import numbered

#: Slots of one period of the schedule, documents of a block, power of a source's size that gives its default weight.
PERIOD, BLOCK, POWER = 1000, 100, 0.5
#: Least number of hexadecimal digits of the hash range in which a source's rows are ranked on their own, and the rows of a range, about, beyond which it grows.
DIGITS, RANGE = 3, 4096
#: A whole run holds target weights as whole shares of about this number, which bounds a source's blocks to 2^25.
SHARES = 2**37
#: Slots of a whole run that are scheduled before they are added to the others; a run of more than SLOTS slots and more than STEPS slots times sources gets larger blocks.
STRETCH, SLOTS, STEPS = 1000, 2**14, 2**24
#: Columns of the schedule in the result of mixed(); columns of df with these names get the ending "_given".
SCHEDULE = ("source", "block", "release", "deadline", "slot", "place")


def quotas(sources: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD, power: float = POWER) -> DataFrame:
    """(source, quota): whole slots of a period for each source, at least 1, that sum to the period (largest remainders; ties by name).

    sources: (source, n), one row each. weights: target weights by name, of which those present are brought to a sum
    of one; without it n to the power. The period must be at least the number of sources. Weights that are positive for
    none of the sources are an error.
    """
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ((k, float(v)) for k, v in sorted(weights.items())) for x in kv]), F.col("source")), F.lit(0.0))
    every = Window.partitionBy()  # one row per source
    share = sources.select("source", w.alias("w")).withColumn("all", F.sum("w").over(every))
    share = share.withColumn("all", F.when(F.col("all") > 0, F.col("all")).otherwise(F.raise_error(F.lit("no source has a positive target weight")).cast("double")))
    share = share.select("source", (F.col("w") / F.col("all") * (period - F.count("*").over(every))).alias("x"))
    base = share.select("source", (F.floor("x") + 1).cast("long").alias("q"), (F.round(F.col("x") - F.floor("x"), 9)).alias("rest"))
    spare = F.lit(period).cast("long") - F.sum("q").over(every)
    return base.select("source", (F.col("q") + F.when(F.row_number().over(Window.partitionBy().orderBy(F.desc("rest"), "source")) <= spare, 1).otherwise(0)).cast("long").alias("quota"))


def pattern(quota: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, k, slot): the slot in a period of the k-th block of each source, by Pfair's earliest deadline first.

    Block k of a source with quota q may not start before slot floor((k - 1) * P / q) and must be done by the end of
    slot ceil(k * P / q); each slot goes to the released block with the earliest deadline, ties by the larger quota and
    the name. As the quotas sum to P, every slot is filled, and what a source has got differs from its share by less
    than one block at any time. One row holds the state, so its size is bounded by the period and the sources.
    """
    p = F.lit(period).cast("long")
    one = quota.agg(F.array_sort(F.collect_list(F.struct((-F.col("quota")).alias("minus"), "source"))).alias("s"))
    n_zero = F.transform("s", lambda x: F.lit(0).cast("long"))
    start = F.struct(n_zero.alias("got"), F.array().cast("array<struct<i:int,k:long>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        # of each source whose next block is released: (deadline, place in s)
        ready = F.filter(
            F.transform("s", lambda x, i: F.struct(F.ceil((F.element_at(acc["got"], i + 1) + 1) * p / -x["minus"]).cast("long").alias("d"), i.alias("i"), F.floor(F.element_at(acc["got"], i + 1) * p / -x["minus"]).cast("long").alias("r"))),
            lambda c: c["r"] <= t,
        )
        best = F.array_min(ready)["i"]
        got = F.transform(acc["got"], lambda g, i: g + F.when(i == best, 1).otherwise(0).cast("long"))
        return F.struct(got.alias("got"), F.concat(acc["out"], F.array(F.struct(best.alias("i"), F.element_at(got, best + 1).alias("k")))).alias("out"))

    run = one.filter(F.size("s") > 0).select("s", F.aggregate(F.sequence(F.lit(0).cast("long"), p - 1), start, step, lambda acc: acc["out"]).alias("out"))
    return run.select("s", F.posexplode("out").alias("slot", "o")).select(F.element_at("s", F.col("o.i") + 1)["source"].alias("source"), F.col("o.k").alias("k"), F.col("slot").cast("long").alias("slot"))


def whole_run(sources: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, power: float = POWER) -> DataFrame:
    """(source, quota, period, size, slots): the slots of all blocks of each source, in order, by Pfair's earliest deadline first over the whole run.

    sources: (source, n), one row each. quota of period is the target weight but for its rounding to SHARES, which comes to
    less than 1e-5 blocks in a million slots. Block b (from 0) may not start before slot floor(b * period / quota) and must
    be done by the end of slot ceil((b + 1) * period / quota), so a source differs from its target weight by less than
    one block at any time, for any number of sources. A source without a positive weight is an error. size is the rows
    of a block: `block`, or as many more as keep the run within about max(SLOTS, STEPS / sources) slots. One row holds
    the schedule, so its size and its time are bounded, whatever the number of rows.
    """
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        w = F.element_at(F.create_map(*[F.lit(x) for kv in ((k, float(v)) for k, v in sorted(weights.items())) for x in kv]), F.col("source"))
    w = F.when(w > 0, w).otherwise(F.raise_error(F.lit("a source has no positive target weight")).cast("double"))
    every = Window.partitionBy()  # one row per source
    share = sources.select("source", "n", w.alias("w")).select("source", "n", (F.col("w") / F.sum("w").over(every)).alias("share"))
    share = share.withColumn("size", F.greatest(F.lit(block).cast("long"), F.ceil(F.max(F.col("n") / F.col("share")).over(every) / F.greatest(F.lit(float(SLOTS)), F.lit(float(STEPS)) / F.count("*").over(every))).cast("long")))
    share = share.select("source", "size", F.ceil(F.col("n") / F.col("size")).cast("long").alias("blocks"), F.greatest(F.round(F.col("share") * F.lit(SHARES)).cast("long"), F.lit(1).cast("long")).alias("q"))
    one = share.agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct((-F.col("q")).alias("minus"), "source", "blocks"))).alias("s"), F.sum("q").alias("p")).filter(F.size("s") > 0)

    def up(x: Column, q: Column) -> Column:
        return F.call_function("div", x + q - 1, q)

    one = one.withColumn("stretches", up(F.array_max(F.transform("s", lambda x: up(x["blocks"] * F.col("p"), -x["minus"]))), F.lit(STRETCH).cast("long")))

    def due(i: Column, got: Column) -> Column:
        # the next block of the i-th source, of which it has got so many
        q = -F.element_at("s", i + 1)["minus"]
        return F.struct(up((got + 1) * F.col("p"), q).alias("d"), i.alias("i"), F.call_function("div", got * F.col("p"), q).alias("r"), got.alias("got"))

    def once(x: Column, use: Callable[[Column], Column]) -> Column:
        # use(x), with x computed a single time
        return F.get(F.transform(F.array(x), use), 0)

    def step(acc: Column, t: Column) -> Column:
        def taken(best: Column) -> Column:
            after = F.transform(acc["next"], lambda x: F.when(x["i"] == best, due(x["i"], x["got"] + 1)).otherwise(x))
            return F.struct(after.alias("next"), F.concat(acc["out"], F.array(best)).alias("out"))

        return once(F.array_min(F.filter(acc["next"], lambda x: x["r"] <= t))["i"], taken)

    def stretch(acc: Column, c: Column) -> Column:
        slots = F.sequence(c * STRETCH, (c + 1) * STRETCH - 1)
        part = F.aggregate(slots, F.struct(acc["next"].alias("next"), F.array().cast("array<int>").alias("out")), step)
        return once(part, lambda x: F.struct(x["next"].alias("next"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    start = F.struct(F.transform("s", lambda x, i: due(i, F.lit(0).cast("long"))).alias("next"), F.array().cast("array<array<int>>").alias("out"))
    run = one.select("s", "p", "size", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("stretches") - 1), start, stretch, lambda acc: F.flatten(acc["out"])).alias("out"))
    slots = run.select(F.posexplode("out").alias("slot", "i")).groupBy("i").agg(F.array_sort(F.collect_list(F.col("slot").cast("long"))).alias("slots"))
    named = run.select("p", "size", F.posexplode("s").alias("i", "x")).select("i", "p", "size", F.col("x.source").alias("source"), (-F.col("x.minus")).alias("quota"))
    return named.join(slots, "i").select("source", "quota", F.col("p").alias("period"), "size", "slots")


def _offsets(counts: DataFrame) -> DataFrame:
    """(s, r, o): the rows of a source in hash ranges before r, from (s, r, count). Summed over the first DIGITS digits and then within them, so no task holds more than 16^DIGITS sums of a source."""
    before = Window.partitionBy("s").orderBy("top").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = Window.partitionBy("s", "top").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = counts.withColumn("top", F.substring("r", 1, DIGITS))
    tops = cut.groupBy("s", "top").agg(F.sum("count").alias("all")).select("s", "top", (F.sum("all").over(before) - F.col("all")).alias("far"))
    near = cut.select("s", "top", "r", (F.sum("count").over(within) - F.col("count")).alias("near"))
    return near.join(tops, ["s", "top"]).select("s", "r", (F.col("near") + F.col("far")).alias("o"))


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, period: int = PERIOD, block: int = BLOCK, power: float = POWER, carry: bool = False, whole: bool = False) -> DataFrame:
    """(id_col, source, block, release, deadline, slot, place) per row of df, and with carry all other columns of df.

    Each source's rows, ordered by the MD5 of the id, are cut into blocks of `block` rows. Block b (from 0) has the
    release and deadline of Pfair in slots, and (slot, place) is its rows' order in the mix. The schedule repeats every
    `period` slots, so it is computed once for one period and holds for any number of blocks. Nothing is dropped: when
    a source has run out its slots stay empty and the others keep their order and their shares of what is left.

    The quotas of a period are rounded and at least 1, so over many periods a source drifts from its target weight. With
    whole, and in any case with more sources than the period has slots, the schedule is that of whole_run() instead,
    which keeps to the target weights themselves; its blocks grow with very long runs, so the slots that are broadcast,
    one number for each block, have a bound.

    Rows are ranked without bringing a source together: counts for each hash range of a source are summed up to offsets and
    rows ranked within their range, so a hot source spreads over all ranges, whose number grows with the rows. Only the
    sources' quotas and the pattern of one period (of the whole run, its slots) are broadcast.

    A null source is a source of its own, shown as null; a null id is hashed as empty; rows that repeat an id follow one
    another; an empty table gives an empty result. With carry, columns of df that have a name of SCHEDULE get the ending
    "_given". Weights that are positive for none of the sources are an error, and in a whole run also a source without one.
    """
    rows, inner = numbered(df)
    at = {n: F.col(c) for n, c in zip(df.columns, inner, strict=True)}
    known = F.coalesce(F.concat(F.lit("="), at[source_col].cast("string")), F.lit(""))
    keyed = rows.select("*", known.alias("s"), F.md5(F.coalesce(at[id_col].cast("string"), F.lit("")).cast("binary")).alias("h"))
    digits, total = DIGITS, df.count()
    while total > RANGE * 16**digits:
        digits += 1
    keyed = keyed.withColumn("r", F.substring("h", 1, digits))
    if not carry:
        keyed = keyed.select(at[id_col], at[source_col], "s", "h", "r") if source_col != id_col else keyed.select(at[id_col], "s", "h", "r")
    counts = keyed.groupBy("s", "r").count()
    given = {f"={k}": v for k, v in weights.items()} if weights is not None else None
    sources = counts.groupBy(F.col("s").alias("source")).agg(F.sum("count").alias("n"))
    rank = F.row_number().over(Window.partitionBy("s", "r").orderBy("h", at[id_col])) - 1
    placed = keyed.join(_offsets(counts), ["s", "r"]).withColumn("n", F.col("o") + rank)
    taken = {id_col, *SCHEDULE, *df.columns}

    def free(name: str) -> str:
        while name in taken:
            name += "_given"
        taken.add(name)
        return name

    rest = [at[c].alias(free(c) if c in SCHEDULE else c) for c in df.columns if c not in (id_col, source_col)] if carry else []
    if whole or df.select(f"`{source_col}`").distinct().limit(period + 1).count() > period:
        run = whole_run(sources, given, block, power).select(F.col("source").alias("s"), "quota", F.col("period").alias("p"), "size", "slots")
        timed = placed.join(F.broadcast(run), "s").withColumn("block", F.expr("n div size")).withColumn("place", F.expr("n % size"))
        slot = F.element_at("slots", (F.col("block") + 1).cast("int"))
    else:
        quota = quotas(sources, given, period, power)
        slots = pattern(quota, period).join(F.broadcast(quota), "source").select(F.col("source").alias("s"), "k", F.col("slot").alias("slot_in"))
        # a source has at most `period` blocks in a period, so slots has at most `period` rows
        of = quota.select(F.col("source").alias("s"), "quota", F.lit(period).cast("long").alias("p"))
        timed = placed.withColumn("block", F.expr(f"n div {block}")).withColumn("place", F.expr(f"n % {block}")).join(F.broadcast(of), "s")
        timed = timed.withColumn("k", F.col("block") % F.col("quota") + 1).join(F.broadcast(slots), ["s", "k"])
        slot = F.expr("block div quota * p") + F.col("slot_in")
    release, deadline = F.expr("block * p div quota"), F.expr("((block + 1) * p + quota - 1) div quota")
    return timed.select(
        at[id_col].alias(id_col), at[source_col].alias("source"), *rest, "block", release.alias("release"), deadline.alias("deadline"), slot.alias("slot"), F.col("place").cast("long").alias("place")
    )
