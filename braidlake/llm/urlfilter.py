"""URL filters as a sort-merge range join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidlake.llm.common import shuffle_width

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Characters of a sampled splitter, and sampled keys for each bucket.
SPLIT_CHARS, PER_BUCKET = 256, 40


def reversed_key(host: Column) -> Column:
    """Labels from the top down, each with a dot after it: a host's subdomains are the keys that begin with its own."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    """Rules (verdict, host, path) as a table of constants; null or missing parts are null."""
    kind = "array<struct<verdict:string,host:string,path:string>>"
    book = F.array(*[F.struct(*[F.lit(x) for x in r]) for r in rules])
    return spark.range(1).select(F.inline(book.cast(kind)))


def _search(key: Column, splitters: list[str]) -> Column:
    """Number of splitters <= key, by binary search in a constant array."""
    if not splitters:
        return F.lit(0)
    # the largest character fills the array up to a power of two minus one
    steps = len(splitters).bit_length()
    full = F.array(*[F.lit(s) for s in splitters], *[F.lit("\U0010ffff")] * (2**steps - 1 - len(splitters)))
    halves = F.array(*[F.lit(2**k) for k in reversed(range(steps))])
    return F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.element_at(full, at + half) <= key, half).otherwise(0))


def url_filter(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) per row of df. rules: (verdict, host, path).

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest rule (host and
    path together, then host, then the larger verdict word) wins, and rule is its host and path; without one: null and
    `default`. Method: sort-merge range join. A host's canonical key is its labels reversed, so each rule's host is an
    interval of keys and the intervals nest. Splitters of at most SPLIT_CHARS characters, one for each shuffle partition
    (the one thing the driver collects) from PER_BUCKET times as many sampled keys, deal keys into ranges; the key carries a hash of the url, so one hot
    host spreads over many ranges. A rule goes to each range that its interval meets: at most one more copy for each
    splitter and level of nesting. Within a range events and urls are sorted by key, and a running window carries the
    stack of active rules: an opening rule puts its stack, a closing one that of the rule around it.

    Null urls and those without :// have an empty host and path and meet no rule; rules with a null or empty host never
    fit, a null rule path counts as empty; repeated rules count once, repeated rows give repeated rows; empty tables
    work; clashing extra columns are not read.
    """
    spark = df.sparkSession
    known = rules.filter("host is not null and host <> ''").select("verdict", F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path")).distinct()
    # nodes of the nesting: one per host, with the rules of the host itself and of all hosts around it
    own = known.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("host", "path", "verdict"))).alias("own"))
    around = own.select("host", F.explode(F.expr(r"transform(sequence(1, size(split(host, '\\.'))), i -> array_join(slice(split(host, '\\.'), i, size(split(host, '\\.'))), '.'))")).alias("outer"))
    nodes = around.join(own.select(F.col("host").alias("outer"), "own"), "outer").groupBy("host").agg(
        F.flatten(F.collect_list("own")).alias("stack"), F.flatten(F.collect_list(F.when(F.col("outer") != F.col("host"), F.col("own")))).alias("below")
    )

    rest = F.substring_index(F.substring_index("after", "#", 1), "?", 1)
    urls = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    urls = urls.withColumn("after", F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end")).withColumn("rest", rest)
    urls = urls.withColumn("raw", F.substring_index("rest", "/", 1))
    urls = urls.select("id", F.translate("raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.expr("substring(rest, length(raw) + 1)").alias("path"), F.expr("hex(xxhash64(url, id))").alias("h"))
    probes = urls.select("id", "host", "path", F.concat(reversed_key(F.col("host")), F.lit("\x01"), F.col("h")).alias("key"))

    width = shuffle_width(spark)
    splitters = _splitters(probes, width)
    bucketed = probes.select("*", _search(F.substring("key", 1, SPLIT_CHARS), splitters).alias("bucket"))
    opens = nodes.select("stack", "below", reversed_key(F.col("host")).alias("opens"))
    opens = opens.select("*", F.expr("concat(substring(opens, 1, length(opens) - 1), '/')").alias("closes"))
    meets = opens.select("*", F.explode(F.sequence(_search(F.substring("opens", 1, SPLIT_CHARS), splitters), _search(F.substring("closes", 1, SPLIT_CHARS), splitters))).alias("bucket"))
    stack = "array<struct<host:string,path:string,verdict:string>>"
    none = F.lit(None)
    events = meets.select("bucket", F.col("opens").alias("key"), F.lit(1).alias("turn"), F.col("stack").cast(stack).alias("stack"), none.cast("long").alias("id"), none.cast("string").alias("host"), none.cast("string").alias("path"))
    ends = meets.select("bucket", F.col("closes").alias("key"), F.lit(0).alias("turn"), F.coalesce("below", F.array()).cast(stack).alias("stack"), none.cast("long").alias("id"), none.cast("string").alias("host"), none.cast("string").alias("path"))
    asked = bucketed.select("bucket", "key", F.lit(2).alias("turn"), none.cast(stack).alias("stack"), F.col("id").cast("long").alias("id"), "host", "path")
    # closing events before opening ones of the same key; of those, the outer (shorter) host first
    w = Window.partitionBy("bucket").orderBy("key", "turn", F.size("stack")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.unionByName(ends).unionByName(asked).withColumn("active", F.last("stack", ignorenulls=True).over(w)).filter("turn = 2")
    fit = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.array_max(F.transform(fit, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("m"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule"))))
    return swept.withColumn("top", ranked).select(F.col("id").alias(id_col), "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def _splitters(probes: DataFrame, width: int) -> list[str]:
    """Keys that cut the urls into `width` ranges of about the same size, from PER_BUCKET * width keys of smallest hash."""
    if width < 2:
        return []
    sample = probes.select(F.substring("key", 1, SPLIT_CHARS).alias("k"), F.xxhash64("key", "id").alias("x")).orderBy("x").limit(PER_BUCKET * width)
    # the sample is sorted and cut on an executor; the driver gets the splitters
    keys = sample.agg(F.array_sort(F.collect_list("k")).alias("keys"))
    cut = keys.select(F.expr(f"case when size(keys) = 0 then array() else array_distinct(transform(sequence(1, {width - 1}), i -> keys[cast(size(keys) * i div {width} as int)])) end").alias("cut"))
    return list(cut.first()["cut"])
