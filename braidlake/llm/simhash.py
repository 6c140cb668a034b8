"""SimHash near-deduplication with generalised pigeonhole candidate search."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlake.llm.common import byte_texts, components, id_or_max, id_or_null, named, numbered, shuffle_width, stored

SEED = 42
#: A bucket of more different fingerprints than this is split again instead of being compared as a whole.
DENSE = 2048
#: Share of differing bits of two texts with a Jaccard similarity of 0.8, on average, and how surely the banded plan lets such a pair meet.
NEAR_SHARE = 0.151
RECALL = 0.98
#: Least Jaccard similarity of the distinct shingles of two linked texts in the banded plan, and the share of bits by which its candidates may differ beyond the distance.
SIMILAR = 0.8
SLACK = 0.04
#: Rows and bytes of shingles of a tile of a group of candidates.
TILE_ROWS, TILE_BYTES = 1024, 16_000_000
#: Tasks over which the rows of one group of candidates are spread where they are joined with what is known of the group.
SALTS = 16
#: Bits whose correlations the banded plan looks at together.
BLOCK = 320
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # value of a byte -> its bits, lowest first


def _mixed(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th 64 bits that follow from 64-bit hashes; the first are the hashes themselves."""
    if not j:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(j) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _majority(h: np.ndarray, words: int) -> bytes:
    """Per bit, whether it is set in over half the hashes; big-endian bytes, so that the first word's bit 63 comes first."""
    out = b""
    for j in range(words):
        octets = np.ascontiguousarray(_mixed(h, j)).view(np.uint8).reshape(-1, 8)
        seen = np.bincount((octets + _OFFSETS).ravel(), minlength=2048).reshape(8, 256) @ _BITS  # byte (lowest first) x bit
        out += np.packbits((2 * seen > len(h)).ravel(), bitorder="little").tobytes()[::-1]
    return out


_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def shingles(text: bytes, shingle: int = 3) -> np.ndarray:
    """Hashes of a text's word shingles with repeats; none without words. Fewer words than a shingle: the whole sequence is one."""
    w = text.lower().split()  # bytes: A-Z only; splits on 0x20 and 0x09-0x0D only
    if not w:
        return np.array([], dtype=np.uint64)
    flat, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= shingle:
        hashes = [digest(flat, SEED)]
    else:
        ends = list(itertools.accumulate([len(x) + 1 for x in w]))
        starts = [0, *ends]
        hashes = [digest(flat[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 3, words: int = 1, repeats: bool = True) -> bytes:
    """SimHash of a text's word shingles, with or without repeats; all bits zero without words."""
    h = shingles(text, shingle)
    if not len(h):
        return bytes(8 * words)
    return _majority(h if repeats else np.unique(h), words)


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, words: int = 1, repeats: bool = True) -> DataFrame:
    """(id, fp binary) for each row; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle, words, repeats) for t in byte_texts(b.column(1))], type=pa.binary())], names=["id", "fp"])

    return df.select(id_or_max(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp binary")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of bytes of a column of equally long binaries."""
    if not len(column):
        return np.zeros((0, size), dtype=np.uint8)
    column = column.cast(pa.binary())
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
    return data[at : at + size * len(column)].reshape(len(column), size)


def _bit_columns(m: np.ndarray) -> np.ndarray:
    return np.unpackbits(m, axis=1)  # column k: k-th bit from the left


def set_number(distinct: np.ndarray) -> int:
    """A 64-bit number of a set of shingles, from their sorted hashes."""
    return int(np.array([xxhash.xxh64_intdigest(distinct.tobytes(), SEED)], dtype=np.uint64).view(np.int64)[0])


def text_number(text_col: str) -> Column:
    """A 64-bit number of a text, null as empty: with the id it tells a row's text from others of the same id."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def numbered_fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int, words: int, repeats: bool) -> DataFrame:
    """(id, th, fp binary, shs) for each row: fingerprints(), the number of the text and that of its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, numbers = [], []
            for t in byte_texts(b.column(2)):
                h = shingles(t, shingle)
                distinct = np.unique(h)
                fps.append(_majority(h if repeats else distinct, words) if len(h) else bytes(8 * words))
                numbers.append(set_number(distinct))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, type=pa.binary()), pa.array(numbers, type=pa.int64())], names=["id", "th", "fp", "shs"])

    return df.select(id_or_max(id_col).alias("id"), text_number(text_col).alias("th"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, th long, fp binary, shs long")


# ---------------------------------------------------------------- the plan: partitions and thresholds


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1))


def correlations(fps: DataFrame, bits: int, block: int) -> list[np.ndarray]:
    """Correlation of the bits over all different fingerprints, from counts summed by Spark: a matrix for each block of bits."""
    starts = list(range(0, bits, block))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((min(block, bits - a),) * 2) for a in starts]
        n = 0
        for b in batches:
            x = _bit_columns(_matrix(b.column("fp"), bits // 8)).astype(np.float32)
            n += len(x)
            for a, both in zip(starts, sums, strict=True):
                part = x[:, a : a + block]
                both += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([n], pa.int64())], names=["i", "j", "n"])
        for a, both in zip(starts, sums, strict=True):
            i, j = np.triu_indices(len(both))
            yield pa.RecordBatch.from_arrays([pa.array((i + a).astype(np.int32)), pa.array((j + a).astype(np.int32)), pa.array(both[i, j].astype(np.int64))], names=["i", "j", "n"])

    sums, total = [np.zeros((min(block, bits - a),) * 2) for a in starts], 0
    for i, j, n in fps.select("fp").mapInArrow(counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n")).collect():  # at most bits * (block + 1) / 2 + 1 rows
        if i < 0:
            total = n
        else:
            sums[i // block][i % block, j % block] = sums[i // block][j % block, i % block] = n
    if not total:
        return [np.eye(len(both)) for both in sums]
    out = []
    for both in sums:
        mean = np.diag(both) / total
        spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
        out.append((both / total - np.outer(mean, mean)) / np.outer(spread, spread))
    return out


def grouped_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal size; each takes in the bits most correlated with it, so that the others stay selective."""
    left, out = set(range(len(corr))), []
    strength = np.abs(corr)
    for k in range(m, 0, -1):
        size = math.ceil(len(left) / k)
        rest = sorted(left)
        sub = strength[np.ix_(rest, rest)] - np.eye(len(rest)) * 2
        part = [rest[int(np.argmax(sub.max(axis=1)))]]
        while len(part) < size:
            pool = [b for b in rest if b not in part]
            part.append(max(pool, key=lambda b: (strength[b, part].sum(), -b)))
        out.append(sorted(part))
        left -= set(part)
    return out


def banded_width(rows: int, share: float = NEAR_SHARE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a partition and the least number of partitions that lets a pair which differs in `share` of independent bits agree on one of them with a probability of `recall`, whatever the number of rows."""
    w = max(12, round(math.log2(max(rows, 2))) - 9)  # up to about 700 rows for each value of a partition
    return w, math.ceil(math.log(1 - recall) / math.log1p(-((1 - share) ** w)))


def banded_parts(fps: DataFrame, bits: int, w: int) -> list[list[int]]:
    """Partitions of at most w correlated bits, cut from each block of BLOCK bits apart, so that what the driver gets grows with the bits and not with their square."""
    parts = []
    for k, corr in enumerate(correlations(fps, bits, BLOCK)):
        parts += [[b + k * BLOCK for b in part] for part in grouped_bits(corr, math.ceil(len(corr) / w))]
    return parts


def allocated(cost: list[list[float]], total: int) -> list[int]:
    """Thresholds t_i >= -1 with the given sum and the least sum of costs; cost[i][t + 1] is that of partition i at t. Dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        after: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row, -1):
                if s + t not in after or c + x < after[s + t][0]:
                    after[s + t] = (c + x, [*ts, t])
        best = after
    return best[total][1]


def _values(cols: np.ndarray, part: list[int]) -> np.ndarray:
    """A partition's value of each fingerprint, as 64-bit integers (of wider partitions a hash)."""
    x = np.zeros(len(cols), dtype=np.uint64)
    for k, b in enumerate(part):
        x = (x << np.uint64(1)) | cols[:, b].astype(np.uint64) if k < 64 else _mixed(x, 1) ^ cols[:, b].astype(np.uint64)
    return x


def _key(part_no: int, values: np.ndarray) -> np.ndarray:
    return _mixed(values ^ np.uint64((part_no + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)), 1).view(np.int64)


def _flips(width: int, radius: int) -> list[int]:
    """Masks of 1 to radius bits."""
    return [sum(1 << i for i in c) for r in range(1, radius + 1) for c in itertools.combinations(range(width), r)]


_SIG = "key long, probe boolean, fp binary, id long, path string"


def _signatures(parts: list[list[int]], limits: list[int], size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                b = whole.slice(at, 4000)
                cols = _bit_columns(_matrix(b.column("fp"), size))
                for k, (part, t) in enumerate(zip(parts, limits, strict=True)):
                    if t < 0:
                        continue
                    v = _values(cols, part)
                    for mask in [None, *_flips(len(part), t)]:
                        key = _key(k, v if mask is None else v ^ np.uint64(mask))
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(v), mask is not None)), b.column("fp"), b.column("id"), pa.array([str(k)] * len(v))], names=["key", "probe", "fp", "id", "path"])

    return run


def _free(path: str, parts: list[list[int]], limits_total: int) -> list[int]:
    """The bits not fixed by the partitions on a path like 2.0.1: the first is one of parts, each later one an equal cut of what is left."""
    steps = [int(x) for x in path.split(".")]
    free = [b for k, p in enumerate(parts) if k != steps[0] for b in p]
    for s in steps[1:]:
        cut = _cuts(free, limits_total)[s]
        free = [b for b in free if b not in cut]
    return free


def _cuts(free: list[int], distance: int) -> list[list[int]]:
    return [free[i :: distance + 1] for i in range(distance + 1)]


def _resplit(parts: list[list[int]], distance: int, size: int) -> Callable:
    """Deals the rows of dense buckets again: two fingerprints that share the bucket's bits and differ in at most `distance` of the free bits agree on one of distance + 1 cuts of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = np.array(b.column("path").to_pylist(), dtype=object)
            old = b.column("key").to_numpy()
            cols = _bit_columns(_matrix(b.column("fp"), size))
            for path in sorted(set(paths)):
                rows = np.flatnonzero(paths == path)
                for s, cut in enumerate(_cuts(_free(path, parts, distance), distance)):
                    key = _mixed(_key(s, _values(cols[rows], cut)).view(np.uint64) ^ old[rows].view(np.uint64), 2).view(np.int64)
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column("probe").take(take), b.column("fp").take(take), b.column("id").take(take), pa.array([f"{path}.{s}"] * len(rows))], names=["key", "probe", "fp", "id", "path"])

    return run


# ---------------------------------------------------------------- verification


def _forest(rows: np.ndarray, ids: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that connect whatever fingerprints of a bucket are linked: at most one fewer than its rows, each to the smallest id reached."""
    n = len(rows)
    words = np.ascontiguousarray(rows).view(np.uint64)
    order = np.argsort(ids, kind="stable")
    words, ids = words[order], ids[order]
    unseen, edges = np.ones(n, dtype=bool), []
    for root in range(n):
        if not unseen[root]:
            continue
        unseen[root], front = False, [root]
        while front:
            rest = np.flatnonzero(unseen)
            if not len(rest):
                break
            x = front.pop()
            near = rest[np.bitwise_count(words[rest] ^ words[x]).sum(axis=1) <= distance]
            unseen[near] = False
            front += near.tolist()
            edges += [(int(ids[y]), int(ids[root])) for y in near]
    return edges


def _verify(distance: int, size: int) -> Callable:
    """Rows sorted by key; compares those of a key and gives edges of ids."""

    def flush(keys: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(keys).combine_chunks()
        key, ids = t.column("key").to_numpy(), t.column("id").to_numpy()
        fp = _matrix(t.column("fp").combine_chunks() if isinstance(t.column("fp"), pa.ChunkedArray) else t.column("fp"), size)
        at = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if key[0] > -(2**63) else 0)) if len(key) else np.array([], int)
        at = at if len(at) and at[0] == 0 else np.append(0, at)
        sizes = np.diff(at, append=len(key))
        a, b = [], []
        # small buckets: all at once, row against the row k further on in the same bucket
        small = sizes <= 24
        group = np.repeat(np.arange(len(at)), sizes)
        use = np.flatnonzero(small[group])
        if len(use):
            g, w, i = group[use], np.ascontiguousarray(fp[use]).view(np.uint64), ids[use]
            for k in range(1, int(sizes[small].max())):
                same = np.flatnonzero(g[k:] == g[:-k])
                near = same[np.bitwise_count(w[same] ^ w[same + k]).sum(axis=1) <= distance]
                a.append(i[near])
                b.append(i[near + k])
        for s in np.flatnonzero(~small):
            r = slice(at[s], at[s] + sizes[s])
            one = np.unique(ids[r], return_index=True)[1]
            if edges := _forest(fp[r][one], ids[r][one], distance):
                x = np.array(edges, dtype=np.int64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        a, b = (np.concatenate(x) if x else np.array([], np.int64) for x in (a, b))
        real = a != b
        return a[real], b[real]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def out() -> pa.RecordBatch:
            a, b = flush(held)
            pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            if rows >= 20_000:
                same = int(np.searchsorted(key, held[-1].column("key")[-1].as_py(), side="right"))
                held.append(batch.slice(0, same))
                if same < batch.num_rows:
                    yield out()
                    held, rows = [batch.slice(same)], batch.num_rows - same
                continue
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield out()

    return run


def _verified(sig: DataFrame, distance: int, size: int, width: int) -> DataFrame:
    return sig.select("key", "fp", "id").repartition(width, "key").sortWithinPartitions("key", "id").mapInArrow(_verify(distance, size), "a long, b long")


def in_tile_pairs(rows: DataFrame, tiles: Column, group: str, node: str) -> DataFrame:
    """The rows with a new column key: each group's rows are dealt into tiles, and every two tiles of a group meet under one key, so every two rows do. tiles: how many."""
    t = rows.withColumn("__t", tiles.cast("long")).withColumn("__i", F.pmod(F.xxhash64(node, F.lit(SEED)), F.col("__t")))
    t = t.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__t") - 1)))
    return t.withColumn("key", F.xxhash64(group, F.least("__i", "__j"), F.greatest("__i", "__j"))).drop("__t", "__i", "__j")


def spread_join(rows: DataFrame, facts: DataFrame, group: str, node: str) -> DataFrame:
    """rows joined with facts, one row per group: each fact stands under SALTS numbers and each row asks for one of them, so a large group's rows meet theirs in as many tasks."""
    own = rows.withColumn("__s", F.pmod(F.xxhash64(node, F.lit(SEED)), F.lit(SALTS)).cast("int"))
    each = facts.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return own.join(each, [group, "__s"]).drop("__s")


def linked(fps: DataFrame, n: int, distance: int, bits: int, plan: tuple[list[list[int]], list[int]], exact: bool = True, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) of ids that connect the candidates within `distance` differing bits. fps: (id, fp), each fp once.

    A bucket of over `dense` rows is never compared as a whole. exact: its rows are dealt again by cuts of the bits
    they leave free. Otherwise it is dealt into tiles of about 2 * `dense` rows and every two tiles are compared, so
    that every two rows are: a bucket of n rows sends each of them n / (2 * dense) times.
    """
    parts, limits = plan
    size, width = bits // 8, shuffle_width(fps.sparkSession)
    sig = fps.select("id", "fp").mapInArrow(_signatures(parts, limits, size), _SIG)
    edges: DataFrame | None = None
    while True:
        heavy = stored(sig.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > dense), "dense")
        if heavy.isEmpty():
            one = _verified(sig, distance, size, width)
            return one if edges is None else edges.union(one)
        one = _verified(sig.join(heavy, "key", "left_anti"), distance, size, width)
        edges = one if edges is None else edges.union(one)
        if not exact:
            pairs = in_tile_pairs(sig.join(heavy, "key").withColumnRenamed("key", "bucket"), F.ceil(F.col("n") / (2 * dense)), "bucket", "id")
            return edges.union(_verified(pairs, distance, size, width))
        # each round takes a cut of the free bits away, and few free bits have few different fingerprints, so a dense bucket is never left at the end
        sig = stored(sig.join(heavy, "key", "left_semi").select("key", "probe", "fp", "id", "path").mapInArrow(_resplit(parts, distance, size), _SIG), "split")


def planned(fps: DataFrame, n: int, distance: int, bits: int, m: int | None = None) -> tuple[list[list[int]], list[int]]:
    """Partitions of correlated bits and their thresholds, which sum to distance - m + 1 (generalised pigeonhole).

    m: by the cost model, probes plus candidates if bits were fair. The thresholds: see thresholds().
    """

    def guess(m: int) -> float:
        w, total = bits / m, distance - m + 1 + m
        each = [total // m + (k < total % m) - 1 for k in range(m)]
        return sum(n * ball(int(w), t) + 0.05 * n * n * ball(int(w), t) / 2**w for t in each if t >= 0)

    m = m or min(range(max(1, min(2, distance + 1)), distance + 2), key=guess)
    parts = grouped_bits(correlations(fps, bits, bits)[0], m)
    return parts, thresholds(fps, n, parts, bits, distance - m + 1, distance)


def thresholds(fps: DataFrame, n: int, parts: list[list[int]], bits: int, total: int, most: int) -> list[int]:
    """Thresholds of -1 to `most` for each partition that sum to `total`, by dynamic programming on estimated candidate counts: the sum of squares of
    a partition's value counts over all n fingerprints times the ball probed, and the probes themselves."""
    size = bits // 8

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = _bit_columns(_matrix(b.column("fp"), size))
            for k, p in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols), k, np.int32)), pa.array(_values(cols, p).view(np.int64))], names=["k", "v"])

    same = {k: float(s) for k, s in fps.select("fp").mapInArrow(values, "k int, v long").groupBy("k", "v").count().groupBy("k").agg(F.sum(F.col("count").cast("double") * F.col("count"))).collect()}  # m rows
    cost = [[0.0, *(n * ball(len(p), t) * (1 if t == 0 else 2) + same.get(k, 0.0) * ball(len(p), t) for t in range(most + 1))] for k, p in enumerate(parts)]
    return allocated(cost, total)


# ---------------------------------------------------------------- Jaccard similarity


def _similar(sets: list[np.ndarray], numbers: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges that connect whatever sets of distinct hashes are linked by a Jaccard similarity of `least` or more: at most one fewer than the sets."""
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    mark = np.zeros(int(codes.max(initial=-1)) + 1, dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    own = [codes[a:b] for a, b in zip(starts, ends, strict=True)]
    rest, edges = np.arange(len(sets)), []  # starts, ends and codes are those of rest
    while len(rest):
        root, front, taken = int(rest[0]), [int(rest[0])], np.zeros(len(rest), dtype=bool)
        taken[0] = True
        while front and not taken.all():
            x = front.pop()
            mark[own[x]] = 1
            seen = np.concatenate([[0], np.cumsum(mark[codes])])
            mark[own[x]] = 0
            common = seen[ends] - seen[starts]
            near = np.flatnonzero(~taken & (common >= least * (sizes[rest] + len(own[x]) - common) - 1e-9))
            taken[near] = True
            found = rest[near].tolist()
            front += found
            edges += [(int(numbers[y]), int(numbers[root])) for y in found]
            if 2 * taken.sum() > len(taken):
                rest, taken = rest[~taken], np.zeros(int((~taken).sum()), dtype=bool)
                codes = np.concatenate([own[y] for y in rest]) if len(rest) else codes[:0]
                ends = np.cumsum(sizes[rest])
                starts = ends - sizes[rest]
        if taken.any():
            rest = rest[~taken]
            codes = np.concatenate([own[y] for y in rest]) if len(rest) else codes[:0]
            ends = np.cumsum(sizes[rest])
            starts = ends - sizes[rest]
    return edges


def _similar_in(least: float) -> Callable:
    """Rows (key, shs, shingles) sorted by key: gives the edges within each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            edges = np.array(_similar(list(held.values()), np.array(list(held)), least), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

        for b in batches:
            for key, number, data in zip(b.column("key").to_pylist(), b.column("shs").to_pylist(), b.column("shingles"), strict=True):
                if key != now and held:
                    yield out()
                    held = {}
                now = key
                held[number] = np.frombuffer(data.as_py(), dtype=np.uint64)
        if held:
            yield out()

    return run


def similar_sets(df: DataFrame, found: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """(node, root) of the sets of shingles that have a link: sets of one group of candidates and a Jaccard similarity of `least` or more.

    found: (id, shs, grp) for each row of df, and th, the text's number, where ids repeat or are null. Every two different
    sets of a group are compared by their shingles, which are made again for groups of two sets or more only; large groups
    are compared tile by tile.
    """
    key = ["id", "th"] if "th" in found.columns else ["id"]
    one = found.groupBy("grp", "shs").agg(F.min(F.struct(*key)).alias("row"))
    many = one.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1")
    asked = stored(spread_join(one, many, "grp", "shs").select("row.*", "shs", "grp"), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(t, shingle)) for t in byte_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("shs"), b.column("grp"), pa.array([set_number(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["shs", "grp", "own", "shingles"])

    texts = df.select(id_or_max(id_col).alias("id"), text_number(text_col).alias("th"), F.col(text_col).cast("string").alias("text")).join(asked, key)
    # without th an id may have several texts: only the one that was asked for
    sets = stored(texts.select("shs", "grp", "text").mapInArrow(run, "shs long, grp long, own long, shingles binary").filter("own = shs").select("shs", "grp", "shingles"), "shingles")
    sizes = sets.groupBy("grp").agg(F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum(F.length("shingles")) / TILE_BYTES)).alias("tiles"))
    dealt = in_tile_pairs(spread_join(sets, sizes, "grp", "shs"), F.col("tiles"), "grp", "shs")
    edges = dealt.select("key", "shs", "shingles").repartition(shuffle_width(df.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_similar_in(least), "a long, b long")
    return components(edges)


def banded_components(df: DataFrame, id_col: str, text_col: str, shingle: int, distance: float, dense: int, repeats: bool, least: float) -> DataFrame:
    """(id, th, fp, component) for each row of df by the banded plan; component is a number of the sets of shingles that are linked.

    Fingerprints and sets go by 64-bit numbers, whatever ids their rows have. Two fingerprints of one number would only
    share a group of candidates; two different sets of one number (2^-64 a pair) would count as one.
    """
    w, m = banded_width(df.count())
    words = math.ceil(m * w / 64)
    bits = 64 * words
    docs = stored(numbered_fingerprints(df, id_col, text_col, shingle, words, repeats), "fingerprints")
    fps = stored(docs.select("fp").distinct().select("fp", F.xxhash64("fp").alias("id")), "distinct")
    parts, n = banded_parts(fps, bits, w), fps.count()
    limits = thresholds(fps, n, parts, bits, 0, 1)
    groups = components(linked(fps, n, math.floor((distance + SLACK) * bits), bits, (parts, limits), exact=False, dense=dense))
    grouped = docs.withColumn("own", F.xxhash64("fp")).join(groups, F.col("own") == groups.node, "left")
    found = stored(grouped.select("id", "th", "fp", "shs", F.coalesce("root", "own").alias("grp")), "candidates")
    roots = similar_sets(df, found.select("id", "th", "shs", "grp"), id_col, text_col, shingle, least)
    return found.join(roots, found.shs == roots.node, "left").select("id", "th", "fp", F.coalesce("root", "shs").alias("component"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, words: int = 1, plan: str = "exact", dense: int = DENSE, repeats: bool = True, similar: float = SIMILAR) -> DataFrame:
    """One row per row of df: (id_col, fingerprint in hexadecimal, component_id).

    A fingerprint is the SimHash of the text's word shingles; fingerprints link at `distance` or fewer differing bits,
    and component_id is the smallest id that is reachable over links.

    plan "exact": generalised pigeonhole. Equal fingerprints are first merged by aggregation, so a group of copies
    is one row. planned() groups correlated bits and sets the thresholds; every pair within the distance then meets in
    a bucket. Buckets of over `dense` fingerprints are dealt again by cuts of the bits they leave free, until they are
    small or have no free bits; so no task holds a group of near copies as a whole and no link is lost. Buckets are
    verified in full and give spanning edges only, never all pairs.

    plan "banded": texts link at a Jaccard similarity of `similar` or more of their distinct shingles, which is verified
    for every link; SimHash only raises the candidates. It stands for distances at which exact probing nears comparing
    all pairs. Partitions of w = log2(n) - 9 bits (12 or more) on as many words of SimHash as that takes (`words` is then
    ignored and `distance` is a share of the bits), with thresholds of -1 to 1 that sum to 0, by the same dynamic
    programming: pairs that differ in fewer bits than there are partitions m are certain to meet, others with a probability
    of 1 - (1 - (1 - p)^w)^m or more for a share p of differing bits, as a partition probed at one bit makes up for more
    than one that is left out. m grows with n so that this stays at RECALL for a share of NEAR_SHARE: 26 partitions of 12 bits up to three
    million rows, 44 of 15 bits at 15 million. Fingerprints that met and differ in at most `distance` + SLACK of the bits
    are chained into groups, and every two different sets of shingles of a group are compared.

    repeats: whether a shingle counts as often as it occurs or once.

    Null and empty texts have the fingerprint zero, which links like any other; a null id counts as the largest one;
    repeated rows give repeated rows; an empty table gives an empty result; other columns are not read.
    """
    if plan == "banded":
        docs = stored(banded_components(df, id_col, text_col, shingle, distance, dense, repeats, similar), "components")
        least = docs.groupBy("component").agg(F.min("id").alias("least"))
        return docs.join(least, "component").select(id_or_null(F.col("id")).alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), id_or_null(F.col("least")).alias("component_id"))
    bits = 64 * words
    docs = stored(fingerprints(df, id_col, text_col, shingle, words, repeats), "fingerprints")
    # a node is a fingerprint with a number of its own, as ids may be null or belong to several texts
    fps = stored(docs.groupBy("fp").agg(F.min("id").alias("least")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    n = fps.count()
    edges = linked(fps, n, distance, bits, planned(fps, n, distance, bits), dense=dense)
    joined = stored(components(edges).join(fps, F.col("node") == F.col("id")).select("fp", "root", "least"), "joined")
    roots = joined.groupBy("root").agg(F.min("least").alias("smallest"))
    merged = joined.join(roots, "root").select("fp", "smallest")
    owners = fps.join(merged, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component"))
    return docs.join(owners, "fp").select(id_or_null(F.col("id")).alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), id_or_null(F.col("component")).alias("component_id"))


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: float = 0.185) -> DataFrame:
    """One row of each component of df under the banded plan, with its columns: of texts that are linked by a Jaccard similarity
    of 0.8 or more of their distinct shingles, that of the smallest id; of several texts with this id, that of the smallest number.

    distance is a share of bits, and SLACK is added to it for candidates. Two shingle sets of one size and a Jaccard similarity
    of 0.8 differ in 15.1 % of the bits on average, with a deviation of 2 points at 320 bits.

    Null texts count as empty, and all texts without words are one component; a null id counts as the largest one, but
    different texts without id, or of one id, stay apart; of rows that share id and text any one stays; long texts are read
    as a whole; an empty table gives an empty result; columns may have any name and type.
    """
    found = banded_components(df, id_col, text_col, shingle, distance, DENSE, False, SIMILAR)
    kept = found.groupBy("component").agg(F.min(F.struct("id", "th")).alias("row")).select(F.col("row.id").alias("id"), F.col("row.th").alias("th"))
    rows, inner = numbered(df)
    at = {n: c for n, c in zip(df.columns, inner, strict=True)}
    keyed = rows.select("*", id_or_max(at[id_col]).alias("id"), text_number(at[text_col]).alias("th"))
    return named(keyed.dropDuplicates(["id", "th"]).join(kept, ["id", "th"], "left_semi"), df.columns)
