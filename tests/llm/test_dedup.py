"""Exact and SimHash deduplication against brute force."""

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from braidlake.llm import exact_dedup, simhash
from braidlake.llm.common import NO_ID, components


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-(len(t or "")), NO_ID if i is None else i))
    return {k: (min(v)[1], len(v)) for k, v in groups.items()}


def test_exact(odd):
    want = brute_exact((r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect())
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == odd.count()
    kept = defaultdict(int)
    for r in got:
        keep, size = by_sha[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (None if keep == NO_ID else keep, size)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_exact_hot_group_spreads(spark):
    """One text of half of all rows fills several ranges, and its runs are settled across them."""
    df = spark.range(4000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'same text' else concat('text ', id) end as text")
    got = exact_dedup.exact_dedup(df).filter("group_size > 1").collect()
    assert len(got) == 2000 and {r["keep_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_keep_one(odd, empty):
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(brute_exact((r["doc_id"], r["text"]) for r in odd.collect()))
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


def brute_fingerprint(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= distance:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints(odd):
    for r in odd.filter("length(text) < 1000 or text is null").collect():
        assert simhash.fingerprint((r["text"] or "").encode(), 3).hex() == f"{brute_fingerprint(r['text'], 3):016x}"


def test_simhash_components(prose):
    rows = {r["doc_id"]: brute_fingerprint(r["text"], 3) for r in prose.select("doc_id", "text").collect()}
    want = brute_components(rows, 2)
    for r in simhash.simhash_components(prose).collect():
        assert (int(r["fingerprint"], 16), r["component_id"]) == (rows[r["doc_id"]], want[r["doc_id"]])


def test_simhash_odd(odd, empty):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == odd.count()
    none = {r["component_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert none == {3}
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("dense", [4, 64])
@pytest.mark.parametrize("distance", [1, 2, 3])
def test_candidates_are_complete(spark, dense, distance):
    """Dense neighbourhoods of fingerprints, with buckets split again and again: the same components as all pairs."""
    rng = np.random.default_rng(distance)
    centres = rng.integers(0, 2**63, 4)
    fps = {int(c) ^ int(np.bitwise_or.reduce(1 << rng.integers(0, 63, rng.integers(0, 5)), initial=0)) for c in centres for _ in range(60)} | {int(x) for x in rng.integers(0, 2**63, 100)}
    ids = {i: f for i, f in enumerate(sorted(fps))}
    df = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in ids.items()], "id long, fp binary")
    plan = simhash.planned(df, len(ids), distance, 64)
    assert sum(plan[1]) == distance - len(plan[0]) + 1 and sorted(b for p in plan[0] for b in p) == list(range(64))
    roots = {r["node"]: r["root"] for r in components(simhash.linked(df, len(ids), distance, 64, plan, dense=dense)).collect()}
    assert {i: roots.get(i, i) for i in ids} == brute_components(ids, distance)


def test_dense_groups_in_tiles(spark):
    """Near copies of a few texts, far more than a bucket may hold, in the banded plan: each family stays one component and is no part of another."""
    rng = np.random.default_rng(9)
    rows = []
    for f in range(3):
        base = [f"w{f}x{k}" for k in rng.integers(0, 10_000, 300)]
        for c in range(150):
            w = list(base)
            w[int(rng.integers(0, 300))] = f"changed{f}x{c}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + k, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 60))) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(df, shingle=5, distance=0.185, plan="banded", repeats=False, dense=20).collect()}
    assert [got[i] for i in range(450)] == [i // 150 * 150 for i in range(450)]
    assert all(got[1000 + k] == 1000 + k for k in range(100))


def test_unequal_thresholds(spark):
    """With parts of several widths and thresholds above zero the probes still meet every link."""
    rng = np.random.default_rng(3)
    fps = sorted({int(x) ^ int(1 << b) ^ int(1 << c) for x in rng.integers(0, 2**63, 30) for b, c in rng.integers(0, 63, (6, 2))})
    ids = dict(enumerate(fps))
    df = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in ids.items()], "id long, fp binary")
    parts = [list(range(10)), list(range(10, 40)), list(range(40, 64))]
    for limits in ([1, -1, 0], [-1, 2, -1], [0, 0, 0], [-1, 1, 0]):
        roots = {r["node"]: r["root"] for r in components(simhash.linked(df, len(ids), 2, 64, (parts, limits))).collect()}
        assert {i: roots.get(i, i) for i in ids} == brute_components(ids, 2)


def test_allocation():
    assert simhash.allocated([[0, 10, 99], [0, 1, 2], [0, 10, 99]], 0) in ([0, 1, -1], [-1, 1, 0])
    assert simhash.allocated([[0, 5], [0, 5]], -1) in ([-1, 0], [0, -1])


def test_near_copies(spark, prose):
    """One changed word in hundreds is caught; different documents stay."""
    rows = [(r["doc_id"], r["text"]) for r in prose.orderBy("doc_id").collect() if len(r["text"].split()) >= 250][:25]
    copies = []
    for i, t in rows:
        w = t.split(" ")
        w[len(w) // 2] = "changedword"
        copies.append((10_000 + i, " ".join(w)))
    df = spark.createDataFrame(rows + copies, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_representatives(df).collect()}
    caught = sum(10_000 + i not in kept for i, _ in rows)
    assert caught >= 23
    assert len(kept & {i for i, _ in rows}) >= 20  # near copies within the table itself go as well
    assert simhash.keep_representatives(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(300, 400)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[k] for k in [1000, *range(300, 400)]} == {300}


def test_banded_plan_recall_at_any_size(spark):
    """Partitions grow in number with the rows, so that near pairs meet as surely in a large table as in a small one."""
    for rows in (0, 1, 1000, 10**6, 15 * 10**6, 10**9, 5 * 10**10):
        w, m = simhash.banded_width(rows)
        assert 1 - (1 - (1 - simhash.NEAR_SHARE) ** w) ** m >= simhash.RECALL and rows / 2**w < 1000
    fps = spark.createDataFrame([(i, bytes(r)) for i, r in enumerate(np.random.default_rng(1).integers(0, 256, (300, 88), dtype=np.uint8))], "id long, fp binary")
    parts = simhash.banded_parts(fps, 704, 15)
    assert sorted(b for p in parts for b in p) == list(range(704)) and len(parts) >= simhash.banded_width(15 * 10**6)[1] and max(map(len, parts)) <= 15
    bits = np.unpackbits(np.array([np.frombuffer(bytes(r["fp"]), dtype=np.uint8) for r in fps.collect()]), axis=1)
    for k, corr in enumerate(simhash.correlations(fps, 704, 320)):
        assert np.allclose(corr, np.corrcoef(bits[:, 320 * k : 320 * (k + 1)].T))


def test_wide_fingerprints_link_near_pairs(spark):
    """The plan of a table of 15 million rows, on pairs that differ in 15 % of 704 bits: at least 95 % of them are linked."""
    rng = np.random.default_rng(2)
    one = rng.integers(0, 2, (1000, 704), dtype=np.uint8)
    two = one ^ (rng.random((1000, 704)) < simhash.NEAR_SHARE)
    df = spark.createDataFrame([(i, bytes(r)) for i, r in enumerate(np.packbits(np.concatenate([one, two]), axis=1))], "id long, fp binary")
    parts = simhash.banded_parts(df, 704, 15)
    edges = {(r["a"], r["b"]) for r in simhash.linked(df, 2000, int(0.185 * 704), 704, (parts, [0] * len(parts)), exact=False).collect()}
    assert all(a == b + 1000 for a, b in edges) and len(edges) >= 950


def planted_pairs(rng, sizes, shares):
    """Texts and versions of them with one run of words changed, so that about the given share of the five-word shingles is in common."""
    rows = []
    for n in sizes:
        for share in shares:
            one = [f"w{x}" for x in rng.integers(0, 10**9, n)]
            lost = max(1, round((n - 4) * (1 - share) / (1 + share)))  # of the n - 4 shingles; a run of k words at the end changes k of them
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(one[: n - lost] + [f"v{x}" for x in rng.integers(0, 10**9, lost)]))]
    return rows


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_duplicates_are_verified(spark):
    """Pairs below a Jaccard similarity of 0.8 stay apart however few bits they differ in, short texts too; those of 0.8 or more are linked."""
    rows = planted_pairs(np.random.default_rng(5), [10, 14, 24, 60, 200, 400] * 8, [0.6, 0.7, 0.75, 0.78, 0.82, 0.85, 0.9, 0.95])
    real = [(a, b) for (a, x), (b, y) in zip(rows[::2], rows[1::2], strict=True) if jaccard(x, y) >= 0.8]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(df, shingle=5, distance=0.185, plan="banded", repeats=False).collect()}
    linked = {(c, i) for i, c in got.items() if c != i}
    assert linked <= set(real)
    assert len(linked) >= 0.95 * len(real) and 100 < len(real) < 300
    assert {r["doc_id"] for r in simhash.keep_representatives(df).collect()} == {i for i, c in got.items() if i == c}


def test_similar_sets_in_tiles(spark, monkeypatch):
    """Groups of candidates of many tiles: the same components as all pairs."""
    monkeypatch.setattr(simhash, "TILE_ROWS", 8)
    rng = np.random.default_rng(6)
    rows = []
    for f in range(3):
        base = [f"f{f}x{k}" for k in range(64)]
        for c in range(40):
            w = list(base)
            for at in rng.integers(0, 64, int(rng.integers(0, 4))):
                w[at] = f"c{f}x{c}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: np.unique(simhash.shingles(t.encode(), 5)) for i, t in rows}
    found = spark.createDataFrame([(i, simhash.set_number(sets[i]), 7) for i in sets], "id long, shs long, grp long")
    roots = {r["node"]: r["root"] for r in simhash.similar_sets(df, found, "doc_id", "text", 5, 0.8).collect()}
    of = {i: simhash.set_number(x) for i, x in sets.items()}
    root = {n: n for n in of.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if jaccard(rows[a][1], rows[b][1]) >= 0.8:
            x, y = find(of[a]), find(of[b])
            root[max(x, y)] = min(x, y)
    assert {n: roots.get(n, n) for n in root} == {n: find(n) for n in root}
    assert len({find(n) for n in root}) > 3


def test_dense_buckets_lose_no_link(spark):
    """A random family in one dense bucket, and fingerprints near to a single member each: every row of the bucket is compared with every other."""
    rng = np.random.default_rng(8)
    bits = np.tile(rng.integers(0, 2, 320, dtype=np.uint8), (900, 1)) ^ (rng.random((900, 320)) < 0.08)
    near = bits[:60].copy()
    for row in near:
        row[12 + rng.choice(308, 52, replace=False)] ^= 1
    every = np.concatenate([bits, near])
    every[:, :12] = 0  # one value of the only partition
    ids = rng.permutation(len(every))
    packed = np.packbits(every, axis=1)
    df = spark.createDataFrame([(int(i), bytes(r)) for i, r in zip(ids, packed, strict=True)], "id long, fp binary")
    roots = {r["node"]: r["root"] for r in components(simhash.linked(df, len(every), 59, 320, ([list(range(12))], [0]), exact=False, dense=40)).collect()}
    fps = {int(i): int.from_bytes(bytes(r), "big") for i, r in zip(ids, packed, strict=True)}
    assert {i: roots.get(i, i) for i in fps} == brute_components(fps, 59)


# ---------------------------------------------------------------- shared ids, any columns, hubs, recall


def test_shared_ids_join_nothing(spark):
    """An id that several texts share, or a null id, links none of them."""
    base = " ".join(f"word{k}" for k in range(80))
    other = " ".join(f"other{k}" for k in range(80))
    third = " ".join(f"third{k}" for k in range(80))
    rows = [(3, base), (5, base + " x"), (5, other), (None, base + " y"), (None, third), (None, third + " z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [brute_fingerprint(t, 3) for _, t in rows]
    assert max((fps[0] ^ fps[1]).bit_count(), (fps[0] ^ fps[3]).bit_count(), (fps[4] ^ fps[5]).bit_count()) <= 12 < min((fps[0] ^ fps[2]).bit_count(), (fps[0] ^ fps[4]).bit_count(), (fps[2] ^ fps[4]).bit_count())
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.simhash_components(df, distance=12).collect()}
    assert [got[i, f"{f:016x}"] for (i, _), f in zip(rows, fps, strict=True)] == [3, 3, 5, 3, None, None]
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in simhash.keep_representatives(df).collect())
    assert [(i, t) for i, t in kept if i > 0] == [(3, base), (5, other)]
    assert [t for i, t in kept if i < 0] in ([third], [third + " z"])


def test_any_columns(spark):
    """Columns named like inner ones, and maps, go through unharmed; rows that share id and text count once."""
    rows = [(1, "some text", {"a": 1}, 5, 6, "x"), (1, "some text", {"b": 2}, 5, 6, "x"), (2, "some  text ", {}, 7, 8, None), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c0 map<string,int>, __id long, id long, th string")
    for f, want in ((exact_dedup.keep_one, {2, 3}), (simhash.keep_representatives, {1, 3})):
        got = f(df)
        assert got.columns == df.columns and [t for _, t in got.dtypes] == [t for _, t in df.dtypes]
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)
        assert all((r["__id"], r["id"]) == {1: (5, 6), 2: (7, 8), 3: (None, None)}[r["doc_id"]] for r in got.collect())


def test_keep_one_over_ranges(spark):
    """A hot text over many ranges leaves its longest row, ties the smallest id; null ids last."""
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 'hot text' when id = 1501 then 'hot  text' else concat('text ', id div 6) end as text", "case when id < 30 then null else id end as doc_id", "id as n")
    want = {}
    for r in df.collect():
        k = re.sub(r"\s", "", r["text"])
        rank = (-len(r["text"]), NO_ID if r["doc_id"] is None else r["doc_id"])
        want[k] = min(want.get(k, rank), rank)
    got = exact_dedup.keep_one(df).collect()
    assert sorted((re.sub(r"\s", "", r["text"]), -len(r["text"]), NO_ID if r["doc_id"] is None else r["doc_id"]) for r in got) == sorted((k, *v) for k, v in want.items())


def test_ids_must_be_numbers(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([("7", "a")], "doc_id string, text string")).first()["doc_id"] == 7
    with pytest.raises(Exception, match="no integer identifier in doc_id: seven"):
        exact_dedup.exact_dedup(spark.createDataFrame([("seven", "a")], "doc_id string, text string")).collect()


@pytest.mark.parametrize("hub", [0, 5])
def test_components_with_hubs(spark, monkeypatch, hub):
    """Nodes of very many children or parents are broadcast; the components are the same."""
    from braidlake.llm import common

    monkeypatch.setattr(common, "HUB", hub)
    rng = np.random.default_rng(4)
    edges = [(1, k) for k in range(2, 60)] + [(5000, k) for k in range(1000, 1060)] + [(1000, 1)] + [tuple(int(x) for x in p) for p in rng.integers(2000, 2300, (150, 2))]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_recall_with_dense_families(spark):
    """Pairs of a Jaccard similarity of 0.8 or more of each id divisible by 50 against all rows, in a table where boilerplate fills every bucket."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(600):  # twelve families, and a few words that all begin with
        header = [f"all{x}" for x in range(60)] + [f"h{k % 12}x{x}" for x in range(340)]
        own = [f"w{x}" for x in rng.integers(0, 10**9, int(rng.integers(20, 75)))]
        rows.append((k, " ".join(header + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(df, shingle=5, distance=0.185, plan="banded", repeats=False, dense=30).collect()}
    pairs = [(i, j) for i in range(0, 600, 50) for j in range(600) if i != j and jaccard(rows[i][1], rows[j][1]) >= 0.8]
    assert len(pairs) > 50
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)
    sizes = defaultdict(set)
    for i, c in got.items():
        sizes[c].add(i)
    # every component hangs together by links of 0.8
    for members in sizes.values():
        seen, todo = set(), [min(members)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [y for y in members - seen if jaccard(rows[x][1], rows[y][1]) >= 0.8]
        assert seen == members


def test_thresholds_of_skewed_partitions(spark):
    """A partition with one value for most fingerprints is left out, and another is probed instead."""
    rng = np.random.default_rng(14)
    bits = rng.integers(0, 2, (3000, 64), dtype=np.uint8)
    bits[:, :12] = 0
    df = spark.createDataFrame([(i, bytes(r)) for i, r in enumerate(np.packbits(bits, axis=1))], "id long, fp binary")
    parts = [list(range(a, min(a + 12, 64))) for a in range(0, 64, 12)]
    limits = simhash.thresholds(df, 3000, parts, 64, 0, 1)
    assert limits[0] == -1 and sum(limits) == 0 and max(limits) == 1
