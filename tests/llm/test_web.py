"""Archives, URL filters, mixing, and the pipeline."""

import gzip
import hashlib
import io
import math
import zlib
from base64 import b32encode
from collections import defaultdict

import pytest

from braidlake.llm import mixing, urlfilter, warc

PAGES = "page_id long, url string, html string, id long, digest string, first string, host string, path string, key string, bucket string"


def page(i, url, html):
    return (i, url, html, 1, "d", "f", "h", "p", "k", "b")


URLS = ["http://a.example.net/en/x", "https://EXAMPLE.net/en/", "http://example.net", "http://sub.example.com/de/1?x#y", "http://x.org/fr/#z", "ftp://net/a", "no scheme", None, "", "http://badnet/x", "http://a..net/", "http://net./x", "http://example.com:80/de/", "http://example.com/de", "x://y://net/q", "http://org/fr/?", "http://ünï.net/é", "http://" + "a." * 300 + "net/long"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [page(i, u, f"<p>{i % 4}</p>") for i, u in enumerate(URLS)] + [page(50, "http://r.net/", None), page(51, "u\r\nv", ""), page(52, "x", "é" * 200_000), page(52, "x", "é" * 200_000), page(None, "y", "<p>0</p>")]
    return spark.createDataFrame(rows, PAGES)


def brute_rule(url, rules):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    rest = rest.split("#")[0].split("?")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest.split("/")[0])
    path = rest[len(host) :]
    fit = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[3] if fit else None, max(fit)[2] if fit else "allow"


@pytest.mark.parametrize("rules", [urlfilter.RULES, (("block", "net", ""), ("allow", "a.example.net", "/en"), ("block", "example.net", "/"), ("allow", "example.net", "/en/x"), ("block", "com", "/"))])
def test_url_filter(spark, pages, rules):
    got = urlfilter.url_filter(pages, urlfilter.rules_table(spark, rules)).collect()
    assert len(got) == pages.count()
    for r in got:
        if r["page_id"] is not None and r["page_id"] < len(URLS):
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_rule(URLS[r["page_id"]], rules)


def test_url_filter_many(spark):
    """Thousands of urls over many ranges with deeply nested rules."""
    hosts = ["a.b.c.d.net", "b.c.d.net", "c.d.net", "d.net", "net", "xd.net", "d.com", "z.d.com", "com"]
    rules = [("block" if k % 2 else "allow", h, p) for k, h in enumerate(hosts) for p in ("/", "/p/", "/p/q")]
    urls = [f"http://{h}/p/{'q' if i % 3 else 'r'}{i}" for i in range(300) for h in [*hosts, "other", "w.a.b.c.d.net"]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urlfilter.url_filter(df, urlfilter.rules_table(spark, rules)).collect()
    assert len(got) == len(urls) and all((r["rule"], r["verdict"]) == brute_rule(urls[r["page_id"]], rules)[2:] for r in got)


def test_url_filter_empty(spark, pages):
    rules = urlfilter.rules_table(spark)
    assert urlfilter.url_filter(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.url_filter(pages, rules.limit(0)).collect()} == {"allow"}


def test_archives(spark, pages):
    got = warc.archived(pages).collect()
    rows = pages.select("page_id", "html").collect()
    assert len(got) == len(rows)
    top = defaultdict(lambda: -1)
    for r in rows:
        top[r["html"] or ""] = max(top[r["html"] or ""], 2**63 - 1 if r["page_id"] is None else r["page_id"])
    html = {r["page_id"]: (r["html"] or "") for r in rows}
    for r in got:
        x = html[r["page_id"]].encode()
        first = top[html[r["page_id"]]]
        mine = 2**63 - 1 if r["page_id"] is None else r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(x), b32encode(hashlib.sha1(x).digest()).decode())
        assert r["record_type"] == ("response" if first == mine else "revisit")
        assert r["refers_to"] == (None if first == mine or first == 2**63 - 1 else first)
    assert warc.archived(pages.limit(0)).count() == 0


def test_normaliser(tmp_path):
    records = [warc.record(k, b"http://x/%d" % k, bytes([k % 251]) * (k * 40_000), "D", None if k % 3 else 1) for k in range(8)]
    for name, data in (("whole", gzip.compress(b"".join(records))), ("members", b"".join(gzip.compress(r) for r in records)), ("empty", gzip.compress(b""))):
        source, target = tmp_path / f"{name}.warc.gz", tmp_path / "out" / f"{name}.warc.gz"
        source.write_bytes(data)
        n = warc.normalise_file(f"file://{source}", f"file://{target}")
        out = target.read_bytes()
        lines = (tmp_path / "out" / f"{name}.warc.gz.cdx").read_text().splitlines()
        assert n == len(lines) == (0 if name == "empty" else 8)
        for k, line in enumerate(lines):
            i, offset, length, *_ = line.split(" ")
            assert int(i) == k and zlib.decompress(out[int(offset) : int(offset) + int(length)], 31) == records[k]
        assert gzip.decompress(out) == (b"" if name == "empty" else b"".join(records))
    broken = tmp_path / "broken.warc.gz"
    broken.write_bytes(gzip.compress(b"".join(records)[:-30]))
    with pytest.raises(ValueError):
        warc.normalise_file(f"file://{broken}", f"file://{tmp_path}/out/b.warc.gz")


def test_inflated_in_pieces():
    data = gzip.compress(bytes(5_000_000))
    pieces = list(warc.inflated(io.BytesIO(data).read))
    assert sum(map(len, pieces)) == 5_000_000 and max(map(len, pieces)) <= warc.CHUNK


def brute_pattern(quota, period):
    names = sorted(quota, key=lambda s: (-quota[s], s))
    got, out = dict.fromkeys(names, 0), []
    for t in range(period):
        ready = [(-(-(got[s] + 1) * period // quota[s]), k, s) for k, s in enumerate(names) if got[s] * period // quota[s] <= t]
        s = min(ready)[2]
        got[s] += 1
        out.append((s, got[s], t))
    return out


def test_pattern(spark):
    quota = {"a": 500, "b": 250, "c": 125, "d": 120, "e": 5}
    got = sorted(((r["source"], r["k"], r["slot"]) for r in mixing.pattern(spark.createDataFrame(list(quota.items()), "source string, quota long")).collect()), key=lambda x: x[2])
    assert got == brute_pattern(quota, 1000)
    seen = dict.fromkeys(quota, 0)
    for s, _, t in got:
        seen[s] += 1
        assert all(abs(seen[x] - quota[x] * (t + 1) / 1000) < 1 for x in quota)


def test_mixed(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('s', id % 4) end as source", "id as slot", "'b' as block", "'x' as extra")
    out = mixing.mixed(df, block=10, carry=True)
    got = out.collect()
    assert len(got) == 5000 and "extra" in out.columns
    assert len({(r["slot"], r["place"]) for r in got}) == 5000
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    blocks = defaultdict(set)
    for r in got:
        blocks[r["slot"]].add((r["source"], r["block"]))
    assert all(len(v) == 1 for v in blocks.values())
    given = mixing.quotas(spark.createDataFrame([("a", 5), ("b", 1), ("c", 9)], "source string, n long"), {"a": 3.0, "b": 1.0}).collect()
    assert {r["source"]: r["quota"] for r in given} == {"a": 749, "b": 250, "c": 1} and sum(r["quota"] for r in given) == 1000


@pytest.mark.parametrize("weights", [{"hot": 0.5} | {f"s{k}": 0.5 / 19 for k in range(19)}, {"hot": 0.9} | {f"s{k}": 0.1 / 99 for k in range(99)}, {"hot": 0.9999, "rare": 0.0001}, {f"s{k}": 1 for k in range(1500)}, None])
def test_whole_run_keeps_to_weights(spark, weights):
    """Over several periods of 1,000 slots no source is ever a whole block off its target weight, with over 1,000 sources too."""
    total = sum(weights.values()) if weights else 0
    blocks = {s: max(1, round(w / total * 2500)) for s, w in weights.items()} if weights else {"a": 900, "b": 1500, "c": 70, "d": 5}
    sources = spark.createDataFrame([(s, n * 100) for s, n in blocks.items()], "source string, n long")
    rows = {r["source"]: r for r in mixing.whole_run(sources, weights).collect()}
    if weights is None:
        weights = {s: n**0.5 for s, n in blocks.items()}
        total = sum(weights.values())
    assert set(rows) == set(weights) and all(len(r["slots"]) >= blocks[s] for s, r in rows.items())
    taken = [t for r in rows.values() for t in r["slots"]]
    assert sorted(taken) == list(range(len(taken))) and len(taken) >= 2500
    for s, r in rows.items():
        w = weights[s] / total
        for b, t in enumerate(r["slots"]):  # just before and just after each block
            assert abs(b - w * t) < 1 + 1e-4 and abs(b + 1 - w * (t + 1)) < 1 + 1e-4


def test_mixed_whole(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "case when id % 2 = 0 then 'hot' else concat('s', id % 2400) end as source", "'x' as extra")
    for got in (mixing.mixed(df, block=2).collect(), mixing.mixed(df.filter("source = 'hot' or doc_id % 5 = 1"), block=2, whole=True).collect()):
        assert len({(r["slot"], r["place"]) for r in got}) == len(got) >= 3000
        assert all(0 <= r["release"] <= r["slot"] < r["deadline"] for r in got)
    assert mixing.mixed(df.limit(0), whole=True).count() == 0


def test_mixed_odd(odd, empty):
    assert mixing.mixed(odd).count() == odd.count()
    assert mixing.mixed(empty).count() == 0


def test_pipeline(spark, tmp_path):
    """Stage by stage against plain versions of what each must do, and the whole run in one."""
    import corpus_pipeline as p
    from braidlake.llm import decontam, exact_dedup, quality, simhash

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = [docs]
    for k, (_, f) in enumerate(p.STAGES):
        f(spark, steps[-1], d).write.parquet(f"{tmp_path}/{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert steps[-1].dtypes == docs.dtypes
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert ids[1] == {r["doc_id"] for r in quality.quality(docs, spark.read.parquet(f"{d}/labels.parquet")).filter("predicted = 1").collect()}
    assert ids[2] == {r["doc_id"] for r in exact_dedup.exact_dedup(steps[1]).filter("kept").collect()}
    assert ids[3] == {r["doc_id"] for r in simhash.simhash_components(steps[2], shingle=5, distance=0.185, plan="banded", repeats=False).filter("doc_id = component_id").collect()}
    assert ids[4] == {r["doc_id"] for r in decontam.decontamination(steps[3], spark.read.parquet(f"{d}/benchmark.parquet")).filter("not contaminated").collect()}
    assert ids[5] == ids[4]
    assert {r["doc_id"] for r in p.run(spark, d).collect()} == ids[5]


def test_cut_off_archives(tmp_path):
    """A file that lacks any part of its last member's trailer, or all bytes, is an error."""
    data = gzip.compress(b"".join(warc.record(k, b"http://x/%d" % k, b"payload", "D", None) for k in range(5)))
    for n in (1, 4, 8, 9, len(data) // 2, len(data)):
        source = tmp_path / f"cut{n}.warc.gz"
        source.write_bytes(data[:-n])
        with pytest.raises((ValueError, zlib.error)):
            warc.normalise_file(f"file://{source}", f"file://{tmp_path}/out/cut{n}.warc.gz")


def test_archives_of_one_attempt(spark, pages, tmp_path):
    """What another attempt of a task has left is removed, and every archive has its own index."""
    folder = f"file://{tmp_path}/w"
    (tmp_path / "w" / "archives").mkdir(parents=True)
    (tmp_path / "w" / "archives" / "part-000000-lost.warc.gz").write_bytes(b"half")
    assert warc.archived(pages, folder=folder).count() == pages.count()
    left = sorted(x.name for x in (tmp_path / "w" / "archives").iterdir() if not x.name.endswith(".crc"))
    assert all(f"{x}.cdx" in left for x in left if x.endswith(".gz")) and "part-000000-lost.warc.gz" not in left


def test_mixed_keeps_clashing_columns(spark):
    df = spark.range(50).selectExpr("id as doc_id", "concat('s', id % 3) as source", "id * 2 as slot", "map('k', id) as block", "id as s", "id as h", "id as n")
    for whole in (False, True):
        out = mixing.mixed(df, block=4, carry=True, whole=whole)
        assert set(out.columns) == {*mixing.SCHEDULE, "doc_id", "slot_given", "block_given", "s", "h", "n"}
        assert all((r["slot_given"], r["block_given"], r["n"]) == (2 * r["doc_id"], {"k": r["doc_id"]}, r["doc_id"]) for r in out.collect())


@pytest.mark.parametrize("whole", [False, True])
def test_mixed_without_weights(spark, whole):
    df = spark.range(10).selectExpr("id as doc_id", "'a' as source")
    with pytest.raises(Exception, match="no (source has a )?positive target weight"):
        mixing.mixed(df, weights={"elsewhere": 1.0}, whole=whole).collect()


def test_mixed_ranges_of_any_number(spark, monkeypatch):
    """More hash ranges rank the rows just the same."""
    df = spark.range(900).selectExpr("id as doc_id", "concat('s', id % 2) as source")
    want = sorted(map(tuple, mixing.mixed(df, block=7).collect()))
    monkeypatch.setattr(mixing, "DIGITS", 1)
    monkeypatch.setattr(mixing, "RANGE", 2)
    assert sorted(map(tuple, mixing.mixed(df, block=7).collect())) == want


def test_whole_run_has_a_bound(spark, monkeypatch):
    """A run of more slots than the bound gets larger blocks and still keeps to the weights."""
    monkeypatch.setattr(mixing, "SLOTS", 64)
    monkeypatch.setattr(mixing, "STEPS", 64)
    sources = spark.createDataFrame([("a", 100_000), ("b", 30_000), ("c", 500)], "source string, n long")
    rows = {r["source"]: r for r in mixing.whole_run(sources, block=10).collect()}
    assert {r["size"] for r in rows.values()} != {10} and sum(len(r["slots"]) for r in rows.values()) <= mixing.STRETCH
    for n, s in ((100_000, "a"), (30_000, "b"), (500, "c")):
        share = n**0.5 / (100_000**0.5 + 30_000**0.5 + 500**0.5)
        assert len(rows[s]["slots"]) * rows[s]["size"] >= n
        assert all(abs(b - share * t) < 1 + 1e-4 for b, t in enumerate(rows[s]["slots"]))


def test_pipeline_against_plain_versions(spark):
    """run() against each stage done plainly: neighbours by all pairs, equal texts by a dictionary, benchmark windows one by one. The classifier's decisions are taken from a plain forward pass."""
    import re

    import corpus_pipeline as p
    from test_dedup import jaccard
    from test_text import benchmark_words, brute_hits

    from braidlake.llm import quality

    d = "/root/testdata/sf0.001"
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    docs = [(r["doc_id"], r["text"] or "") for r in read("documents").collect()]
    net = quality.learned(read("documents"), read("labels"))
    index, buckets = quality.index_vectors(), quality._Buckets()
    good = []
    for i, t in docs:
        z = (quality.pooled(t.encode(), index, net.context, buckets).astype(float) - net.mean) / net.scale
        hidden = [math.tanh(sum(z[a] * net.w1[a, k] for a in range(len(z))) + net.b1[k]) for k in range(net.w1.shape[1])]
        logit = sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2
        if 1 / (1 + math.exp(-max(-30, min(30, logit / net.temperature)))) >= 0.3:
            good.append((i, t))
    groups = defaultdict(list)
    for i, t in good:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i, t))
    one = [(i, t) for _, i, t in (min(g) for g in groups.values())]
    root = {i: i for i, _ in one}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(one):
        for j, y in one[a + 1 :]:
            if len(x) < 2 * len(y) + 50 and len(y) < 2 * len(x) + 50 and jaccard(x, y) >= 0.8:
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    near = [(i, t) for i, t in one if find(i) == i]
    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    grams = {tuple(w[k : k + 13]) for _, t in items for w in [benchmark_words(t)] for k in range(max(1, len(w) - 12)) if w}
    want = set()
    for i, t in near:
        w = benchmark_words(t)
        if not any(tuple(w[k : k + n]) in grams for n in {len(g) for g in grams} for k in range(len(w))):
            want.add(i)
            continue
        n, hit, _ = brute_hits(t, items)
        if 20 * hit < n:
            want.add(i)
    got = p.run(spark, d).collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)
    assert len(docs) > len(good) > len(one) > len(near)
