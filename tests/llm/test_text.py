"""Scoring, classification, language, licences and decontamination."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from braidlake.llm import decontam, langid, licenses, lm_score, quality
from braidlake.llm.lattice import Lattice, normalised


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def remainder(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


# ---------------------------------------------------------------- op1


def brute_lattice(lattice, word):
    """Sum over all segmentations, one by one."""
    at = {p: i for i, p in enumerate(lattice.pieces)}
    text = b" " + word

    def rest(k):
        if k == len(text):
            return math.exp(lattice.log_stop)
        return sum(math.exp(lattice.logp[at[text[k:j]]]) * rest(j) for j in range(k + 1, len(text) + 1) if text[k:j] in at)

    return rest(0)


@pytest.fixture(scope="module")
def small():
    pieces = sorted({b" a", b" b", b" ab", b" ", b"a", b"b", b"ab", b"bab", b"aa"})
    return normalised(pieces, np.arange(1.0, len(pieces) + 1), 3.0)


def test_lattice(small):
    some = [b"", b"a", b"ab", b"bab", b"abab", b"aabbab", b"bbbb", b"ab" * 30]
    got = small.log_probabilities(some)
    for w, g in zip(some[:-1], got, strict=False):
        assert math.isclose(g, math.log(brute_lattice(small, w)), rel_tol=1e-9)
    wide = Lattice(small.pieces, small.logp, small.log_stop)
    assert math.isclose(got[-1], wide._long(some[-1]) + wide.log_stop, rel_tol=1e-9)


def test_lattice_sums_to_one(small):
    weights = np.arange(1.0, len(small.pieces) + 1)
    often_ends = normalised(small.pieces, weights, 3 * weights.sum())
    total = sum(math.exp(x) for n in range(13) for x in often_ends.log_probabilities([bytes(97 + (k >> i & 1) for i in range(n)) for k in range(2**n)]))
    assert 0.97 < total <= 1.0 + 1e-9


def test_lattice_by_sets(small):
    other = normalised(small.pieces, np.arange(20.0, 20.0 + len(small.pieces)), 9.0)
    some = [b"", b"a", b"ab", b"aabbab", b"ab" * 30]
    both = small.log_probabilities_by(some, np.stack([small.logp, other.logp]), np.array([small.log_stop, other.log_stop]))
    assert np.allclose(both, np.stack([small.log_probabilities(some), other.log_probabilities(some)], axis=1))


def test_lm_beats_the_unigram(spark):
    """On texts it has not learned from, although the unigram lumps all unseen words together."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm_score.lm_scores(docs, class_col="lang").filter("held_out").collect()
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_expected_counts(small):
    """Uses of pieces add up to the words' bytes."""
    some = [b"ab", b"aabbab", b"bab"]
    uses = small.expected(some)
    assert math.isclose(sum(u * len(p) for u, p in zip(uses, small.pieces, strict=True)), sum(len(w) + 1 for w in some), rel_tol=1e-9)


def check_base(df, **kwargs):
    rows = [(r["doc_id"], [*words(r["text"]), ""]) for r in df.select("doc_id", "text").collect()]
    c = Counter()
    for i, w in rows:
        if remainder(i) != 1:
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, remainder(i) == 1, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in rows)
    got = lm_score.lm_scores(df, **kwargs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    return got


def test_lm_scores(prose):
    check_base(prose)


def test_lm_odd(odd, empty):
    check_base(odd)
    check_base(odd, class_col="lang")
    check_base(odd, class_col="lang", classes=2)
    assert lm_score.lm_scores(empty).count() == 0 and lm_score.lm_scores(empty, class_col="lang").count() == 0


def test_lm_without_training(spark):
    held = [i for i in range(100) if remainder(i) == 1][:3]
    got = lm_score.lm_scores(spark.createDataFrame([(i, "some words here") for i in held], "doc_id long, text string")).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)


def test_lm_prefers_known_text(spark, prose):
    """A text of the corpus's words scores better by token than one of random letters."""
    ids = [i for i in range(20_000, 21_000) if remainder(i) == 1][:2]
    extra = spark.createDataFrame([(ids[0], "the of and in that is the with for"), (ids[1], "qzx vvkw jjqp xxzzq kkwq zzpq qqx jwv wqk")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(prose.select("doc_id", "text").union(extra)).filter("doc_id >= 20000").collect()}
    assert got[ids[0]] > got[ids[1]] / 2


# ---------------------------------------------------------------- op2


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (6, None, 0), (None, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality(empty, labels).count() == 0
    assert {r["score"] for r in quality.quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.accepted(odd, labels).columns == odd.columns


# ---------------------------------------------------------------- op5


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


def test_language_odd(odd, empty):
    got = langid.language_id(odd).collect()
    assert len(got) == odd.count()
    for r, t in ((r, {x["doc_id"]: x["text"] for x in odd.collect()}.get(r["doc_id"])) for r in got if r["doc_id"] is not None):
        assert (r["lang_pred"] == "und") == (not any(ch.isalpha() for ch in t or ""))
        assert 0 <= r["score"] <= 1
    assert langid.language_id(empty).count() == 0
    one = langid.language_id(odd.filter("lang = 'en' and length(text) > 9")).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0)}


def test_codes():
    for k in (2, 3, 4, 7, 12):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code}) == k
        assert min(np.count_nonzero(a != b) for i, a in enumerate(code) for b in code[:i]) >= max(1, code.shape[1] // 4)


# ---------------------------------------------------------------- op4


def benchmark_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(text, items, window=13):
    w, hit, seen = benchmark_words(text), set(), set()
    for i, t in items:
        x = benchmark_words(t)
        size = min(window, len(x))
        for a in range(len(x) - size + 1 if x else 0):
            for k in range(len(w) - size + 1):
                if w[k : k + size] == x[a : a + size]:
                    hit |= set(range(k, k + size))
                    seen.add(i)
    return len(w), len(hit), seen


CASES = [
    "a b c d e f g h i j k l m n o p",
    "x x x x x x x x x x x x x x x x x x",
    "short item",
    "b c d",
    "",
    None,
    "a b c d e f g h i j k l m q r s t",
    "x",
]


@pytest.mark.parametrize("shard_words", [400_000, 5])
def test_decontamination(spark, shard_words):
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstxz")
    texts = [" ".join(rng.choice(letters, 40)) for _ in range(30)] + [c for c in CASES] + ["zz " + (CASES[0] or "") + " yy A-B!c;D short ITEM", "x " * 40, "z a b c d e f g h i j k l m n z"] + [CASES[6] + " pad" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(CASES, 9)), "item_id long, text string")
    for r in decontam.decontamination(docs, bench, shard_words=shard_words).collect():
        n, hit, seen = brute_hits(texts[r["doc_id"]], list(enumerate(CASES, 9)))
        sha = hashlib.sha256(",".join(sorted(map(str, seen))).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(seen), sha, hit > 0 and 20 * hit >= n)
    kept = {r["doc_id"]: r["text"] for r in decontam.cleaned(docs, bench, shard_words=shard_words).collect()}
    for i, t in enumerate(texts):
        n, hit, _ = brute_hits(t, list(enumerate(CASES, 9)))
        assert (i in kept) == (not (hit and 20 * hit >= n))
        if i in kept:
            assert (kept[i] == t) == (hit == 0)
            assert len(benchmark_words(kept[i])) == n - hit


def test_decontamination_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, "lazy dog"), (None, "quick brown")], "item_id long, text string")
    assert decontam.decontamination(odd, bench).count() == odd.count()
    assert decontam.decontamination(odd, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontam.decontamination(empty, bench).count() == 0
    out = decontam.cleaned(odd, bench)
    assert out.columns == odd.columns and out.filter("doc_id = 1").count() == 0 and out.filter("doc_id = 6").count() == 1


def test_removed():
    assert decontam.removed(b"Keep this. Cut that, now! Keep.", [(2, 5)]) == b"Keep this. Keep."
    assert decontam.removed("é cut ü".encode(), [(1, 2)]) == "é ü".encode()


# ---------------------------------------------------------------- op7


def test_licenses(spark, odd, empty):
    bsd = "; ".join(dict(licenses.SENTENCES)[k] for k in ("bsd-redistribute", "bsd-source", "bsd-binary"))
    rows = [(1, "Intro.\nLicensed under the Apache License, Version 2.0."), (2, bsd + "."), (3, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (4, "All rights."), (5, None)]
    got = {r["doc_id"]: (r["n_known"], r["licenses"], r["license"]) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, "Apache-2.0", "Apache-2.0"), 2: (3, "BSD-2-Clause", "BSD-2-Clause"), 3: (2, "MIT,CC-BY-NC-4.0", "MIT"), 4: (0, "", None), 5: (0, "", None)}
    assert licenses.license_scan(odd).count() == odd.count() and licenses.license_scan(empty).count() == 0
    known = defaultdict(set)
    for a in licenses.anchors():
        for i, s in licenses.SENTENCES:
            if a in s.split():
                known[i].add(a)
    assert len(known) == len(licenses.SENTENCES)


# ---------------------------------------------------------------- whole scores and letters


def brute_segmentations(word, at):
    """All ways to write word (with the space before it) as numbers of pieces."""
    text, out = b" " + word, []

    def go(k, path):
        if k == len(text):
            out.append(path)
        for j in range(k + 1, len(text) + 1):
            if text[k:j] in at:
                go(j, [*path, at[text[k:j]]])

    go(0, [])
    return out


def brute_model(texts, pieces, own, rounds, prior):
    """Weights of first pieces, later pieces and stops, and counts, learned from (words, ...) of one class: plain expectation maximisation."""
    first = [p[:1] == b" " for p in pieces]
    at = {p: i for i, p in enumerate(pieces)}
    counts = Counter(w for t in texts for w in t)
    ends = len(texts)
    types = sorted(counts)
    ways = {w: brute_segmentations(w, at) for w in types}

    def weights(e, stops):
        head, rest = sum(x for x, f in zip(e, first, strict=True) if f), sum(x for x, f in zip(e, first, strict=True) if not f) + stops
        return [x / (head if f else rest) for x, f in zip(e, first, strict=True)], stops / rest

    p, stop = weights(own, 0.3)
    v = len(types) + (ends > 0)
    for _ in range(rounds):
        e = [prior * x for x in own]
        for w in types:
            each = [math.prod(p[i] for i in way) for way in ways[w]]
            for way, x in zip(ways[w], each, strict=True):
                for i in way:
                    e[i] += x / sum(each)
        p, stop = weights(e, v + 0.3 * prior)
    return p, stop, counts, ends, at


@pytest.mark.parametrize("class_col", [None, "lang"])
def test_lm_score_of_whole_texts(spark, class_col):
    """Scores of whole texts against a model built plainly, all segmentations of every word one by one."""
    from braidlake.llm.lattice import read_vocabulary

    some = [("ab ab cd", "x"), ("cd AB\tab", "x"), ("ef", "y"), ("ab zz", "y"), ("", "x"), (None, "y"), ("gh ef ef ab", "y"), ("ab cd new", "x"), ("qq ab ab qq", None), ("ef gh", "x")]
    rows = [(i, t, c) for i, (t, c) in enumerate(some)]
    pieces, logp = read_vocabulary(lm_score.default_vocabulary())
    own = np.exp(logp) / np.exp(logp).sum()
    train = [(words(t), c) for i, t, c in rows if remainder(i) != 1]
    common = sorted({c for _, c in train if c}, key=lambda c: (-sum(x == c for _, x in train), c))[:4] if class_col else []
    names = [*common, None] if class_col else [None]
    models = []
    for k, name in enumerate(names):
        mine = [[w.encode() for w in ws] for ws, c in train if (c == name if name else c not in common)] if class_col else [[w.encode() for w in ws] for ws, _ in train]
        models.append(brute_model(mine, pieces, own.tolist(), lm_score.ROUNDS, lm_score.PRIOR))
    plain_p, plain_stop = brute_model([], pieces, own.tolist(), 0, 0)[:2]
    ends = [m[3] for m in models]
    weight = [(e + 0.5) / (sum(ends) + 0.5 * len(models)) for e in ends]

    def lattice(word, p, stop, at):
        return stop * sum(math.prod(p[i] for i in way) for way in brute_segmentations(word, at))

    def by_class(word):
        out = []
        for p, stop, counts, _, at in models:
            n, v = sum(counts.values()), len(counts)
            spare = lm_score.DISCOUNT * v / n if n else 1.0
            out.append(spare * lattice(word, p, stop, at) + (max(counts[word] - lm_score.DISCOUNT, 0) / n if n else 0))
        if len(models) == 1:
            return out
        every = sum(w * q for w, q in zip(weight, out, strict=True))
        return [(1 - lm_score.SHARED) * q + lm_score.SHARED * every for q in out]

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in lm_score.lm_scores(df, class_col=class_col).collect():
        ws = [w.encode() for w in words(some[r["doc_id"]][0])]
        total, seen = 0.0, Counter()
        q = {w: by_class(w) for w in ws}
        for k, m in enumerate(models):
            tokens = sum(m[2].values()) + m[3]
            end = (m[3] + 0.5) / (tokens + 1)
            x, seen = weight[k] * end * (1 - end) ** len(ws), Counter()
            for n, w in enumerate(ws):
                x *= (seen[w] + lm_score.STRENGTH * q[w][k]) / (n + lm_score.STRENGTH)
                seen[w] += 1
            total += x
        assert math.isclose(r["score"], math.log10(total), rel_tol=1e-5), (r, math.log10(total))
        every = sum(len(t) + 1 for t, _ in train)
        end = (len(train) + 0.5) / (every + 1)
        alone = math.log10(end) + sum(math.log10((1 - end) * lattice(w, plain_p, plain_stop, models[0][4])) for w in ws)
        assert math.isclose(r["lattice_score"], alone, rel_tol=1e-5)


def test_lm_long_words_and_pieces(small):
    """Long words count in the expected uses like short ones, and no piece of the vocabulary is left out for its length."""
    from braidlake.llm.lattice import WIDE, read_vocabulary

    word = b"ab" * WIDE
    uses = small.expected([word])
    assert math.isclose(sum(u * len(p) for u, p in zip(uses, small.pieces, strict=True)), len(word) + 1, rel_tol=1e-9)
    short = b"abbab" * 7
    one = np.zeros(len(small.pieces))
    small._expected_long(short, one)
    assert np.allclose(one, small.expected([short]))
    pieces, _ = read_vocabulary(lm_score.default_vocabulary())
    assert b" international" in pieces and max(map(len, pieces)) > 12


def test_lm_blocks_of_any_number(spark, prose, monkeypatch):
    """More blocks and parts than shuffle partitions, and vocabularies sent on in pieces: the same scores."""
    want = sorted((r["doc_id"], round(r["score"], 4), r["base_score"]) for r in lm_score.lm_scores(prose).collect())
    for name, value in (("BLOCK_BYTES", 30_000), ("PART_BYTES", 50_000), ("HELD", 500), ("TOGETHER", 200)):
        monkeypatch.setattr(lm_score, name, value)
    got = sorted((r["doc_id"], round(r["score"], 4), r["base_score"]) for r in lm_score.lm_scores(prose).collect())
    assert [x[0] for x in got] == [x[0] for x in want]
    assert np.allclose([x[1:] for x in got], [x[1:] for x in want], rtol=1e-5)


def test_letters_are_category_l(spark):
    texts = ["²", "½ Ⅷ ①", "a²", "ª", "中", "12", "_", "́", None]
    df = spark.createDataFrame([(k, t, "xx" if k % 2 else "yy") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.language_id(df).collect()}
    assert [got[k] == "und" for k in range(len(texts))] == [True, True, False, False, False, True, True, True, True]


def test_samples_are_bounded(spark, prose):
    """A labelled id that many rows share gives the classifiers one row."""
    ids = [i for i in range(200) if remainder(i) != 0][:4]
    df = spark.createDataFrame([(ids[k % 4], f"text number {k} of some words") for k in range(400)], "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    assert quality.quality(df, labels).count() == 400
    seen = []
    original = quality.fitted
    quality.fitted = lambda x, y, c: seen.append(len(x)) or original(x, y, c)
    try:
        quality.learned(df, labels)
    finally:
        quality.fitted = original
    assert seen == [4]
