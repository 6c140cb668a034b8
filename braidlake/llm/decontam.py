"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import itertools
import math
import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm.common import byte_texts, fresh_path, id_or_max, id_or_null

WINDOW = 13
#: Words of one automaton, about; a larger benchmark is dealt over several. Bytes of texts that a task holds to take them past each of several automata.
SHARD_WORDS, HELD_BYTES = 400_000, 64_000_000
#: What is no word character becomes a space, A-Z lower case: words are runs of 0-9, a-z and bytes over 0x7F.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items that own each state's windows.

    full[v]: the items in which the last `window` words of state v's strings occur; short[v]: (length, item) of the
    items that are shorter than a window and a suffix of these strings.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        short: dict[int, list[tuple[int, int]]] = {}
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)), ends)
                ends[last].add(item)
            if words and len(words) < window:
                short.setdefault(last, []).append((len(words), item))
        order = sorted(range(len(self.next)), key=self.length.__getitem__, reverse=True)
        for v in order:
            if self.link[v] > 0 and self.length[self.link[v]] >= window:
                ends[self.link[v]] |= ends[v]
        # what a state reports once `window` words match: items of the suffix state that holds the window
        self.full: list[frozenset[int]] = [frozenset()] * len(self.next)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for v in reversed(order):
            up = self.link[v]
            if v and self.length[v] >= window:
                self.full[v] = self.full[up] if up > 0 and self.length[up] >= window else frozenset(ends[v])
            self.short[v] = (*(self.short[up] if up > 0 else ()), *sorted(short.get(v, ())))

    def _extend(self, last: int, c: int, ends: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q, ends)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append(set())
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q, ends)
        return cur

    def _clone(self, p: int, c: int, q: int, ends: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        k = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        ends.append(set())
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = k
            p = link[p]
        link[q] = k
        return k

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Streams words; gives the hit spans (first, one past the last), merged and in order, and the items seen."""
        nxt, link, length, window, full, short = self.next, self.link, self.length, self.window, self.full, self.short
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        v = n = 0
        for i, c in enumerate(map(self.ids.get, words)):
            if c is None:
                v = n = 0
                continue
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            v = nxt[v].get(c, 0)
            n = n + 1 if v else 0
            start = i + 1
            if n >= window:
                items |= full[v]
                start = i + 1 - window
            if short[v]:
                for size, item in short[v]:
                    if size <= n:
                        items.add(item)
                        start = min(start, i + 1 - size)
            if start <= i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items


_HITS = "id long, n_words long, spans array<struct<first:int,past:int>>, items array<long>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))


def matched(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, n_words, spans, items) per row: hit word spans and the items that occur. Null texts have no words, items without words never occur.

    The benchmark, the stated query set, is dealt by the hash of the item into shards of about shard_words words (about
    100 MB of automaton), each a file in the shared folder, so that none of it passes the driver and nothing is broadcast.
    The texts stream through the shards' automata without a shuffle and are read once: with one shard it is built once
    a task; with several a task takes HELD_BYTES of texts past one after the other, which bounds what it holds and
    makes up for building them.
    """
    shards = _shards(benchmark, item_col, item_text, shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, counts, spans, items in _scanned(batches, shards, window, 1):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, type=pa.int64()), pa.array([[{"first": x, "past": y} for x, y in s] for s in spans], type=_SPANS), pa.array(items, type=pa.list_(pa.int64()))],
                names=["id", "n_words", "spans", "items"],
            )

    return docs.select(id_or_max(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _HITS)


def _shards(benchmark: DataFrame, item_col: str, item_text: str, shard_words: int) -> list[str]:
    """Writes the benchmark's items as pickled lists of (item, words), each list's words about shard_words; gives the files."""
    spark = benchmark.sparkSession
    folder = fresh_path(spark, "shards")
    items = benchmark.select(id_or_max(item_col).alias("i"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    # a word and what parts it from the next are two bytes at least, six on average
    size = items.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(size / 6 / shard_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list[bytes]]]] = {}
        for b in batches:
            for k, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2)), strict=True):
                if w := words_of(t):
                    held.setdefault(k, []).append((i, w))
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for k, some in held.items():
            name = f"{k:06d}-{uuid.uuid4().hex}.pickle"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(pickle.dumps(some))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

    dealt = items.select(F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int").alias("k"), "i", "t").repartition(n, "k")
    return sorted(r["path"] for r in dealt.mapInArrow(run, "path string").collect())  # one row per file


def _loaded(path: str, window: int) -> Automaton:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name) as f:
        return Automaton(pickle.loads(f.read()), window)


def _scanned(batches: Iterator[pa.RecordBatch], shards: list[str], window: int, at: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[list[tuple[int, int]]], list[list[int]]]]:
    """Each batch with the word counts, spans and items of its column `at` of texts."""
    only = _loaded(shards[0], window) if len(shards) == 1 else None
    most = HELD_BYTES if len(shards) > 1 else 0
    batches = iter(batches)
    while held := list(itertools.islice(batches, 1)):
        size = held[0].column(at).nbytes
        while size < most and (more := next(batches, None)) is not None:
            held.append(more)
            size += more.column(at).nbytes
        counts = [[len(words_of(t)) for t in byte_texts(b.column(at))] if not only else [] for b in held]
        spans: list[list[list[tuple[int, int]]]] = [[[] for _ in range(b.num_rows)] for b in held]
        items: list[list[set[int]]] = [[set() for _ in range(b.num_rows)] for b in held]
        for path in shards:
            a = only or _loaded(path, window)
            for k, b in enumerate(held):
                for r, t in enumerate(byte_texts(b.column(at))):
                    w = words_of(t)
                    if only:
                        counts[k].append(len(w))
                    found, seen = a.scan(w)
                    spans[k][r] += found
                    items[k][r] |= seen
        for k, b in enumerate(held):
            yield b, counts[k], [_union(s) for s in spans[k]] if not only else spans[k], [sorted(x) for x in items[k]]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", share: int = 20, **kwargs) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated) per row of docs.

    A document word inside any occurrence of a window of 13 consecutive item words, or of a whole shorter item, is
    hit; contaminated if the hit words are one in `share` or more. Null and empty texts have no words and are clean;
    repeated rows give repeated rows; an empty benchmark or table gives no hits or no rows; other columns are not read.
    """
    m = matched(docs, benchmark, id_col, **kwargs)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["past"] - s["first"]).cast("long"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    rows = m.select("id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return rows.select(id_or_null(F.col("id")).alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def cleaned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: int = 20, window: int = WINDOW, item_col: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs without benchmark passages, with the columns of docs.

    A document of which one word in `share` or more is hit is dropped (coverage limit); from any other the hit spans,
    each at least a window or a whole short item long, are cut, with what separates them from the next word. Only the
    text changes, and n_chars where there is such a column; rows without a hit stay as they are, byte for byte.

    Null and empty texts have no words and stay; ids are not looked at, so null and repeated ids make no difference, and repeated
    rows stay or go together; texts are read as a whole however long; an empty benchmark or table drops nothing; columns may
    have any name, and any type that Arrow has.
    """
    shards = _shards(benchmark, item_col, item_text, shard_words)
    at, size = docs.columns.index(text_col), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, counts, spans, _ in _scanned(batches, shards, window, at):
            if not any(spans):
                yield b
                continue
            keep = [k for k, s in enumerate(spans) if not s or share * sum(y - x for x, y in s) < counts[k]]
            out = b.take(pa.array(keep, type=pa.int64()))
            texts = [removed(t, spans[k]).decode() if spans[k] else None for k, t in zip(keep, byte_texts(out.column(at)), strict=True)]
            cols = list(out.columns)
            cols[at] = pa.array([old.as_py() if new is None else new for old, new in zip(cols[at], texts, strict=True)], type=cols[at].type)
            if size is not None:
                cols[size] = pa.array([old.as_py() if new is None else len(new) for old, new in zip(cols[size], texts, strict=True)], type=cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def removed(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans; what stands between a removed word and the next word goes with it."""
    folded = text.translate(_FOLD)
    starts: list[int] = []
    at = 0
    for w in folded.split():
        at = folded.index(w, at)
        starts.append(at)
        at += len(w)
    out, at = b"", 0
    for a, b in spans:
        out += text[at : starts[a]]
        at = starts[b] if b < len(starts) else len(text)
    return out + text[at:]
