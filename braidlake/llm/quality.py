"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm.common import byte_texts, id_or_max, id_or_null, remainder

#: Word buckets, vector dimensions, non-zero places of an index vector, words on each side of a context.
BUCKETS, DIMS, PLACES, CONTEXT = 8192, 64, 4, 2
#: Bound of the labelled sample (rows), hidden units, passes; the sum of contexts is shuffled in so many pieces.
SAMPLE, HIDDEN, PASSES, PIECES = 12_000, 32, 40, 64
THRESHOLD = 0.3
_SHAPES = (re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+"))


def shape(word: bytes) -> bytes:
    """A word with runs of lower-case letters as a, upper-case as A, digits as 0; other characters stay."""
    for r, to in zip(_SHAPES, (b"a", b"A", b"0"), strict=True):
        word = r.sub(to, word)
    return b"\x00" + word


class _Buckets(dict):
    """Word -> bucket of the word and, times BUCKETS, of its shape. Emptied when large, so that memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        code = zlib.crc32(word.lower()) % BUCKETS + BUCKETS * (zlib.crc32(shape(word)) % BUCKETS)
        self[word] = code
        return code


def index_vectors() -> np.ndarray:
    """Sparse ternary index vectors of the buckets."""
    rng = np.random.default_rng(17)
    out = np.zeros((BUCKETS, DIMS), dtype=np.float32)
    for b in range(BUCKETS):
        out[b, rng.choice(DIMS, PLACES, replace=False)] = rng.choice((-1.0, 1.0), PLACES)
    return out


def _codes(text: bytes, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    both = np.array([buckets[w] for w in text.split()], dtype=np.int64)
    return both % BUCKETS, both // BUCKETS


def context_vectors(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Random indexing over all texts: a word bucket's vector is the sum of the index vectors of the words within CONTEXT of it, brought to length 1.

    Each task sums up its own table, of a fixed size; the tables are added piece by piece on the executors, and the
    driver gets BUCKETS x DIMS numbers.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, buckets = index_vectors(), _Buckets()
        total = np.zeros((BUCKETS, DIMS), dtype=np.float64)
        place = np.array([np.flatnonzero(v) for v in index])
        sign = np.take_along_axis(index, place, axis=1)
        held: list[np.ndarray] = []
        n = 0

        def add() -> None:
            ids = np.concatenate(held)  # documents are kept apart by CONTEXT empty places
            for d in range(1, CONTEXT + 1):
                a, b = ids[:-d], ids[d:]
                real = (a >= 0) & (b >= 0)
                a, b = a[real], b[real]
                for x, y in ((a, b), (b, a)):
                    at = x * DIMS
                    for k in range(PLACES):
                        total.ravel()[:] += np.bincount(at + place[y, k], weights=sign[y, k], minlength=BUCKETS * DIMS)

        gap = np.full(CONTEXT, -1)
        for batch in batches:
            for t in byte_texts(batch.column(0)):
                words = _codes(t, buckets)[0]
                held += [words, gap]
                n += len(words)
                if n > 1_000_000:
                    add()
                    held, n = [], 0
        if held:
            add()
        size = BUCKETS // PIECES
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES, dtype=np.int32)), pa.array([total[k * size : (k + 1) * size].astype(np.float32).tobytes() for k in range(PIECES)], type=pa.binary())], names=["piece", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("piece").to_pylist(), b.column("sums").to_pylist(), strict=True):
                v = np.frombuffer(x, dtype=np.float32).astype(np.float64)
                sums[k] = sums[k] + v if k in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.int32()), pa.array([v.tobytes() for v in sums.values()], type=pa.binary())], names=["piece", "sums"])

    pieces = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(local, "piece int, sums binary").repartition(PIECES, "piece").mapInArrow(added, "piece int, sums binary")
    out = np.zeros((BUCKETS, DIMS))
    for r in pieces.collect():  # PIECES rows
        size = BUCKETS // PIECES
        out[r["piece"] * size : (r["piece"] + 1) * size] += np.frombuffer(r["sums"], dtype=np.float64).reshape(size, DIMS)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


WIDTH = 3 * DIMS + 6


def pooled(text: bytes, index: np.ndarray, context: np.ndarray, buckets: _Buckets) -> np.ndarray:
    """Means of the words' context vectors, of their index vectors and of their shapes' index vectors; the lengths of these means, the share of different words, the logarithm of the number of words and the share of words that repeat the one before. Whole texts, in pieces."""
    words, shapes = _codes(text, buckets)
    n = len(words)
    out = np.zeros(WIDTH, dtype=np.float32)
    if not n:
        return out
    for k, (table, ids) in enumerate(((context, words), (index, words), (index, shapes))):
        which, often = np.unique(ids, return_counts=True)
        out[k * DIMS : (k + 1) * DIMS] = (often.astype(np.float32) / n) @ table[which]
        out[3 * DIMS + k] = np.linalg.norm(out[k * DIMS : (k + 1) * DIMS])
        if k == 1:
            out[3 * DIMS + 3] = len(which) / n
    out[3 * DIMS + 4] = np.log1p(n) / 10
    out[3 * DIMS + 5] = np.mean(words[1:] == words[:-1]) if n > 1 else 0.0
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    context: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray, context: np.ndarray) -> Network:
    """Two layers, Adam on the logistic loss over four fifths of the rows; the temperature that fits the last fifth best. Without rows of both labels the score is the share of label 1 (0.5 without rows)."""
    rng = np.random.default_rng(23)
    order = rng.permutation(len(x))
    cut = len(x) - len(x) // 5
    fit, held = order[:cut], order[cut:]
    mean = x[fit].mean(axis=0) if len(fit) else np.zeros(WIDTH)
    scale = x[fit].std(axis=0) + 1e-3 if len(fit) else np.ones(WIDTH)
    share = (y.sum() + 0.5) / (len(y) + 1)
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))), 1.0, context)
    if len(set(y.tolist())) < 2:
        return net
    z = (x - mean) / scale
    p = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(PASSES):
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 256)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(g, p[2]) * (1 - h**2)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
            t += 1
            for k, d in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d**2
                p[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    if len(held):
        logit = net.logits(x[held])
        loss = lambda s: np.log1p(np.exp(np.clip(-(2 * y[held] - 1) * logit / s, -30, 30))).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def _pool(rows: DataFrame, context: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, buckets = index_vectors(), _Buckets()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("label"), pa.array([pooled(t, index, context, buckets).tobytes() for t in byte_texts(b.column("text"))], type=pa.binary())], names=["k", "label", "x"])

    return rows.select(F.col("k").cast("string").alias("k"), "label", "text").mapInArrow(run, "k string, label int, x binary")


def learned(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """Word vectors from all texts; the network from at most `sample` labelled ids (documented bound) whose remainder is not 0, those of least hash. Null labels are left out; of several labels of an id the smallest counts, and of several texts that of the least vector, so the driver gets one row for each id."""
    context = context_vectors(df, text_col)
    known = labels.filter((remainder(id_col) != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.min(label_col).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("k"), "k").limit(sample)
    # at most `sample` rows of two numbers
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "k")
    got = sorted((bytes(r["x"]), r["label"]) for r in _pool(rows, context).groupBy("k", "label").agg(F.min("x").alias("x")).collect())
    x = np.frombuffer(b"".join(b for b, _ in got), dtype=np.float32).reshape(-1, WIDTH).astype(np.float64)
    return fitted(x, np.array([k for _, k in got], dtype=float), context)


_OUT = "id long, held_out boolean, score double, predicted int"


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, model: Network | None = None) -> DataFrame:
    """(id_col, held_out, score, predicted) per row of df, from the whole text and nothing else.

    score is the calibrated probability of label 1, predicted 1 from `threshold` on. Null and empty texts are scored
    like any text without words; repeated rows give repeated rows; an empty table gives an empty result, and without
    labels the score is 0.5. The model, of a fixed size (about 2 MB), is broadcast.
    """
    net = model or learned(df, labels, id_col, text_col, label_col)
    sent = df.sparkSession.sparkContext.broadcast(tuple(vars(net).values()))  # plain arrays: broadcasts are not pickled by value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, buckets, n = index_vectors(), _Buckets(), Network(*sent.value)
        for b in batches:
            x = np.stack([pooled(t, index, n.context, buckets) for t in byte_texts(b.column("text"))]) if b.num_rows else np.zeros((0, WIDTH))
            score = n.scores(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = df.select(id_or_max(id_col).alias("id"), (remainder(id_col) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, _OUT)
    return out.select(id_or_null(F.col("id")).alias(id_col), "held_out", "score", "predicted")


def accepted(df: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, **kwargs) -> DataFrame:
    """The rows of df whose score is `threshold` or more, with their columns; the whole rows pass through the scoring task, so nothing is shuffled.

    Null and empty texts are scored like any text without words; null and repeated ids are kept apart by nothing but their
    texts, so repeated rows stay or go together; texts are scored as a whole however long; an empty table gives an empty result, and
    without labels every row stays (score 0.5); columns may have any name, and any type that Arrow has.
    """
    net = learned(df, labels, text_col=text_col, **kwargs)
    sent = df.sparkSession.sparkContext.broadcast(tuple(vars(net).values()))  # plain arrays: broadcasts are not pickled by value
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, buckets, n = index_vectors(), _Buckets(), Network(*sent.value)
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(n.scores(np.stack([pooled(t, index, n.context, buckets) for t in byte_texts(b.column(at))])) >= threshold))

    return df.mapInArrow(run, df.schema)
