"""Language identification with error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm.common import byte_texts, id_or_max, id_or_null, remainder

#: Buckets of hashed n-grams, bound of the labelled sample (documents), least per language, passes of the optimiser.
BUCKETS, SAMPLE, LEAST, PASSES = 2048, 6000, 200, 60
UNKNOWN = "und"
_LOWER = np.array([c + 32 if 65 <= c <= 90 else 32 if c < 65 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256)], dtype=np.uint32)


def has_letter(text: bytes) -> bool:
    """Whether a character is of Unicode's category L, which digits, fractions, Roman numerals and circled signs are not. Looks in pieces, so that long texts are decoded only as far as needed."""
    return any(c.isalpha() for at in range(0, len(text), 4096) for c in text[at : at + 4100].decode("utf-8", "ignore"))


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-grams of bytes; what is neither an ASCII letter nor over 0x7F counts as a space. Whole texts."""
    x = _LOWER[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    with np.errstate(over="ignore"):
        two = x[:-1] * np.uint32(0x9E3779B1) ^ x[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) ^ x[2:] * np.uint32(0x27D4EB2F)
    n = np.zeros(BUCKETS)
    for h in (x * np.uint32(0x9E3779B1), two, three):
        n += np.bincount((h >> np.uint32(15)) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return np.sqrt(n / n.sum()).astype(np.float32)


def codewords(classes: int) -> np.ndarray:
    """A row of -1 and 1 per class. Up to 7 classes: the exhaustive code, 2^(k-1) - 1 bits; more: the best of 50 seeded random codes of
    about 10 log2(k) bits by least row distance. One class: a single bit."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 7:
        cols = [(1, *rest) for rest in itertools.product((1, -1), repeat=classes - 1) if -1 in rest]
        return np.array(cols, dtype=float).T
    rng, bits = np.random.default_rng(5), int(np.ceil(10 * np.log2(classes)))
    codes = [np.where(rng.random((classes, bits)) < 0.5, -1.0, 1.0) for _ in range(50)]
    return max(codes, key=lambda c: min(np.count_nonzero(a != b) for a, b in itertools.combinations(c, 2)))


@dataclass
class Model:
    names: list[str]
    code: np.ndarray  # class x bit
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray
    loss_weight: np.ndarray  # per bit, from the training accuracy of its classifier

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss-weighted decoding: the codeword with the least logistic loss; its share by the mean loss of a bit; whether another is near."""
        loss = np.log1p(np.exp(-np.clip(self.code[None] * margins[:, None, :], -30, 30))) @ self.loss_weight
        order = np.sort(loss, axis=1)
        best = loss.argmin(axis=1)
        share = np.exp(-8 * (loss - order[:, :1]) / self.loss_weight.sum())
        score = 1 / share.sum(axis=1)
        return best, score, score < 0.6


def fitted(x: np.ndarray, names: list[str]) -> Model:
    """Logistic classifiers of the codeword's bits, by Adam over the whole sample. Without rows: a model without classes."""
    classes = sorted(set(names))
    code = codewords(len(classes))
    at = {c: k for k, c in enumerate(classes)}
    y = code[[at[n] for n in names]] if classes else np.zeros((0, 1))
    w, b = np.zeros((BUCKETS, code.shape[1])), np.zeros(code.shape[1])
    if len(classes) > 1:
        share = np.bincount([at[n] for n in names], minlength=len(classes))
        row = (1 / share)[[at[n] for n in names]][:, None] / len(classes)  # classes count alike
        mw, vw, mb, vb = (np.zeros_like(a) for a in (w, w, b, b))
        for t in range(1, PASSES + 1):
            g = -y * row / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
            gw, gb = x.T @ g + 1e-5 * w, g.sum(axis=0)
            mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
            c1, c2 = 1 - 0.9**t, 1 - 0.99**t
            w -= 0.5 * mw / c1 / (np.sqrt(vw / c2) + 1e-8)
            b -= 0.5 * mb / c1 / (np.sqrt(vb / c2) + 1e-8)
    right = ((y * (x @ w + b)) > 0).mean(axis=0) if len(names) else np.zeros(code.shape[1])
    return Model(classes, code, w.astype(np.float32), b.astype(np.float32), np.maximum(2 * right - 1, 0.05))


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).astype(np.float16).tobytes() for t in byte_texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array(x, type=pa.binary())], names=["id", "lang", "x"])

    return rows.select("id", "lang", "text").mapInArrow(run, "id string, lang string, x binary")


def learned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, least: int = LEAST) -> Model:
    """Fits on about `sample` labelled documents (at most sample + least per language) whose id has another remainder than 0.

    The sample is drawn by the hash of the id, at a rate per language from counts over all rows: all of a language
    with no more than its even share or `least`, otherwise that many. Rows that share id and language count once, as
    that of the least features, so that a repeated id can't swell the sample.
    """
    text = F.col(text_col).cast("string")
    rows = df.filter((remainder(id_col) != 0) & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return fitted(np.zeros((0, BUCKETS), np.float32), [])
    rates = {k: min(1.0, max(least, sample // len(counts)) / n) for k, n in counts.items()}
    rate = F.element_at(F.create_map(*[F.lit(v) for kv in rates.items() for v in kv]), F.col("lang"))
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1_000_003)) < rate * 1_000_003).filter(F.col("text").isNotNull())
    got = sorted((r["lang"], bytes(r["x"])) for r in _featured(drawn).groupBy("id", "lang").agg(F.min("x").alias("x")).collect())
    x = np.frombuffer(b"".join(b for _, b in got), dtype=np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return fitted(x, [k for k, _ in got])


def language_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(id_col, held_out, lang_pred, score, ambiguous) per row of df, from the whole text and nothing else.

    Error-correcting output codes: binary classifiers of hashed byte n-grams give the bits' margins, loss-weighted
    decoding the nearest codeword; score is its share against the other codewords, and below 0.6 the row is ambiguous.

    lang_pred is `und`, with score 0, where the text is null or has no letter, or where nothing could be learned. With
    one learned language every other text gets it, at score 1. Null labels are not learned from; repeated rows give repeated
    rows; an empty table gives an empty result; the model, of a fixed size, goes to the executors with the task.
    """
    m = model or learned(df, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margins, known = np.zeros((b.num_rows, m.code.shape[1])), np.zeros(b.num_rows, dtype=bool)
            for k, t in enumerate(byte_texts(b.column("text"))):
                if m.names and has_letter(t):
                    known[k] = True
                    margins[k] = features(t) @ m.weights + m.bias
            if m.names:
                best, score, near = m.decode(margins)
                names = [m.names[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
            else:
                score, near, names = np.zeros(b.num_rows), known, [UNKNOWN] * b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("held_out"), pa.array(names, type=pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(known & near)], names=["id", "held_out", "lang_pred", "score", "ambiguous"]
            )

    rows = df.select(id_or_max(id_col).alias("id"), (remainder(id_col) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
    return out.select(id_or_null(F.col("id")).alias(id_col), "held_out", "lang_pred", "score", "ambiguous")
