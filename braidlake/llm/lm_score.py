"""Language-model scoring: a subword lattice over an existing vocabulary, with word counts of the corpus above it."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm.common import byte_texts, id_or_max, id_or_null, remainder, shuffle_width, stored
from braidlake.llm.lattice import Lattice, normalised, read_vocabulary

#: Rounds of re-estimation of the piece weights, weight of the vocabulary's own scores in pieces, discount of word counts, weight of the corpus against a text's own words so far.
ROUNDS, PRIOR, DISCOUNT, STRENGTH = 3, 200.0, 0.6, 3000.0
#: Classes of training texts at most, and the share of a word's probability that all classes together give.
CLASSES, SHARED = 5, 0.05
HELD_OUT = 1
#: Words whose segmentations are looked at in one call, about, and different words of a task's blocks beyond which they are sent on.
TOGETHER, HELD = 50_000, 1_000_000
#: Text bytes of a block of documents and of a part of the words: there are as many as the shuffle partitions at least.
BLOCK_BYTES, PART_BYTES = 64_000_000, 2_000_000_000
#: The end of a text, which no word equals; the class of texts that nothing is learned from.
END, NO_CLASS = b"", -1

_PAIRS = "part int, block int, words binary, counts binary"
_TYPES = "part int, words binary, counts binary"


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at 0x20 and 0x09-0x0D."""
    return text.lower().split()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _joined(words: list[bytes]) -> pa.Array:
    return pa.array([b"\n".join(words)], pa.binary())


def _vocabularies(texts: DataFrame, parts: int, classes: int) -> DataFrame:
    """For each block of documents and part of the words: the different words there and their counts by class in training texts. A block may come in several rows."""

    def packed(block: int, by_class: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        place: dict[bytes, int] = {}
        for c in by_class.values():
            for w in c:
                place.setdefault(w, len(place))
        counts = np.zeros((len(place), classes), dtype=np.int32)
        for cls, c in by_class.items():
            if cls != NO_CLASS:
                counts[[place[w] for w in c], cls] = list(c.values())
        words = list(place)
        part = np.array([zlib.crc32(w) % parts for w in words])
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        for at in np.split(order, cuts[1:]):
            yield pa.RecordBatch.from_arrays([pa.array([part[at[0]]], pa.int32()), pa.array([block], pa.int32()), _joined([words[i] for i in at]), pa.array([counts[at].tobytes()], pa.binary())], names=["part", "block", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, dict[int, Counter]] = {}
        for b in batches:
            for block, cls, t in zip(b.column("block").to_pylist(), b.column("cls").to_pylist(), byte_texts(b.column("text")), strict=True):
                c = seen.setdefault(block, {}).setdefault(cls, Counter())
                w = words_of(t)
                w.append(END)
                c.update(dict.fromkeys(w, 0) if cls == NO_CLASS else w)
            if sum(len(c) for x in seen.values() for c in x.values()) > HELD:
                for block, x in seen.items():
                    yield from packed(block, x)
                seen = {}
        for block, x in seen.items():
            yield from packed(block, x)

    return texts.mapInArrow(run, _PAIRS)


def _counted(pairs: DataFrame, parts: int, classes: int) -> DataFrame:
    """The training words and their counts by class over the corpus, a row for each part. A task holds the different words of its part and nothing of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, dict[bytes, int]] = {}
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for part, words, counts in zip(*(b.column(c).to_pylist() for c in ("part", "words", "counts")), strict=True):
                n = np.frombuffer(counts, np.int32).reshape(-1, classes)
                learned = n.any(axis=1)
                if not learned.any():
                    continue
                place, total = places.setdefault(part, {}), totals.get(part, np.zeros((0, classes), np.int64))
                at = np.array([place.setdefault(w, len(place)) for w, k in zip(words.split(b"\n"), learned, strict=True) if k], dtype=np.int64)
                if len(place) > len(total):
                    total = np.concatenate([total, np.zeros((max(len(place), 1000), classes), np.int64)])  # at least doubles
                total[at] += n[learned]  # a row's words are different ones
                totals[part] = total
        for part, place in places.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), _joined(list(place)), pa.array([totals[part][: len(place)].tobytes()], pa.binary())], names=["part", "words", "counts"])

    return pairs.repartition(parts, "part").mapInArrow(run, _TYPES)


def _estimated(types: DataFrame, lattices: list[Lattice]) -> np.ndarray:
    """Expected uses of each piece in each class over the segmentations of the class's different training words; summed by Spark, at most a row for each piece and class."""
    shape = (len(lattices), len(lattices[0].pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        held: list[list[bytes]] = [[] for _ in lattices]

        def flush(k: int) -> None:
            if held[k]:
                total[k] += lattices[k].expected(held[k])
                held[k] = []

        for b in batches:
            for words, counts in zip(b.column("words").to_pylist(), b.column("counts").to_pylist(), strict=True):
                n, words = np.frombuffer(counts, np.int64).reshape(-1, shape[0]), words.split(b"\n")
                for k in range(shape[0]):
                    held[k] += [words[i] for i in np.flatnonzero(n[:, k]) if words[i]]
                    if len(held[k]) >= TOGETHER:
                        flush(k)
        for k in range(shape[0]):
            flush(k)
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int64()), pa.array(total[k, at])], names=["cls", "piece", "n"])

    out = np.zeros(shape)
    for r in types.mapInArrow(run, "cls int, piece long, n double").groupBy("cls", "piece").agg(F.sum("n").alias("n")).collect():
        out[r["cls"], r["piece"]] = r["n"]
    return out


def _statistics(types: DataFrame, classes: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Different tokens in all; tokens with ends, different tokens and ends of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, counts in zip(b.column("words").to_pylist(), b.column("counts").to_pylist(), strict=True):
                n = np.frombuffer(counts, np.int64).reshape(-1, classes)
                words = words.split(b"\n")
                ends = n[words.index(END)] if END in words else np.zeros(classes, np.int64)
                for k in range(classes):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([int(n[:, k].sum())]), pa.array([int((n[:, k] > 0).sum())]), pa.array([int(ends[k])]), pa.array([len(n) if not k else 0])], names=["cls", "n", "v", "ends", "every"])

    every, n, v, ends = 0, *np.zeros((3, classes), np.int64)
    for r in types.mapInArrow(run, "cls long, n long, v long, ends long, every long").groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("n", "v", "ends", "every")]).collect():
        n[r["cls"]], v[r["cls"]], ends[r["cls"]] = r["n"], r["v"], r["ends"]
        every += r["every"]
    return every, n, v, ends


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, vocabulary: str | None = None, held_out: int = HELD_OUT, rounds: int = ROUNDS, prior: float = PRIOR, discount: float = DISCOUNT, strength: float = STRENGTH, classes: int = CLASSES, shared: float = SHARED) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score, bits_per_token) per row of df.

    Tokens are the text's words and one end. lattice_score is log10 of the text's marginal probability over all segmentations
    of its words into pieces of the existing vocabulary, by the vocabulary's own scores alone: the forward recursion in log space.

    score is the same marginal in a lattice that has learned from the training texts (those whose remainder is not held_out):
    the weights of the pieces start from the vocabulary's scores, which stay in as a prior, and are re-estimated by
    expectation maximisation over all different training words; and each training word is a further edge of the
    lattice, from the word's start to its end, by its discounted count, while the pieces' paths share the mass set free by
    the discount. Within a text, each word also draws on the words before it (Polya's urn with `strength` for the corpus).

    With class_col the training texts are told apart by its values (the classes - 1 most frequent, and all others with
    null), each class has its counts and piece weights, mixed with `shared` of all classes, and a text's
    probability is the sum over the classes of prior times probability; a scored text's own class is never looked at.
    So the probabilities of all texts still sum up to one. base_score is the add-one-half unigram of the same tokens.

    Nothing of the corpus is collected or broadcast but sums. Documents are dealt by the hash of id and text into blocks of
    about BLOCK_BYTES, words by theirs into parts of about PART_BYTES of text. Each block sends its different words, packed
    by part, to be counted; counts and probabilities go back to the block, whose texts then stream past them. So a
    frequent word is one entry per block, a task holds the different words of a part or of a block, and neither grows with the table.

    Null texts count as empty (only the end); a null id counts as the largest one; repeated rows give repeated rows and
    count as often in training; texts are scored as a whole however long; without training texts the lattice alone gives the
    words' probabilities, with the vocabulary's own weights; an empty table gives an empty result; other columns are not read.
    """
    spark, width = df.sparkSession, shuffle_width(df.sparkSession)
    size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    blocks, parts = max(width, math.ceil(size / BLOCK_BYTES)), max(width, math.ceil(size / PART_BYTES))
    if class_col is None:
        classes, cls = 1, F.lit(0)
    else:
        common = [r["c"] for r in df.filter(F.col(class_col).isNotNull() & (remainder(id_col) != held_out)).groupBy(F.col(class_col).cast("string").alias("c")).count().orderBy(F.desc("count"), "c").limit(classes - 1).collect()]
        classes = len(common) + 1
        cls = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(common) for x in (c, k)]), F.col(class_col).cast("string")), F.lit(classes - 1)) if common else F.lit(0)
    texts = df.select(id_or_max(id_col).alias("id"), (remainder(id_col) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.when(remainder(id_col) == held_out, NO_CLASS).otherwise(cls).cast("int").alias("cls")).withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    pairs = stored(_vocabularies(texts.select("text", "cls", "block").repartition(blocks, "block"), parts, classes), "words")
    types = stored(_counted(pairs, parts, classes), "counts")
    different, n, v, ends = _statistics(types, classes)
    tokens = int(n.sum())

    pieces, logp = read_vocabulary(vocabulary or default_vocabulary())
    own = np.exp(logp) / np.exp(logp).sum()
    lattices = [normalised(pieces, own, 0.3)] * classes
    for _ in range(rounds if different else 0):
        lattices = [normalised(pieces, e + prior * own, k + 0.3 * prior) for e, k in zip(_estimated(types, lattices), v, strict=True)]

    words_n, words_v = n - ends, v - (ends > 0)
    log_end = np.log((ends + 0.5) / (n + 1))
    log_word = np.log1p(-np.exp(log_end))
    weight = np.log((ends + 0.5) / (ends.sum() + 0.5 * classes))  # of the classes; each training text has one end
    spare = np.log(np.where(words_n > 0, discount * words_v / np.maximum(words_n, 1), 1.0))
    one = normalised(pieces, own, 0.3)
    # the vocabulary, of fixed size, by class, and by its own scores
    sent = spark.sparkContext.broadcast((pieces, np.stack([*(x.logp for x in lattices), one.logp]), [*(x.log_stop for x in lattices), one.log_stop]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs, stops = sent.value
        model = Lattice(names, logs[0], stops[0])
        now, place, total, logq = None, {}, np.zeros((0, classes), np.int64), np.zeros((0, classes + 1), np.float32)
        held: list[tuple[int, np.ndarray]] = []
        new: list[bytes] = []

        def enter(words: list[bytes]) -> np.ndarray:
            known = len(place)
            at = np.array([place.setdefault(w, len(place)) for w in words], dtype=np.int64)
            new.extend(w for w, i in zip(words, at, strict=True) if i >= known)
            return at

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal total, logq
            if new:
                total = np.concatenate([total, np.zeros((len(place) - len(total), classes), np.int64)])
                q = model.log_probabilities_by(new, logs, np.array(stops))
                pieces_q, alone = q[:, :classes] + spare, q[:, classes:]
                with np.errstate(divide="ignore"):
                    both = np.logaddexp(pieces_q, np.log(np.maximum(total[len(logq) :] - discount, 0) / np.maximum(words_n, 1)))
                if classes > 1:
                    every = _log_sum(both + weight, 1)
                    both = np.logaddexp(both + np.log1p(-shared), every[:, None] + np.log(shared))
                logq = np.concatenate([logq, np.concatenate([both, alone], axis=1).astype(np.float32)])
                new.clear()
            every_n = total.sum(axis=1)
            for block, at in held:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), _joined([by[i] for i in at]), pa.array([every_n[at].tobytes()], pa.binary()), pa.array([logq[at].tobytes()], pa.binary())], names=["block", "words", "counts", "logq"])
            held.clear()

        by: list[bytes] = []
        waiting = 0
        for b in batches:
            for part, block, words, counts in zip(*(b.column(c).to_pylist() for c in ("part", "block", "words", "counts")), strict=True):
                words = words.split(b"\n")
                if part != now:
                    yield from flush()
                    now, place, by, waiting = part, {}, [], 0
                    total, logq = np.zeros((0, classes), np.int64), np.zeros((0, classes + 1), np.float32)
                at = enter(words)
                by.extend(new[len(new) - (len(place) - len(by)) :])
                if block < 0:  # the part's training words come first
                    total = np.frombuffer(counts, np.int64).reshape(-1, classes)
                    continue
                held.append((block, at))
                waiting += len(at)
                if waiting >= 10 * TOGETHER:
                    yield from flush()
                    waiting = 0
        yield from flush()

    first = types.select("part", F.lit(-1).alias("block"), "words", "counts").unionByName(pairs.withColumn("counts", F.lit(b"")))
    answers = first.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(answer, "block int, words binary, counts binary, logq binary")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of blocks, the words' counts and probabilities of each before its texts."""
        now, place, ready = None, {}, False
        counts: list[np.ndarray] = []
        logs_of: list[np.ndarray] = []
        total, q, alone, base = np.zeros(0), np.zeros((0, classes)), np.zeros(0), np.zeros(0)
        for b in batches:
            out, rows = [], []
            block_of, is_text, words_in = b.column("block").to_pylist(), b.column("kind").to_pylist(), b.column("words")
            for r, t in enumerate(byte_texts(b.column("text"))):
                if block_of[r] != now:
                    now, place, counts, logs_of, ready = block_of[r], {}, [], [], False
                if not is_text[r]:
                    words, n = words_in[r].as_py().split(b"\n"), np.frombuffer(b.column("counts")[r].as_py(), np.int64)
                    known = len(place)
                    at = [place.setdefault(w, len(place)) for w in words]
                    fresh = np.array(at) >= known  # a block's rows may share words
                    counts.append(n[fresh])
                    logs_of.append(np.frombuffer(b.column("logq")[r].as_py(), np.float32).reshape(-1, classes + 1)[fresh])
                    continue
                if not ready:
                    total, both = np.concatenate(counts), np.concatenate(logs_of).astype(float)
                    q, alone = np.exp(both[:, :classes]), both[:, classes]
                    base = np.log10((total + 0.5) / (tokens + 0.5 * (different + 1)))
                    counts, logs_of, ready = [], [], True
                at = np.fromiter(map(place.__getitem__, words_of(t)), dtype=np.int64)
                size = len(at)
                order = np.argsort(at, kind="stable")
                start = np.flatnonzero(np.diff(at[order], prepend=-1))
                before = np.empty(size)
                before[order] = np.arange(size) - np.repeat(start, np.diff(start, append=size))  # how often the word came before
                logs = np.zeros(classes)
                for a in range(0, size, 50_000):  # very long texts in pieces
                    s = slice(a, a + 50_000)
                    p = (before[s, None] + strength * q[at[s]]) / (np.arange(size)[s, None] + strength)
                    logs += np.log(p).sum(axis=0)
                e = place[END]
                rows.append(r)
                lattice_log = alone[at].sum() + size * plain_word + plain_end
                out.append((size + 1, int((total[at] > 0).sum() + (total[e] > 0)), float(base[at].sum() + base[e]), float(_log_sum(weight + logs + size * log_word + log_end, 0) / np.log(10)), float(lattice_log / np.log(10))))
            if rows:
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("held_out").take(take), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "held_out", "n_tokens", "n_known", "base_score", "score", "lattice_score"])

    plain_end = float(np.log((ends.sum() + 0.5) / (n.sum() + 1)))
    plain_word = float(np.log1p(-np.exp(plain_end)))
    empty = {"id": "long", "held_out": "boolean", "text": "string", "words": "binary", "counts": "binary", "logq": "binary"}
    asked = texts.select("block", F.lit(1).alias("kind"), "id", "held_out", "text", *[F.lit(None).cast(empty[c]).alias(c) for c in ("words", "counts", "logq")])
    given = answers.select("block", F.lit(0).alias("kind"), *[F.lit(None).cast(empty[c]).alias(c) for c in ("id", "held_out", "text")], "words", "counts", "logq")
    met = given.union(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    scored = met.mapInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, lattice_score double")
    bits = -F.col("score") / F.col("n_tokens") / F.log10(F.lit(2.0))
    return scored.select(id_or_null(F.col("id")).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "lattice_score", bits.alias("bits_per_token"))
