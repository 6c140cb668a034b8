"""Sums over all segmentations of words into the pieces of an existing vocabulary, many words at a time."""

from __future__ import annotations

import math

import numpy as np

#: Words of more bytes than this are treated one by one, others many of a length at a time.
WIDE = 40
_R = np.uint64(0x9E3779B97F4A7C15)


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def read_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces and log-probabilities from a SentencePiece file. Its piece scores are minus the rank (a BPE vocabulary has no
    probabilities of its own), which Zipf's law turns into probabilities. Every byte is a piece, so each word has a segmentation."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i).replace("▁", " ").encode().lower()
        if b" " not in piece[1:]:  # others span several words
            found[piece] = max(found.get(piece, -1e9), sp.get_score(i))
    for b in range(256):
        found.setdefault(bytes([b]), -float(sp.get_piece_size()))
    pieces = sorted(found)
    rank = np.array([-found[p] for p in pieces])
    return pieces, np.log(1 / (rank - rank.min() + 10))


class Lattice:
    """Pieces with probabilities. The first piece of a word begins with the space and is drawn among such pieces; then each step
    either ends the word or draws another piece. So the probabilities of all words sum up to one at most."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray, log_stop: float):
        self.pieces, self.logp, self.log_stop = pieces, logp, log_stop
        self.longest = max(map(len, pieces))
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.array([len(p) for p in pieces])
        for n in range(1, self.longest + 1):
            ids = np.flatnonzero(sizes == n)
            h = self._hash(np.frombuffer(b"".join(pieces[i] for i in ids), dtype=np.uint8).reshape(-1, n)) if len(ids) else np.array([], np.uint64)
            order = np.argsort(h)
            self.tables.append((h[order], ids[order]))
        self.by_piece: dict[bytes, int] | None = None
        self.logs: list[float] | None = None

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(rows.shape[1]):
                h = (h + rows[:, k].astype(np.uint64) + np.uint64(1)) * _R
                h ^= h >> np.uint64(29)
        return h

    def _edges(self, rows: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(start, end) -> the words that have a piece there and its number. rows: words of one length with the space before them."""
        out, n = {}, rows.shape[1]
        with np.errstate(over="ignore"):
            for a in range(n):
                h = np.zeros(len(rows), dtype=np.uint64)
                for b in range(a, min(n, a + self.longest)):
                    h = (h + rows[:, b].astype(np.uint64) + np.uint64(1)) * _R
                    h ^= h >> np.uint64(29)
                    known, ids = self.tables[b - a]
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        hit = np.flatnonzero(known[at] == h)
                        if len(hit):
                            out[a, b + 1] = hit, ids[at[hit]]
        return out

    def _forward(self, edges: dict, count: int, n: int) -> np.ndarray:
        alpha = np.full((n + 1, count), -np.inf)
        alpha[0] = 0.0
        for b in range(1, n + 1):
            for a in range(max(0, b - self.longest), b):
                if (a, b) in edges:
                    hit, ids = edges[a, b]
                    alpha[b, hit] = np.logaddexp(alpha[b, hit], alpha[a, hit] + self.logp[ids])
        return alpha

    def _by_length(self, words: list[bytes], most: int = 20_000):
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths):
            if n <= WIDE:
                which = np.flatnonzero(lengths == n)
                for k in range(0, len(which), most):
                    some = which[k : k + most]
                    yield some, np.frombuffer(b"".join(b" " + words[i] for i in some), dtype=np.uint8).reshape(len(some), n + 1)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's marginal probability over all segmentations."""
        out = np.zeros(len(words))
        for which, rows in self._by_length(words):
            out[which] = self._forward(self._edges(rows), len(rows), rows.shape[1])[-1]
        for i, w in enumerate(words):
            if len(w) > WIDE:
                out[i] = self._long(w)
        return out + self.log_stop

    def log_probabilities_by(self, words: list[bytes], logs: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """log_probabilities under several sets of weights (rows of logs) at once: word x set. The pieces in the words are looked up once."""
        out = np.zeros((len(words), len(logs)))
        for which, rows in self._by_length(words):
            n, edges = rows.shape[1], self._edges(rows)
            alpha = np.full((n + 1, len(rows), len(logs)), -np.inf)
            alpha[0] = 0.0
            for b in range(1, n + 1):
                for a in range(max(0, b - self.longest), b):
                    if (a, b) in edges:
                        hit, ids = edges[a, b]
                        alpha[b, hit] = np.logaddexp(alpha[b, hit], alpha[a, hit] + logs.T[ids])
            out[which] = alpha[n]
        if wide := [i for i, w in enumerate(words) if len(w) > WIDE]:
            for i in wide:
                out[i] = self._long_by(words[i], logs.T)
        return out + stops

    def _ends(self, text: bytes, b: int) -> list[tuple[int, int]]:
        """(length, number) of the pieces that end at b."""
        if self.by_piece is None:
            self.by_piece = {p: i for i, p in enumerate(self.pieces)}
        return [(n, i) for n in range(1, min(self.longest, b) + 1) if (i := self.by_piece.get(text[b - n : b])) is not None]

    def _long_by(self, word: bytes, logs: np.ndarray) -> np.ndarray:
        """One long word under several sets of weights: piece x set."""
        text, alpha = b" " + word, [np.zeros(logs.shape[1])]
        for b in range(1, len(text) + 1):
            back, ids = zip(*self._ends(text, b), strict=True)
            alpha.append(np.logaddexp.reduce(np.array([alpha[-n] for n in back]) + logs[list(ids)], axis=0))
            del alpha[: -self.longest]
        return alpha[-1]

    def _long(self, word: bytes) -> float:
        """One long word; holds the last sums only."""
        text, alpha = b" " + word, [0.0]
        logp = self._plain_logs()
        for b in range(1, len(text) + 1):
            alpha.append(_log_sum([alpha[-n] + logp[i] for n, i in self._ends(text, b)]))
            del alpha[: -self.longest]
        return alpha[-1]

    def _plain_logs(self) -> list[float]:
        if self.logs is None:
            self.logs = self.logp.tolist()
        return self.logs

    def _expected_long(self, word: bytes, total: np.ndarray) -> None:
        """Adds the expected uses of each piece in one long word."""
        text, alpha, logp = b" " + word, [0.0], self._plain_logs()
        starts: list[list[tuple[int, int]]] = [[] for _ in text]
        for b in range(1, len(text) + 1):
            ends = self._ends(text, b)
            alpha.append(_log_sum([alpha[b - n] + logp[i] for n, i in ends]))
            for n, i in ends:
                starts[b - n].append((b, i))
        beta = [-math.inf] * len(text) + [0.0]
        for a in range(len(text) - 1, -1, -1):
            steps = [logp[i] + beta[b] for b, i in starts[a]]
            if steps and (top := max(steps)) > -math.inf:
                beta[a] = top + math.log(sum(math.exp(x - top) for x in steps))
                for (_, i), x in zip(starts[a], steps, strict=True):
                    total[i] += math.exp(alpha[a] + x - alpha[-1])

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected uses of each piece over the words' segmentations, weighted by their probabilities: forward and backward recursion in log space."""
        total = np.zeros(len(self.pieces))
        for _, rows in self._by_length(words):
            n, edges = rows.shape[1], self._edges(rows)
            alpha = self._forward(edges, len(rows), n)
            beta = np.full((n + 1, len(rows)), -np.inf)
            beta[n] = 0.0
            used: list[tuple[np.ndarray, np.ndarray]] = []
            for a in range(n - 1, -1, -1):
                for b in range(a + 1, min(n, a + self.longest) + 1):
                    if (a, b) in edges:
                        hit, ids = edges[a, b]
                        step = self.logp[ids] + beta[b, hit]
                        beta[a, hit] = np.logaddexp(beta[a, hit], step)
                        used.append((ids, np.exp(alpha[a, hit] + step - alpha[n, hit])))
            if used:
                ids, weights = (np.concatenate(x) for x in zip(*used, strict=True))
                total += np.bincount(ids, weights=weights, minlength=len(self.pieces))
        for w in words:
            if len(w) > WIDE:
                self._expected_long(w, total)
        return total


def normalised(pieces: list[bytes], weight: np.ndarray, stops: float) -> Lattice:
    """A lattice from weights: first pieces among themselves, the others together with the weight of a word's end."""
    first = np.array([p[:1] == b" " for p in pieces])
    logp = np.log(weight)
    logp[first] -= np.log(weight[first].sum())
    rest = weight[~first].sum() + stops
    logp[~first] -= np.log(rest)
    return Lattice(pieces, logp, float(np.log(stops / rest)))
