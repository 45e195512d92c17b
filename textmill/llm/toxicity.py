"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

The kernel is the gap-weighted subsequence kernel: two strings are alike if they share short subsequences, and
gaps inside these cost a factor for each character. So an insult with characters put between its letters stays
near the insult. A text's similarity to a landmark string is summed over its words; the landmarks, picked from the
training texts, stand for the whole kernel matrix (Nyström), and a linear SVM with squared hinge loss is trained on
the labelled texts in the space that they span. A logistic curve on its margin gives scores.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import held_out, slices

SUBSEQUENCE, DECAY = 3, 0.8
#: Similarities up to LOW count nothing and from HIGH on count as 1.
LOW, HIGH = 0.6, 0.9
LANDMARKS = 48
#: Bound of the training sample: texts of each label.
TRAIN_TEXTS = 1500
PENALTY = 1.0
#: Longer words are compared in overlapping windows of this many characters.
WINDOW = 48
CACHE_WORDS = 400_000
_OTHER = re.compile(r"[\W\d_]+")


def tokens_of(text: str) -> list[str]:
    """The text's tokens between white space, in lower case; four or more of one character each in a row, as in a word
    that is spelled out, are one token."""
    tokens = text.lower().split()
    single = bytes([len(t) == 1 for t in tokens])
    if b"\1\1\1\1" not in single:
        return tokens
    out, at = [], 0
    for run in re.finditer(b"\1{4,}", single):
        out += tokens[at : run.start()]
        out.append("".join(tokens[run.start() : run.end()]))
        at = run.end()
    return out + tokens[at:]


def word_of(token: str) -> str:
    """The letters of a token: characters put between or around them don't count."""
    return token if token.isalpha() else _OTHER.sub("", token)


def marked(word: str) -> str:
    return f"^{word}$"


def _codes(strings: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(strings), width), np.uint32)
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def subsequence_kernel(a: np.ndarray, b: np.ndarray, n: int = SUBSEQUENCE, decay: float = DECAY) -> np.ndarray:
    """The kernel of each pair of rows of a and b, code points padded with 0: the sum over common subsequences of n
    characters of decay to the power of both their spans."""
    rows, la, lb = len(a), a.shape[1], b.shape[1]
    match = [[(a[:, i] == b[:, j]) & (a[:, i] != 0) for j in range(lb)] for i in range(la)]
    prefix = np.ones((la + 1, lb + 1, rows), np.float32)
    total = np.zeros(rows, np.float32)
    for length in range(1, n + 1):
        grown = np.zeros((la + 1, lb + 1, rows), np.float32)
        for i in range(1, la + 1):
            run = np.zeros(rows, np.float32)
            for j in range(1, lb + 1):
                hit = match[i - 1][j - 1] * prefix[i - 1, j - 1] * np.float32(decay * decay)
                if length == n:
                    total += hit
                else:
                    run = decay * run + hit
                    grown[i, j] = decay * grown[i - 1, j] + run
        prefix = grown
    return total


@dataclass
class KernelModel:
    """Landmarks with their own kernels, the Nyström map, the SVM's weights, and the logistic curve."""

    landmarks: list[str]
    own: np.ndarray
    mapping: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    # -- similarities

    def similar(self, words: list[str]) -> dict[str, list[tuple[int, float]]]:
        """For each word that is like a landmark: the landmarks and how strongly each counts. Words are compared with
        ``^`` before and ``$`` behind them.

        A word that lacks more than one of a landmark's characters, counted as often as the landmark has them, counts
        nothing by definition; the kernel is worked out for the others only."""
        found: dict[str, list[tuple[int, float]]] = {}
        if not self.landmarks or not words:
            return found
        pieces, owner = [], []
        for i, w in enumerate(words):
            m = marked(w)
            for k in range(0, max(1, len(m) - WINDOW // 2), WINDOW // 2):
                pieces.append(m[k : k + WINDOW])
                owner.append(i)
        # A bit for each character that a piece has, and one for each that it has twice: so all but one of a
        # landmark's characters are quickly found or missed.
        alphabet = {c: k % 63 for k, c in enumerate(sorted({c for z in self.landmarks for c in z}))}
        table = np.zeros(0x110000, np.uint64)
        for c, k in alphabet.items():
            table[ord(c)] = np.uint64(1 << k)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes) - sizes
        flat = table[np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)]
        once = np.bitwise_or.reduceat(flat, starts)
        twice = np.zeros(len(pieces), np.uint64)
        for k in {alphabet[c] for z in self.landmarks for c, n in Counter(z).items() if n > 1}:
            bit = np.uint64(1 << k)
            twice[np.add.reduceat((flat == bit).astype(np.uint8), starts) > 1] |= bit
        best: dict[tuple[int, int], float] = {}
        for j, z in enumerate(self.landmarks):
            count = Counter(z)
            one = np.uint64(sum({1 << alphabet[c] for c in z}))
            two = np.uint64(sum({1 << alphabet[c] for c, n in count.items() if n > 1}))
            missing = np.bitwise_count(one & ~once) + np.bitwise_count(two & ~twice)
            near = np.flatnonzero((missing <= 1) & (sizes >= len(z) - 1))
            for lo in range(0, len(near), 4096):
                rows = near[lo : lo + 4096]
                order = np.argsort(sizes[rows])
                for part in np.array_split(rows[order], max(1, len(rows) // 512)):
                    a = _codes([pieces[r] for r in part], int(sizes[part].max()))
                    b = np.broadcast_to(_codes([z], len(z)), (len(part), len(z)))
                    value = np.clip((subsequence_kernel(a, b) / self.own[j] - LOW) / (HIGH - LOW), 0, 1)
                    for r in np.flatnonzero(value > 0):
                        key = (owner[part[r]], j)
                        best[key] = max(best.get(key, 0.0), float(value[r]))
        for (i, j), value in best.items():
            found.setdefault(words[i], []).append((j, value))
        return found

    def features(self, bags: list[list[str]], known: dict[str, list[tuple[int, float]] | None]) -> np.ndarray:
        """A row for each text: its logarithmic sums of similarities, in the landmarks' space, and their rate per word.

        bags: the tokens of each text; known: tokens and their similarities, which grows."""
        new = {t: word_of(t) for t in {t for ts in bags for t in ts}.difference(known)}
        found = self.similar(list({w for w in new.values() if w}))
        known.update((t, found.get(w)) for t, w in new.items())
        raw = np.zeros((len(bags), len(self.landmarks)))
        rate = np.zeros((len(bags), 2))
        for i, ws in enumerate(bags):
            for entry in filter(None, map(known.get, ws)):
                for j, value in entry:
                    raw[i, j] += value
            hits = raw[i].sum()
            rate[i] = hits / np.sqrt(len(ws) + 1), np.log1p(len(ws)) / 10
        return np.hstack([np.log1p(raw) @ self.mapping, rate])

    def score(self, bags: list[list[str]], known: dict) -> np.ndarray:
        margin = np.hstack([self.features(bags, known), np.ones((len(bags), 1))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))

    # -- training

    @classmethod
    def fit(cls, texts: list[str], toxic: list[int]) -> KernelModel:
        """A model of the texts whose label is 1. Without texts of both labels it scores every text alike."""
        labels = np.array(toxic, np.int64)
        share = float(labels.mean()) if len(labels) else 0.0
        if len(set(toxic)) < 2:
            flat = np.log((share + 1e-3) / (1 - share + 1e-3))
            return cls([], np.zeros(0), np.zeros((0, 0)), np.zeros(3), 0.0, flat)
        bags = [tokens_of(t) for t in texts]
        landmarks = pick_landmarks([[word_of(t) for t in ts] for ts in bags], labels)
        width = max(map(len, landmarks), default=1)
        z = _codes(landmarks, width)
        own = subsequence_kernel(z, z)
        m = len(landmarks)
        cross = subsequence_kernel(np.repeat(z, m, 0), np.tile(z, (m, 1))).reshape(m, m) / np.sqrt(np.outer(own, own))
        values, vectors = np.linalg.eigh(cross)
        mapping = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
        model = cls(landmarks, own, mapping, np.zeros(m + 3), 1.0, 0.0)
        x = np.hstack([model.features(bags, {}), np.ones((len(bags), 1))])
        model.weights = _svm(x, 2.0 * labels - 1)
        model.slope, model.offset = _logistic(x @ model.weights, labels)
        return model


def pick_landmarks(bags: list[list[str]], labels: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Word beginnings and whole words that tell the labels apart best, by the log-likelihood ratio of the numbers of
    texts that have them; one that occurs in nearly the same texts as a better one that it contains, or that
    contains it, is left out."""
    having: dict[str, set[int]] = {}
    for i in np.flatnonzero(labels == 1).tolist():
        for w in set(bags[i]):
            if len(w) >= 4:
                m = marked(w)
                for k in {*range(5, min(len(m), 11)), len(m)}:
                    if k <= 16:
                        having.setdefault(m[:k], set()).add(i)
    pos = int((labels == 1).sum())
    neg = len(labels) - pos
    least = max(3, pos // 250)
    having = {s: texts for s, texts in having.items() if len(texts) >= least}
    other: Counter[str] = Counter()
    for i in np.flatnonzero(labels == 0).tolist():
        other.update({m[:k] for w in set(bags[i]) if len(w) >= 4 for m in [marked(w)] for k in {*range(5, min(len(m), 11)), len(m)} if m[:k] in having})

    def ratio(s: str) -> float:
        a, b = len(having[s]), other[s]
        p, q, r = (a + 0.5) / (pos + 1), (b + 0.5) / (neg + 1), (a + b + 1) / (pos + neg + 2)
        if p < 3 * q:
            return 0.0
        gain = lambda k, n, x: k * np.log(x) + (n - k) * np.log(1 - x)
        return gain(a, pos, p) + gain(b, neg, q) - gain(a, pos, r) - gain(b, neg, r)

    scores = {s: v for s in having if (v := ratio(s)) > 6}
    chosen: list[str] = []
    for s in sorted(scores, key=lambda s: (-scores[s], -len(s), s)):
        if len(chosen) == most:
            break
        if not any((s in c or c in s) and len(having[s] ^ having[c]) < 0.2 * len(having[s] | having[c]) for c in chosen):
            chosen.append(s)
    return chosen


def _svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A linear SVM with squared hinge loss, both labels weighted alike, by Newton steps; the last column is the bias."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    ridge = np.full(x.shape[1], PENALTY)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, ya, ca = x[active], y[active], weight[active]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + np.diag(ridge), (xa * ca[:, None]).T @ ya)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _logistic(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of the label, by ridge-stabilised Newton steps."""
    x = np.stack([margin, np.ones(len(margin))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (labels - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def training_sample(docs: DataFrame, labels: DataFrame, texts: int = TRAIN_TEXTS) -> DataFrame:
    """At most ``texts`` rows (text, toxic) of each label that may be learned from: those with the least hash of
    doc_id. A document labelled twice counts as toxic if one of its labels says so.

    Ids are drawn from labels alone, four times as many as wanted; that bounded list is broadcast, so no text moves
    but those of the sample."""
    marks = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.withColumn("_h", F.xxhash64("doc_id"))
    drawn = [marks.filter(F.col("toxic") == y).orderBy("_h", "doc_id").limit(4 * texts) for y in (0, 1)]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(ids, "doc_id")
    each = [rows.filter(F.col("toxic") == y).orderBy("_h", "text").limit(texts) for y in (0, 1)]
    return each[0].unionByName(each[1]).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, texts: int = TRAIN_TEXTS) -> KernelModel:
    """A model from a bounded sample of the labelled rows, held-out rows excepted."""
    sample = sorted((r.text, r.toxic) for r in training_sample(docs, labels, texts).collect())
    return KernelModel.fit([t for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, model: KernelModel) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from a score of 0.5) of each row of docs, from its text alone.

    A null text counts as empty; empty texts get the score of a text without words. Rows are independent: repeats
    give repeated results, other columns are ignored, an empty table gives an empty result, and long texts are
    scored whole. A null doc_id is not held out.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    shared = rows.sparkSession.sparkContext.broadcast(model)  # LANDMARKS strings and a matrix over them

    def run(batches):
        fitted = shared.value
        known: dict = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for start, stop in slices(texts):
                if len(known) > CACHE_WORDS:
                    known.clear()
                value = fitted.score([tokens_of(t) for t in texts[start:stop]], known)
                n = stop - start
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, model: KernelModel) -> DataFrame:
    """The rows of docs with a score below 0.5, with all their columns; nothing is joined or moved."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known: dict = {}
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for start, stop in slices(texts):
                if len(known) > CACHE_WORDS:
                    known.clear()
                value = shared.value.score([tokens_of(t) for t in texts[start:stop]], known)
                yield batch.slice(start, stop - start).filter(pa.array(value < 0.5))

    return docs.mapInArrow(run, docs.schema)
