"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed character n-grams, L2-normalised. Each language has several centroids, from
spherical k-means over its training vectors; a text gets the language of the nearest centroid by cosine, and is
rejected if that centroid is farther than nearly all of its own training texts were.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.llm.common import held_out, slices

DIMENSIONS = 1 << 13
LENGTHS = (1, 2, 3)
CENTROIDS = 4
ROUNDS = 12
#: Bound of the training sample: texts in all, shared out evenly to the languages, or so many for each if those are more.
TRAIN_TEXTS, TRAIN_LEAST = 2400, 20
#: A text nearer than this share of a centroid's own training texts is not rejected.
REJECT_QUANTILE = 0.01
SHARPNESS = 20.0
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """True for each code point that is a letter."""
    if not _LETTER:
        _LETTER.append(np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)]))
    return _LETTER[0]


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of hashed n-gram counts for each text, and its number of letters.

    Letters are lower-cased; any run of other characters is one blank."""
    is_letter = letters()
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    n_letters = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, text in enumerate(texts):
        code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(is_letter[code], code, 0)
        n_letters[i] = np.count_nonzero(code)
        code = code[(code != 0) | np.concatenate([[True], code[:-1] != 0])]
        parts.append(code)
        owner.append(len(code))
    flat = np.concatenate(parts).astype(np.uint64) if parts else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(texts)), owner)
    rolled = np.zeros(len(flat), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        rolled = rolled[: len(flat) - n + 1] * np.uint64(0x100000001B3) + flat[n - 1 :] + np.uint64(n)
        if n in LENGTHS:
            inside = row[: len(rolled)] == row[n - 1 :]
            mixed = rolled[inside] * np.uint64(0x9E3779B97F4A7C15)
            slot = (mixed >> np.uint64(64 - 13)).astype(np.int64) + row[: len(rolled)][inside] * DIMENSIONS
            out += np.bincount(slot, minlength=out.size).reshape(out.shape).astype(np.float32)
    return out, n_letters


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class CentroidModel:
    """Centroids (a row each), their languages, the least cosine each accepts, and the idf weights."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> CentroidModel:
        rows = [counts(texts[a:b])[0] for a, b in slices(texts, 1_000_000)]
        tf = np.concatenate(rows) if rows else np.zeros((0, DIMENSIONS), np.float32)
        idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
        vectors = _unit(np.log1p(tf) * idf)
        names = sorted(set(langs))
        label = np.array([names.index(x) for x in langs], np.int64)
        owner, centroids, least = [], [], []
        for k in range(len(names)):
            own = vectors[label == k]
            centres = _spherical(own, min(CENTROIDS, len(own)))
            cosine = own @ centres.T
            nearest = cosine.argmax(1)
            for c in range(len(centres)):
                members = cosine[nearest == c, c]
                owner.append(k)
                centroids.append(centres[c])
                least.append(np.quantile(members, REJECT_QUANTILE) if len(members) else 1.0)
        size = (len(owner), DIMENSIONS)
        return cls(names, np.array(owner, np.int64), np.array(centroids, np.float32).reshape(size), np.array(least), idf)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cosine to the nearest centroid, and whether that is too far."""
        tf, n_letters = counts(texts)
        if not self.languages:
            zero = np.zeros(len(texts))
            return [UNKNOWN] * len(texts), zero, zero, np.ones(len(texts), bool)
        cosine = _unit(np.log1p(tf) * self.idf) @ self.centroids.T
        by_lang = np.stack([cosine[:, self.owner == k].max(1) for k in range(len(self.languages))], 1)
        best = by_lang.argmax(1)
        weight = np.exp(SHARPNESS * (by_lang - by_lang.max(1, keepdims=True)))
        score = weight.max(1) / weight.sum(1)
        near = cosine.argmax(1)
        top = cosine[np.arange(len(texts)), near]
        blank = n_letters == 0
        names = [UNKNOWN if b else self.languages[k] for k, b in zip(best.tolist(), blank.tolist(), strict=True)]
        return names, np.where(blank, 0.0, score), np.where(blank, 0.0, top), blank | (top < self.least[near])


def _spherical(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; the same for the same rows."""
    seeds = [int((rows @ _unit(rows.mean(0, keepdims=True))[0]).argmax())] if k else []
    nearest = rows @ rows[seeds[0]] if k else None
    while len(seeds) < k:
        seeds.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[seeds[-1]])
    centres = rows[seeds]
    for _ in range(ROUNDS):
        own = (rows @ centres.T).argmax(1)
        centres = _unit(np.stack([rows[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])) if k else centres
    return centres


def training_sample(docs: DataFrame, texts: int = TRAIN_TEXTS, least: int = TRAIN_LEAST) -> DataFrame:
    """Rows (text, lang) that may be learned from, spread evenly over all languages by a hash of doc_id and text: ``texts`` in
    all, or ``least`` of each language if those are more. Rare languages give all they have; only a thin slice of a frequent
    one is ranked. Every language is learned; a model holds up to four centroids of 32 KB for each."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "text", "lang", F.xxhash64("doc_id", F.xxhash64("text")).alias("_h")
    )
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    each = max(least, texts // max(1, len(sizes)))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2.0 * each / n)))) if sizes else F.create_map().cast("map<string,double>")
    slot = F.pmod("_h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    thin = rows.filter(slot < F.element_at(share, F.col("lang")))  # about twice as many as wanted; only these move
    ranked = thin.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text")))
    return ranked.filter(F.col("_r") <= each).select("text", "lang")


def fit(docs: DataFrame, texts: int = TRAIN_TEXTS) -> CentroidModel:
    """A model from a bounded sample of the rows with a language, held-out rows excepted."""
    sample = sorted((r.text, r.lang) for r in training_sample(docs, texts).collect())
    return CentroidModel.fit([t for t, _ in sample], [x for _, x in sample])


def identify(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cosine, rejected of each row of docs, from its text alone.

    A null text, or one without letters, is ``und`` with score 0 and rejected; so is every text under a model that
    learned no language. score is the softmax weight of the nearest language; rejected tells that the text is
    farther from its nearest centroid than 99 % of that centroid's own training texts. Rows are independent:
    repeats give repeated results, other columns are ignored, an empty table gives an empty result, and long texts
    are read whole. A null doc_id is not held out.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, cosine double, rejected boolean"
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few centroids per language

    def run(batches):
        fitted = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for start, stop in slices(texts, 1_500_000):
                for a in range(start, stop, 1000):
                    b = min(a + 1000, stop)
                    names, score, cosine, rejected = fitted.predict(texts[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(names, pa.string()), pa.array(score, pa.float64()),
                         pa.array(cosine, pa.float64()), pa.array(rejected, pa.bool_())],
                        ["doc_id", "held_out", "lang_pred", "score", "cosine", "rejected"],
                    )

    return rows.mapInArrow(run, schema)
