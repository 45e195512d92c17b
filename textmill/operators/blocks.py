"""Texts that look their words up: blocks of documents meet what is known of the words that they have.

A row for each word of each document is never moved. Documents are dealt into blocks, a block says once which words it has
and how often, what the corpus knows of a word goes back to the blocks that have it, and each block is worked on with the
values of its own words. A block is bounded in documents, whatever their number."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import TOKEN
from textmill.operators.lineage import stored

#: Documents of a block.
BLOCK = 2_000
#: Words of lower-cased texts, as ``alnum_tokens`` and ``tokenize`` find them.
ALNUM, TOKENS = re.compile("[a-z0-9]+"), re.compile(TOKEN, re.ASCII)


def dealt(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str, block: int | None = None) -> DataFrame:
    """(_b, key, _text, more) of documents in blocks, texts in lower case. Rows of one key lie in one block, those without a key in
    one of their own."""
    blocks = max(1, -(-docs.count() // (block or BLOCK)))
    at = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(blocks))).cast("int")
    return docs.select(at.alias("_b"), key, F.lower(text).alias("_text"), *more)


def _texts(frame: pd.DataFrame, key: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """The rows of each key, one after the other."""
    for k, rows in frame.groupby(key, sort=False, dropna=False):
        yield None if pd.isna(k) else k, rows


def _words(rows: pd.DataFrame, pattern: re.Pattern) -> Counter:
    found = Counter()
    for text in rows["_text"]:
        found.update(pattern.findall(text) if text else ())
    return found


def counted(blocks: DataFrame, key: str, pattern: re.Pattern, per: Callable[[Counter, pd.DataFrame], dict[str, Counter]], names: list[str]) -> DataFrame:
    """(_b, term, names): for each word of a block the sums, over its documents, of what per(words, rows) gives under each name."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        terms, sums = set(), {n: Counter() for n in names}
        for _, rows in _texts(frame, key):
            words = _words(rows, pattern)
            terms.update(words)
            for name, n in per(words, rows).items():
                sums[name].update(n)
        own = sorted(terms)
        return pd.DataFrame({"_b": np.full(len(own), frame["_b"].iloc[0] if len(frame) else 0, np.int32), "term": own, **{n: np.array([sums[n][t] for t in own], np.int64) for n in names}})

    return blocks.groupBy("_b").applyInPandas(run, "_b int, term string" + "".join(f", {n} long" for n in names))


def looked_up(blocks: DataFrame, known: DataFrame, work: Callable[[pd.DataFrame, dict], pd.DataFrame], values: list[str], schema: str) -> DataFrame:
    """What work(rows, values by word) makes of each block; known: (_b, term, values)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = zip(*(right[v] for v in values), strict=True) if len(values) > 1 else right[values[0]]
        return work(left, dict(zip(right["term"], rows, strict=True)))

    return blocks.groupBy("_b").cogroup(known.select("_b", "term", *values).groupBy("_b")).applyInPandas(run, schema)


def document_terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(blocks, counts): documents in blocks, and (_b, term, n): the documents of each block that have an alphanumeric word."""
    blocks = dealt(docs, key, text)
    return blocks, stored(counted(blocks, key, ALNUM, lambda words, rows: {"n": Counter(words.keys())}, ["n"]))


def tfidf(blocks: DataFrame, counts: DataFrame, idf: DataFrame, key: str = "doc_id", wanted: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, w) as ``terms.tfidf`` gives them of the table of alphanumeric words; with wanted (term) of these terms only,
    by the norms of the whole documents. blocks, counts: ``document_terms``; idf: ``inverse``."""
    kind = blocks.schema[key].dataType.simpleString()
    marked = idf.withColumn("asked", F.lit(True)) if wanted is None else idf.join(wanted.select("term", F.lit(True).alias("asked")), "term", "left").fillna(False, ["asked"])
    known = counts.select("_b", "term").join(marked, "term")

    def work(frame: pd.DataFrame, values: dict) -> pd.DataFrame:
        ids, sizes, terms, tfs, ws = [], [], [], [], []
        for k, rows in _texts(frame, key):
            words = _words(rows, ALNUM)
            if not words:
                continue
            own = [values[t] for t in words]
            tf = np.fromiter(words.values(), np.int64, len(words))
            x = tf * np.fromiter((v for v, _ in own), float, len(words))
            keep = np.fromiter((a for _, a in own), bool, len(words))
            ids.append(k)
            sizes.append(int(keep.sum()))
            terms += [t for t, (_, a) in zip(words, own, strict=True) if a]
            tfs.append(tf[keep])
            ws.append(x[keep] / np.sqrt((x * x).sum()))
        if not ids:
            return pd.DataFrame({key: [], "term": [], "tf": [], "w": []})
        return pd.DataFrame({key: pd.Series(ids, dtype=frame[key].dtype).repeat(sizes).to_numpy(), "term": terms, "tf": np.concatenate(tfs), "w": np.concatenate(ws)})

    return looked_up(blocks, known, work, ["idf", "asked"], f"{key} {kind}, term string, tf long, w double")


def inverse(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, idf) from the documents of each block that have a term, (_b, term, n)."""
    df = counts.groupBy("term").agg(F.sum("n").alias("df"))
    n = n_docs.select(F.col("n").alias("_n"))
    return df.join(F.broadcast(n)).select("term", (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))


def class_sums(docs: DataFrame, classes: list, alpha: float, key: str = "doc_id", text: str = "text", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(sums, totals) of a multinomial model over alphanumeric words. totals: one row of the words, _v, and places, _t0 and on, of the
    classes; sums: (key, _len, _s0 and on) of each document with a word, the sums of its words' gains in each class."""
    kind = docs.schema[key].dataType.simpleString()
    blocks = dealt(docs, key, text, label)
    at, names = {c: f"_c{i}" for i, c in enumerate(classes)}, [f"_c{i}" for i in range(len(classes))]

    def per(words: Counter, rows: pd.DataFrame) -> dict[str, Counter]:
        found: dict[str, Counter] = {}
        for c in rows[label]:
            if c in at:
                found.setdefault(at[c], Counter()).update(words)
        return found

    counts = stored(counted(blocks, key, ALNUM, per, names))
    every = counts.groupBy("term").agg(*(F.sum(c).alias(c) for c in names)).filter(" + ".join(names) + " > 0")
    totals = every.agg(F.count(F.lit(1)).alias("_v"), *(F.sum(c).alias(f"_t{i}") for i, c in enumerate(names)))
    gains = every.select("term", *(F.ln((F.col(c) + alpha) / alpha).alias(f"_g{i}") for i, c in enumerate(names)), F.lit(0).alias("_none"))
    known = counts.select("_b", "term").join(gains, "term")
    values = [f"_g{i}" for i in range(len(names))] + ["_none"]

    def work(frame: pd.DataFrame, values_: dict) -> pd.DataFrame:
        none, out = (0.0,) * len(values), []
        for k, rows in _texts(frame, key):
            words = _words(rows, ALNUM)
            if words:
                tf = np.fromiter(words.values(), float, len(words))
                out.append((k, int(tf.sum()), *(tf @ np.array([values_.get(t, none) for t in words], float))[:-1]))
        return pd.DataFrame(out, columns=[key, "_len", *(f"_s{i}" for i in range(len(names)))])

    schema = f"{key} {kind}, _len long" + "".join(f", _s{i} double" for i in range(len(names)))
    return looked_up(blocks, known, work, values, schema), totals


def encoded(docs: DataFrame, vocab: Callable[[DataFrame], DataFrame], drop_unknown: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, ids_md5) of each document with a token that counts: how many ids, and the MD5 of these in order, in decimal with spaces
    between. vocab: (term, n) of all tokens -> (term, id). Unknown tokens are 0, or go if drop_unknown."""
    kind = docs.schema[key].dataType.simpleString()
    blocks = dealt(docs, key, text)
    counts = stored(counted(blocks, key, TOKENS, lambda words, rows: {"n": words}, ["n"]))
    known = counts.select("_b", "term").join(vocab(counts.groupBy("term").agg(F.sum("n").alias("n"))).select("term", "id"), "term")

    def work(frame: pd.DataFrame, ids: dict) -> pd.DataFrame:
        out = []
        for k, rows in _texts(frame, key):
            found = [[(p, ids.get(t, 0)) for p, t in enumerate(TOKENS.findall(x)) if not drop_unknown or t in ids] for x in rows["_text"] if x]
            places = found[0] if len(found) == 1 else sorted(sum(found, []))
            if places:
                out.append((k, len(places), hashlib.md5(" ".join(str(i) for _, i in places).encode()).hexdigest()))
        return pd.DataFrame(out, columns=[key, "n", "ids_md5"])

    return looked_up(blocks, known, work, ["id"], f"{key} {kind}, n long, ids_md5 string")
