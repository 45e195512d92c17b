"""Retrieval over chunks of several sizes at once: recall and reciprocal rank for each size and number of passages.

One pass over the documents finds tokens and sentences once and gives, for every size, the chunks with their counts of
terms: a chunk's tokens are a stretch of the document's, found by their places. All sizes are then ranked together, with
statistics of their own. ``best_chunks`` does the same in blocks of documents, where no row for each term of each chunk is made."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators.lineage import stored
from textmill.operators.retrieval import chunk_words, pieces, sentence_chunks, words_and_sentences

_TOKEN = re.compile("[a-z0-9]+")
#: Documents of a block at most, and their characters, on average; chunks and queries that are scored at once.
BLOCK, CHARS, RANKED, ASKED = 2_000, 8_000_000, 1_000, 256


def _lower(body: str) -> str:
    """body in lower case; the few letters that would change their length stay."""
    lower = body.lower()
    return lower if len(lower) == len(body) else "".join(c.lower() if len(c.lower()) == 1 else c for c in body)


def chunk_terms(docs: DataFrame, sizes: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(size, key, no, start, stop, length, term, tf) of the chunks of each size, an eighth of it overlapping; length in tokens.
    A chunk without a token has one row with a null term."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames):
        for frame in pieces(frames, text, 100_000):
            rows = []
            for doc, body in zip(frame[key], frame[text], strict=True):
                tokens = [(m.start(), m.group()) for m in _TOKEN.finditer(_lower(body or ""))]
                starts = [at for at, _ in tokens]
                for size in sizes:
                    for no, (a, z, _) in enumerate(sentence_chunks(body or "", size, size // 8)):
                        found = Counter(t for _, t in tokens[bisect_left(starts, a) : bisect_left(starts, z)])
                        length = sum(found.values())
                        rows += [(size, doc, no, a, z, length, t, n) for t, n in found.items()] or [(size, doc, no, a, z, 0, None, 0)]
            yield pd.DataFrame(rows, columns=["size", key, "no", "start", "stop", "length", "term", "tf"])

    return docs.select(key, text).mapInPandas(run, f"size int, {key} {kind}, no int, start int, stop int, length int, term string, tf int")


def ranked_chunks(chunks: DataFrame, queries: DataFrame, most: int, key: str = "doc_id", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(size, query_id, key, no, start, stop, rank): the best ``most`` chunks of each size for each query by BM25 with the
    statistics of that size. queries: (query_id, term), each term once."""
    one = chunks.groupBy("size", key, "no").agg(F.first("length").alias("length"))
    totals = one.groupBy("size").agg(F.count(F.lit(1)).alias("_n"), F.avg("length").alias("_avg"))
    hits = chunks.filter("term IS NOT NULL").join(queries.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("size", "term").agg(F.count(F.lit(1)).alias("_df"))
    weight = F.ln((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("_avg")))
    weighted = hits.join(df, ["size", "term"]).join(F.broadcast(totals), "size").withColumn("_w", weight)
    scored = queries.join(weighted, "term").groupBy("size", "query_id", key, "no").agg(F.round(F.sum("_w"), 6).alias("score"), F.first("start").alias("start"), F.first("stop").alias("stop"))
    return _first(scored, most, key)


def _first(scored: DataFrame, most: int, key: str) -> DataFrame:
    order = Window.partitionBy("size", "query_id").orderBy(F.desc("score"), key, "no")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _chunked(texts: pa.ChunkedArray, sizes: list[int], at: dict[str, int]) -> list[dict[str, np.ndarray]]:
    """For each size its chunks (row, no, start, stop, length), and (chunk, term, tf) of the terms that at numbers."""
    base, places, ids = 0, [], []
    spans: list[list] = [[] for _ in sizes]
    for row, body in enumerate(texts):
        body = body.as_py() or ""
        for m in _TOKEN.finditer(_lower(body)):
            places.append(base + m.start())
            ids.append(at.get(m.group(), -1))
        words, firsts = words_and_sentences(body)
        for size, own in zip(sizes, spans, strict=True):
            own += [(row, no, words[a][0], words[z - 1][1], base) for no, (a, z) in enumerate(chunk_words(firsts, size, size // 8))]
        base += len(body) + 1
    places, ids, out = np.array(places, np.int64), np.array(ids, np.int64), []
    wanted = np.flatnonzero(ids >= 0)
    for own in spans:
        row, no, start, stop, begin = np.array(own, np.int64).reshape(-1, 5).T
        low, high = np.searchsorted(places, start + begin), np.searchsorted(places, stop + begin)
        first, last = np.searchsorted(wanted, low), np.searchsorted(wanted, high)
        n = last - first
        chunk = np.repeat(np.arange(len(row)), n)
        term = ids[wanted[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]]
        found, tf = np.unique(chunk * max(len(at), 1) + term, return_counts=True)
        chunk, term = np.divmod(found, max(len(at), 1))
        out.append({"row": row, "no": no, "start": start, "stop": stop, "length": high - low, "chunk": chunk, "term": term, "tf": tf})
    return out


def best_chunks(docs: DataFrame, sizes: list[int], queries: DataFrame, most: int, key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``ranked_chunks`` of ``chunk_terms``: (size, query_id, key, no, start, stop, score, rank). Rows that repeat a key stand alone.

    Blocks of documents meet the terms of all queries, count them, and in a second pass over the texts score their chunks: a block
    keeps its own best, and those that could tie with the last in six places."""
    slack = 2e-6
    n, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-chars // CHARS))
    dealt = docs.select(key, text, F.pmod(F.xxhash64(key), F.lit(blocks).cast("long")).alias("_b"))
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), key: docs.schema[key].dataType.simpleString()}

    def met(rows: DataFrame, work, schema: str) -> DataFrame:
        every = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return every.groupBy("_b").cogroup(dealt.groupBy("_b")).applyInArrow(work, schema)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        names = left["term"].to_pylist()
        out = []
        for size, own in zip(sizes, _chunked(right[text], sizes, {t: i for i, t in enumerate(names)}), strict=True):
            df = np.bincount(own["term"], minlength=len(names))
            out += [(size, None, len(own["row"]), int(own["length"].sum())), *((size, t, int(d), 0) for t, d in zip(names, df, strict=True) if d)]
        return pa.table(dict(zip(counted.names, zip(*out, strict=True), strict=True)), counted)

    counted = pa.schema([("size", pa.int32()), ("term", pa.string()), ("n", pa.int64()), ("length", pa.int64())])
    asked = stored(queries.select("query_id", "term").filter("term IS NOT NULL").distinct())
    found = stored(met(asked.select("term").distinct(), count, "size int, term string, n long, length long").groupBy("size", "term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")))
    totals = found.filter("term IS NULL").select("size", F.col("n").alias("_n"), F.try_divide("length", "n").alias("mean"))
    idf = F.ln((F.col("_n") - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1)
    known = found.filter("term IS NOT NULL").join(F.broadcast(totals), "size").select("size", "term", idf.alias("idf"), "mean")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        asking = left["query_id"].combine_chunks().dictionary_encode("encode")
        term, query, size_of = left["term"].combine_chunks().dictionary_encode(), asking.indices.to_numpy(), left["size"].to_numpy()
        term_of, idf, mean, names = term.indices.to_numpy(), left["idf"].to_numpy(), left["mean"].to_numpy(), term.dictionary.to_pylist()
        parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 6 + [np.zeros(0)]]
        for size, own in zip(sizes, _chunked(right[text], sizes, {t: i for i, t in enumerate(names)}) if names else (), strict=False):
            mine = np.flatnonzero(size_of == size)
            if not len(mine) or not len(own["chunk"]):
                continue
            norm = k1 * (1 - b + b * own["length"] / mean[mine[0]])[own["chunk"]]
            weight = own["tf"] * (k1 + 1) / (own["tf"] + norm)
            edges = np.searchsorted(own["chunk"], np.arange(0, len(own["row"]) + RANKED, RANKED))
            for low in range(0, len(asking.dictionary), ASKED):
                few = mine[(query[mine] >= low) & (query[mine] < low + ASKED)]
                table = np.zeros((len(names), min(ASKED, len(asking.dictionary) - low)))
                table[term_of[few], query[few] - low] = idf[few]
                scores = np.zeros((table.shape[1], len(own["row"])))
                for no, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows = np.zeros((min(RANKED, len(own["row"]) - no * RANKED), len(names)))
                    rows[own["chunk"][x:y] - no * RANKED, own["term"][x:y]] = weight[x:y]
                    scores[:, no * RANKED : no * RANKED + len(rows)] = (rows @ table).T
                last = max(0, scores.shape[1] - most)
                least = np.partition(scores, last, axis=1)[:, last]
                q, at = np.nonzero((scores > 0) & (scores >= (least - slack)[:, None]))
                parts.append([np.full(len(q), size), q + low, *(own[c][at] for c in ("row", "no", "start", "stop")), scores[q, at]])
        size, q, row, no, start, stop, got = (np.concatenate(x) for x in zip(*parts, strict=True))
        small = {"no": no, "start": start, "stop": stop}
        return pa.table({"size": size.astype(np.int32), "query_id": asking.dictionary.take(pa.array(q)), key: right[key].take(pa.array(row)), **{c: v.astype(np.int32) for c, v in small.items()}, "score": got})

    scored = met(asked.join(known, "term"), score, f"size int, query_id {kinds['query_id']}, {key} {kinds[key]}, no int, start int, stop int, score double")
    return _first(scored.withColumn("score", F.round("score", 6)), most, key)


def sweep(ranked: DataFrame, evidence: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """(size, k, questions, recall, mrr) for k from 1 to ``most``: the mean share of a question's evidence groups that its first k
    chunks cover, and the mean reciprocal rank of the first that covers any. evidence: (query_id, group, key, start, stop); any
    span of a group will do, and a chunk covers a span if at least half of it lies in the chunk. Questions without evidence
    don't count."""
    spans = evidence.withColumnsRenamed({"start": "_a", "stop": "_z"})
    shared = F.least("stop", "_z") - F.greatest("start", "_a")
    hits = ranked.join(spans, ["query_id", key]).filter(2 * shared >= F.col("_z") - F.col("_a"))
    groups = evidence.select("query_id", "group").distinct()
    sizes = ranked.select("size").distinct()
    best = groups.crossJoin(F.broadcast(sizes)).join(hits.groupBy("size", "query_id", "group").agg(F.min("rank").alias("_rank")), ["size", "query_id", "group"], "left")
    each = best.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most))))
    within = F.col("_rank") <= F.col("k")
    asked = each.groupBy("size", "k", "query_id").agg(F.avg(F.when(within, 1.0).otherwise(0.0)).alias("r"), F.coalesce(F.max(F.when(within, 1.0 / F.col("_rank"))), F.lit(0.0)).alias("m"))
    return asked.groupBy("size", "k").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg("m"), 6).alias("mrr"))
