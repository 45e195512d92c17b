"""Operators of embedding tables (key, embedding)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions import arrays as A


#: Queries and rows that meet in one group, and of these the ones whose cosines are in memory at once.
QUERIES, ROWS, TILE = 10_000, 50_000, (256, 4096)


def knn(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", blocks: int | None = None) -> DataFrame:
    """(query, key, sim, rank): the k nearest rows of each query by cosine, itself left out, ties to the smaller key.

    A stated query set against all rows: chunks of queries meet blocks of rows, both bounded, and of such a pair only the k
    best rows of a query leave the task. The cosine is null where a vector is, holds a null or is of another length, and such rows
    come last; with a vector of zeros it is NaN, and such rows come first, as in SQL."""
    context = rows.sparkSession.sparkContext
    whole = F.when(~F.exists("_v", lambda x: x.isNull()), F.col("_v"))
    part = lambda df, name: df.filter(F.col(key).isNotNull()).select(F.col(key).alias(name), A.doubles(F.col(vector)).alias("_v")).select(name, whole.alias("_v"))
    q, r = part(queries, "query"), part(rows, "item")
    chunks = max(1, -(-q.count() // QUERIES))
    blocks = blocks or max(2 * context.defaultParallelism // chunks, -(-r.count() // ROWS), 1)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumns({"_q": deal("query", chunks), "_b": every(blocks)})
    right = r.withColumns({"_b": deal("item", blocks), "_q": every(chunks)})
    kinds = q.schema["query"].dataType.simpleString(), r.schema["item"].dataType.simpleString()

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, items, out = left["query"].to_numpy(), right["item"].to_numpy(), []
        tiles = [(items[b : b + TILE[1]], _units(right["_v"].iloc[b : b + TILE[1]])) for b in range(0, len(right), TILE[1])]
        for a in range(0, len(left), TILE[0]):
            own, asked = names[a : a + TILE[0]], _units(left["_v"].iloc[a : a + TILE[0]])
            found = [_nearest(own, at, _cosines(len(own), asked, len(at), held), k) for at, held in tiles]
            if found:
                out.append(_first(own, *map(np.concatenate, zip(*found, strict=True)), k))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "item": [], "sim": [], "kind": []})

    near = left.groupBy("_q", "_b").cogroup(right.groupBy("_q", "_b")).applyInPandas(meet, f"query {kinds[0]}, item {kinds[1]}, sim double, kind int")
    scored = near.select("query", "item", F.when(F.col("kind") == 0, F.col("sim")).when(F.col("kind") == 1, F.lit(float("nan"))).alias("sim"))
    order = Window.partitionBy("query").orderBy(F.desc("sim"), "item")
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select("query", F.col("item").alias(key), "sim", "rank")


def _units(column: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors that are not null, and their unit vectors."""
    lengths = np.array([-1 if v is None else len(v) for v in column])
    found = {}
    for n in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == n)
        x = np.array([column.iloc[i] for i in at], float).reshape(len(at), n)
        with np.errstate(invalid="ignore", divide="ignore"):
            found[int(n)] = at, x / np.sqrt((x * x).sum(1, keepdims=True))
    return found


def _cosines(n: int, asked: dict, m: int, held: dict) -> np.ndarray:
    """(n, m) cosines, those that are not a number as inf and nulls as -inf."""
    sim = np.full((n, m), -np.inf)
    for size in asked.keys() & held.keys():
        (i, x), (j, y) = asked[size], held[size]
        with np.errstate(invalid="ignore"):
            own = x @ y.T
        sim[np.ix_(i, j)] = np.where(np.isnan(own), np.inf, own)
    return sim


def _nearest(own: np.ndarray, items: np.ndarray, sim: np.ndarray, k: int) -> tuple:
    """(place of the query, item, cosine) of rows among which the k best of each query are, by the cosine as it is rounded."""
    sim[own[:, None] == items[None, :]] = -np.inf
    least = np.partition(sim, -k, axis=1)[:, -k] if sim.shape[1] > k else np.full(len(sim), -np.inf)
    at, row = np.nonzero(sim >= (least - 1e-6)[:, None])
    other = own[at] != items[row]
    at, row = at[other], row[other]
    return _cut(at, items[row], np.round(sim[at, row], 6), k)


def _cut(at: np.ndarray, items: np.ndarray, sim: np.ndarray, k: int) -> tuple:
    order = np.lexsort((items, -sim, at))
    at, items, sim = at[order], items[order], sim[order]
    starts = np.searchsorted(at, at)  # at is sorted: the first place of each query
    keep = np.arange(len(at)) - starts < k
    return at[keep], items[keep], sim[keep]


def _first(own: np.ndarray, at: np.ndarray, items: np.ndarray, sim: np.ndarray, k: int) -> pd.DataFrame:
    at, items, sim = _cut(at, items, sim, k)
    return pd.DataFrame({"query": own[at], "item": items, "sim": np.where(np.isinf(sim), 0.0, sim), "kind": np.where(sim == np.inf, 1, np.where(sim == -np.inf, -1, 0)).astype(np.int32)})


def mean_vectors(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, dim, mean)"""
    parts = df.select(by, F.posexplode(A.doubles(F.col(vector))).alias("dim", "x"))
    return parts.groupBy(by, "dim").agg(F.avg("x").alias("mean"))


def radius_of_gyration(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, rg): root mean square distance to the centroid, from sums of components and of squares."""
    parts = df.select(by, F.posexplode(A.doubles(F.col(vector))).alias("dim", "x"))
    dims = parts.groupBy(by, "dim").agg((F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x")).alias("_var"))
    return dims.groupBy(by).agg(F.sqrt(F.sum("_var")).alias("rg"))
