"""Divergence of distributions over a large vocabulary, of which a window sees a small part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sparse_kl(p: DataFrame, q: DataFrame, vocabulary: DataFrame, k: float = 1.0, by: str = "window") -> DataFrame:
    """(by, kl): the exact divergence of p from q in nats, window by window, both with k added to every word of the vocabulary.

    p, q: (by, term, n) counts; vocabulary: one row (size). Only words that a window of p or q has are joined. All others have
    the same two probabilities, so they add one closed term however many they are. A window that one of the two lacks
    has no row."""
    sums = lambda rows, name: rows.groupBy(by).agg(F.sum("n").alias(name))
    totals = sums(p, "_p").join(sums(q, "_q"), by).crossJoin(F.broadcast(vocabulary.select(F.col("size").alias("_v"))))
    marked = p.select(by, "term", F.col("n").alias("a"), F.lit(0).alias("b")).unionByName(q.select(by, "term", F.lit(0).alias("a"), F.col("n").alias("b")))
    words = marked.groupBy(by, "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).join(totals, by)
    share = lambda n, total: (n + k) / (F.col(total) + k * F.col("_v"))
    a, b = share(F.col("a"), "_p"), share(F.col("b"), "_q")
    found = words.groupBy(by).agg(F.sum(a * F.ln(a / b)).alias("_kl"), F.count(F.lit(1)).alias("_seen"))
    zero, other = share(F.lit(0), "_p"), share(F.lit(0), "_q")
    rest = (F.col("_v") - F.col("_seen")) * zero * F.ln(zero / other)
    return found.join(totals, by).select(by, (F.col("_kl") + F.when(F.col("_v") > F.col("_seen"), rest).otherwise(0.0)).alias("kl"))


def drift(counts: DataFrame, vocabulary: DataFrame, k: float = 1.0, by: str = "window") -> DataFrame:
    """(by, kl): the divergence of each window from the one before, by a whole number."""
    before = counts.withColumn(by, F.col(by) + 1)
    return sparse_kl(counts, before, vocabulary, k, by)
