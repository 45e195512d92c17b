"""Sequences of ids and of log probabilities: encoding with padding, decoding to the end mark, masks, gathers and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions import arrays as A


def ids_until(ids: Column, end: int) -> Column:
    """The ids before the first end mark; all without one."""
    at = F.array_position(ids, end).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), at - 1)).otherwise(ids)


def padded(ids: Column, length: Column | int, pad: int) -> Column:
    """ids filled up to a length; a longer one is refused by the caller's choice of length."""
    length = length if isinstance(length, Column) else F.lit(length)
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0))))


def encode_batch(df: DataFrame, batch: str, ids: str, pad: int) -> DataFrame:
    """df with ids padded to the longest of its batch, the length, and a mask of ones and zeros."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_max"))
    return df.join(longest, batch).select(
        *(c for c in df.columns if c != ids), padded(F.col(ids), F.col("_max"), pad).alias(ids), F.size(ids).alias("length"),
        F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("_max") - F.size(ids))).alias("mask"),
    )


def masked_labels(ids: Column, learned: Column, ignore: int = -100) -> Column:
    """ids where learned is true, ignore elsewhere."""
    return F.zip_with(ids, learned, lambda x, m: F.when(m, x).otherwise(ignore))


def mask_tokens(ids: Column, u: Column, v: Column, mask: int, vocabulary: int, ignore: int = -100) -> Column:
    """Struct (inputs, labels): 15 % of the places are chosen by u; of these 80 % become mask, 10 % another id by v, 10 % stay.

    u, v: arrays of numbers in [0, 1), one for each place."""
    given = F.arrays_zip(ids.alias("id"), u.alias("u"), v.alias("v"))
    corrupt = lambda z: F.when(z["u"] < 0.12, mask).when(z["u"] < 0.135, F.floor(z["v"] * vocabulary).cast("int")).otherwise(z["id"])
    return F.struct(F.transform(given, corrupt).alias("inputs"), F.transform(given, lambda z: F.when(z["u"] < 0.15, z["id"]).otherwise(ignore)).alias("labels"))


def gathered(rows: Column, actions: Column) -> Column:
    """The entry of each row (an array of arrays) at the 0-based action of its place."""
    return F.zip_with(rows, actions, lambda r, a: F.element_at(r, a + 1))


def sequence_logprob(logp: Column, mask: Column) -> Column:
    """The sum of log probabilities where the mask is 1."""
    return A.total(F.zip_with(logp, mask, lambda x, m: F.when(m == 1, x).otherwise(F.lit(0.0))))


def loss_and_perplexity(df: DataFrame, logp: Column, counts: Column) -> DataFrame:
    """(n, loss, perplexity, bits) over the rows where counts holds."""
    nll = F.avg(F.when(counts, -logp))
    return df.agg(F.count_if(counts).alias("n"), nll.alias("loss"), F.exp(nll).alias("perplexity"), (nll / F.ln(F.lit(2.0))).alias("bits"))


def alignment_hit_rate(df: DataFrame, weights: str, start: str, stop: str, tolerance: int = 1) -> DataFrame:
    """(hits, total, rate): how often the largest weight lies in its span, or at most tolerance places behind it."""
    at = A.argmax(F.col(weights))
    hit = (at >= F.col(start)) & (at < F.col(stop) + tolerance)
    return df.agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("total"), F.avg(hit.cast("int")).alias("rate"))


def by_distance(df: DataFrame, group: str, step: str, value: str) -> DataFrame:
    """(distance, mean, n): the mean of value by how far a step is from its group's last."""
    last = df.groupBy(group).agg(F.max(step).alias("_last"))
    rows = df.join(last, group).select((F.col("_last") - F.col(step)).alias("distance"), value)
    return rows.groupBy("distance").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def add_k_log_probs(counts: DataFrame, alphabet: DataFrame, k: float) -> DataFrame:
    """(context, symbol, log_p) of every context that was seen and every symbol. counts (context, symbol, n); alphabet (symbol),
    whose size is that of a vocabulary of symbols."""
    size = alphabet.agg(F.count(F.lit(1)).alias("_v"))
    totals = counts.groupBy("context").agg(F.sum("n").alias("_all"), F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("_m"))
    each = alphabet.agg(F.array_sort(F.collect_set("symbol")).alias("_a"))
    wide = totals.join(F.broadcast(size)).join(F.broadcast(each)).select("context", "_all", "_v", "_m", F.explode("_a").alias("symbol"))
    return wide.select("context", "symbol", F.ln((F.coalesce(F.try_element_at("_m", "symbol"), F.lit(0)) + k) / (F.col("_all") + k * F.col("_v"))).alias("log_p"))


def run_sheet(df: DataFrame, group: str, order: str, minutes: str, begin: int) -> DataFrame:
    """df with start and stop: minutes of the day of entries one after the other, from begin."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(begin) + F.coalesce(F.sum(minutes).over(before), F.lit(0))
    return df.withColumn("start", start).withColumn("stop", F.col("start") + F.col(minutes))
