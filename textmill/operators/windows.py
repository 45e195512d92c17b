"""Order-sensitive operators: each names its full order, so results are the same on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators.ordering import running


def dedupe_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by order. Aggregated with partial combination, so a hot key moves one row a task."""
    rest = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*keys).agg(F.max_by(rest, F.struct(*order)).alias("_r")).select("_r.*")


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*keys).agg(F.min_by(rest, F.struct(*order)).alias("_r")).select("_r.*")


def returns_to_go(df: DataFrame, episode: str, step: str, reward: str) -> DataFrame:
    """df with ret: the sum of rewards from this step to the episode's end."""
    w = Window.partitionBy(episode).orderBy(step).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn("ret", F.sum(reward).over(w))


def leave_one_out(df: DataFrame, group: str, value: str) -> DataFrame:
    """df with baseline: the mean of the other values of the group; null where there is no other."""
    sums = df.groupBy(group).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return df.join(sums, group).withColumn("baseline", F.try_divide(F.col("_s") - F.col(value), F.col("_n") - 1)).drop("_s", "_n")


def merge_ranges(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, start, end, n): ranges that touch or overlap become one. Those without ends count with the group's last one.

    Equal ranges are peers of the running sum's frame, so their order never matters."""
    order = Window.partitionBy(group).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", (F.col(start) > F.coalesce(reach, F.col(start) - 1)).cast("int"))
    island = marked.withColumn("_island", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the 0-based rank of value, the mean of its places for ties. Rows without a value are left out.

    Ranks come from the counts of distinct values, put in one order part by part."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(counts, [F.col(value)], {"_before": F.col("_c")}, before=True)
    return df.join(ranked.select(value, (F.col("_before") + (F.col("_c") - 1) / 2).alias(name)), value)


def nucleus(df: DataFrame, group: str, p: str, tie: str, mass: float) -> DataFrame:
    """The smallest set of largest p that holds the mass; the largest always stays."""
    order = Window.partitionBy(group).orderBy(F.desc(p), tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.sum(p).over(order)).filter(F.coalesce("_before", F.lit(0.0)) < mass).drop("_before")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """left with the value of the last right row of its key at or before its time: one union and one running window."""
    rows = left.withColumns({"_t": F.col(left_time), "_v": F.lit(None).cast(right.schema[value].dataType), "_left": F.lit(True)})
    marks = right.select(key, F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.lit(False).alias("_left"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_t", F.col("_left").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(order)).filter("_left").drop("_t", "_v", "_left")
