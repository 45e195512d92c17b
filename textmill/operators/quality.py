"""Data checks, allocation and hash-based sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators.ordering import place


def validate(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of each rule that a row breaks; a rule that is null counts as broken."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def largest_remainder(shares: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, n): total apportioned by weight, leftovers to the largest remainders, ties to the smaller key."""
    every = shares.agg(F.sum(weight).alias("_all"))
    exact = total * F.col(weight) / F.col("_all")
    rows = shares.join(F.broadcast(every)).select(key, F.floor(exact).alias("_base"), F.round(exact - F.floor(exact), 9).alias("_rest"))
    ranked = place(rows, [F.desc("_rest"), F.col(key)], "_place")
    left = ranked.agg((total - F.sum("_base")).alias("_left"))
    return ranked.join(F.broadcast(left)).select(key, (F.col("_base") + (F.col("_place") <= F.col("_left")).cast("long")).alias("n"))


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from an MD5: the same on every engine."""
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum with the least hash."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))))
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")
