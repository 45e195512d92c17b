"""Calibration, selective prediction and cost thresholds over (confidence, correct) records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.operators.ordering import place, running


def width_bin(conf: Column, m: int) -> Column:
    """Right-closed bins of equal width, from 0; a confidence of 0 is in the first."""
    edges = F.array(*(F.lit(i * (1 / m)) for i in range(1, m)))
    return F.size(F.filter(edges, lambda e: e < conf))


def reliability(df: DataFrame, bins: Column) -> DataFrame:
    return df.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("conf"), F.avg("correct").alias("acc"))


def ece(table: DataFrame) -> DataFrame:
    """The gap of each bin weighted by its count."""
    return table.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def mass_bins(df: DataFrame, m: int, tie: str) -> DataFrame:
    """df with bin from 1: m groups of as equal size as can be, the first ones larger, by confidence and tie.

    Rows are put in one order part by part, so neither a common confidence nor a common tie gathers in one task. Rows
    without a confidence have no bin and are left out."""
    rows = place(df.filter("conf IS NOT NULL"), [F.col("conf"), F.col(tie)], "_place", 0)
    rows = rows.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("_all"))))
    at, small, larger = F.col("_place"), F.expr(f"_all div {m}"), F.col("_all") % m
    edge = larger * (small + 1)
    number = F.when(at < edge, F.floor(at / (small + 1))).otherwise(larger + F.floor((at - edge) / F.greatest(small, F.lit(1))))
    return rows.withColumn("bin", (number + 1).cast("int")).drop("_place", "_all")


def risk_coverage(df: DataFrame) -> DataFrame:
    """(conf, coverage, risk, share): one point for each distinct confidence, high to low, with the share of rows that it adds.

    Confidences are counted first, and put in one order part by part."""
    counts = df.groupBy("conf").agg(F.count(F.lit(1)).alias("_n"), F.sum(1 - F.col("correct")).alias("_e"))
    total = counts.agg(F.sum("_n").alias("_all"))
    upto = running(counts, [F.desc("conf")], {"_upto": F.col("_n"), "_errors": F.col("_e")}).join(F.broadcast(total))
    return upto.select("conf", (F.col("_upto") / F.col("_all")).alias("coverage"), (F.col("_errors") / F.col("_upto")).alias("risk"), (F.col("_n") / F.col("_all")).alias("share"))


def aurc(curve: DataFrame) -> DataFrame:
    """The area under the curve of risk_coverage."""
    return curve.agg(F.sum(F.col("share") * F.col("risk")).alias("aurc"))


def choose_threshold(df: DataFrame, wrong: float, abstain: float) -> DataFrame:
    """(threshold, cost): the least empirical cost of answering at or above a confidence; ties to the smallest.

    Candidates are 0, the distinct confidences, and just above the largest; costs are running sums over them."""
    curve = risk_coverage(df).select(F.col("conf").alias("threshold"), (F.col("coverage") * F.col("risk") * wrong + (1 - F.col("coverage")) * abstain).alias("cost"))
    ends = df.agg((F.max("conf") + 1e-9).alias("threshold")).withColumn("cost", F.lit(float(abstain)))
    zero = df.agg(F.lit(0.0).alias("threshold"), (F.avg(1 - F.col("correct")) * wrong).alias("cost"))
    every = curve.unionByName(ends).unionByName(zero)
    return every.agg(F.min(F.struct(F.round("cost", 12).alias("cost"), "threshold")).alias("b")).select("b.threshold", "b.cost")


def choose_thresholds(df: DataFrame, by: str, wrong: float, ask: float, miss: float, escalate: float) -> DataFrame:
    """(esc, act, cost): escalate below esc, act from act on, ask between, at the least mean cost; ties to the smallest esc, then act.

    df: a whole number by and correct, 0 or 1. Acting costs wrong if it errs, asking costs ask, and miss more if it
    errs; rows without by are asked about. Candidates are all values of by, 0 and one above the largest. A pair's cost is a
    sum over the values below esc plus one over those around act, so the best esc up to each act is a running
    minimum over the counts of distinct values, and no pair is built. An empty df gives an empty result."""
    counts = df.groupBy(F.col(by).cast("long").alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.sum(1 - F.col("correct")).alias("_e"))
    asked = ask * F.col("_n") + miss * F.col("_e")
    blank = F.col("_v").isNull()
    whole = counts.agg(
        F.sum("_n").alias("_all"), F.coalesce(F.sum(F.when(blank, asked)), F.lit(0.0)).alias("_blank"), F.max("_v").alias("_top")
    ).filter("_all IS NOT NULL")
    ends = whole.select(F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.coalesce(F.col("_top") + 1, F.lit(0))))).alias("_v"), F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_e"))
    values = counts.filter(~blank).unionByName(ends).groupBy("_v").agg(F.sum("_n").alias("_n"), F.sum("_e").alias("_e"))
    # What stands behind is all that there is less what stands before: no window runs backwards.
    every = values.agg(F.sum(wrong * F.col("_e")).alias("_wrongs"))
    cost = {"_less": escalate * F.col("_n") - asked, "_asked": asked.cast("double"), "_wrong": (wrong * F.col("_e")).cast("double")}
    sums = running(values, [F.col("_v")], cost, before=True).join(F.broadcast(every))
    sums = sums.select("_v", F.round("_less", 6).alias("_low"), F.round(F.col("_asked") + F.col("_wrongs") - F.col("_wrong"), 6).alias("_high"))
    upto = running(sums, [F.col("_v")], mins={"_b": F.struct("_low", "_v")})
    pairs = upto.select(F.round(F.col("_b._low") + F.col("_high"), 6).alias("_cost"), F.col("_b._v").alias("esc"), F.col("_v").alias("act"))
    best = pairs.agg(F.min(F.struct("_cost", "esc", "act")).alias("b"))
    return best.join(F.broadcast(whole)).select("b.esc", "b.act", ((F.col("b._cost") + F.col("_blank")) / F.col("_all")).alias("cost"))


def rate_with_error(condition: Column, name: str) -> list[Column]:
    """n, the rate and its standard error sqrt(r (1 - r) / n); null without rows."""
    x = condition.cast("double")
    return [F.count(x).alias(f"{name}_n"), F.avg(x).alias(name), F.sqrt(F.try_divide(F.avg(x) * (1 - F.avg(x)), F.count(x))).alias(f"{name}_se")]


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact binomial test of whole counts; 1 without any.

    One fold over i up to the smaller count m holds ln C(n, i) and the sum of C(n, j) for j up to i in units of
    C(n, i), so that no term underflows however large n is."""
    n, m = wins + losses, F.least(wins, losses)
    none = F.expr("CAST(array() AS array<bigint>)")
    steps = F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(none)
    start = F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("sum"))
    step = lambda s, i: F.struct((s["log"] + F.ln((n - i + 1) / i)).alias("log"), (s["sum"] * (i / (n - i + 1)) + 1).alias("sum"))
    log_tail = F.aggregate(steps, start, step, lambda s: s["log"] + F.ln(s["sum"])) - n * F.lit(math.log(2))
    return F.least(F.lit(1.0), 2 * F.exp(log_tail))
