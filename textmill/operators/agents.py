"""Recorded loops of agents: tool loops, retries, delegated topics, seeds and checkpoints of a harness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.operators.quality import hash_uniform


def retry_waits(attempts: DataFrame, tries: int = 5, base: float = 1.0, seed: str = "retry") -> DataFrame:
    """(request_id, calls, wait, ok) of recorded requests: how often each is sent, how long it waits in all, and if it succeeds.

    attempts: (request_id, attempt from 1, status, retry_after). A request is sent again after status 429, up to ``tries``
    times; the first other status ends it, and only 200 is a success. A wait is what the answer asks for, if that is a
    number of seconds, or else doubles from ``base`` with up to as much again, by a hash of request and attempt."""
    ends = attempts.groupBy("request_id").agg(F.min(F.when(F.coalesce(F.col("status") != 429, F.lit(True)), F.col("attempt"))).alias("_end"))
    sent = attempts.join(ends, "request_id").filter((F.col("attempt") <= tries) & (F.col("_end").isNull() | (F.col("attempt") <= F.col("_end"))))
    again = (F.col("status") == 429) & (F.col("attempt") < tries)
    wait = F.coalesce(F.col("retry_after").try_cast("double"), base * F.pow(F.lit(2.0), F.col("attempt") - 1) * (1 + hash_uniform(F.lit(seed), F.col("request_id"), F.col("attempt"))))
    return sent.groupBy("request_id").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(F.when(again, wait)), F.lit(0.0)).alias("wait"), F.bool_or(F.coalesce(F.col("status") == 200, F.lit(False))).alias("ok"))


def replay_loops(steps: DataFrame, most: int) -> DataFrame:
    """(loop_id, status, calls): the end of each recorded tool loop. steps: (loop_id, k from 1, stop, n_calls).

    The first step that is truncated or refused fails the loop, the first without a tool call ends it as done, and after
    ``most`` steps it is at its limit. calls counts the tool calls made until then."""
    inside = steps.filter(F.col("k") <= most)
    last = F.when(F.col("stop").isin("truncated", "refused"), "failed").when(F.coalesce("n_calls", F.lit(0)) == 0, "done")
    ends = inside.withColumn("_end", last)
    first = ends.groupBy("loop_id").agg(F.min_by("_end", F.when(F.col("_end").isNotNull(), F.col("k"))).alias("_s"), F.min(F.when(F.col("_end").isNotNull(), F.col("k"))).alias("_k"))
    made = inside.join(first, "loop_id").groupBy("loop_id").agg(
        F.coalesce(F.first("_s"), F.lit("step limit")).alias("status"), F.sum(F.when(F.col("_k").isNull() | (F.col("k") < F.col("_k")), F.coalesce("n_calls", F.lit(0))).otherwise(0)).alias("calls")
    )
    return made.select("loop_id", "status", "calls")


def extract_attempts(replies: DataFrame, valid: Column, retries: int) -> DataFrame:
    """(item_id, attempt, value): the first valid reply among retries + 1, and the number of calls made. replies: (item_id,
    attempt from 1, stop, value). A truncated or refused reply ends it without a value."""
    rows = replies.filter(F.col("attempt") <= retries + 1)
    cut = F.col("stop").isin("truncated", "refused")
    end = F.when(cut | F.coalesce(valid, F.lit(False)), F.col("attempt"))
    found = rows.groupBy("item_id").agg(F.min(end).alias("_a"), F.max("attempt").alias("_m"), F.min_by(F.when(~cut, F.col("value")), end).alias("_v"))
    return found.select("item_id", F.coalesce("_a", "_m").alias("attempt"), F.when(F.col("_a").isNotNull(), F.col("_v")).alias("value"))


def coverage_gaps(required: DataFrame, results: DataFrame) -> DataFrame:
    """(topic, reason) of required topics that were not delegated, failed, or are partial by failed calls. results: (topic,
    status, failed)."""
    joined = required.select("topic").join(results.select("topic", "status", "failed"), "topic", "left")
    reason = F.when(F.col("status").isNull(), "not delegated").when(F.col("status") == "failed", "failed").when(F.col("failed") > 0, F.concat(F.lit("partial: "), F.col("failed").cast("string"), F.lit(" failed call(s)")))
    return joined.select("topic", reason.alias("reason")).filter("reason IS NOT NULL")


def harness_summary(checks: DataFrame) -> DataFrame:
    """(group, checks, passed, first_failure) of a harness's checkpoints (group, no, name, ok)."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    return checks.groupBy("group").agg(F.count(F.lit(1)).alias("checks"), F.count_if(ok).alias("passed"), F.min_by("name", F.when(~ok, F.col("no"))).alias("first_failure"))


def seed_thresholds(gaps: DataFrame, offset: float = 0.0) -> DataFrame:
    """(key, min_gap, noise, assertable, threshold) of comparisons that must be above offset on every seed. gaps: (key, seed, value,
    again), where again is the value of a repeated run, if there is one.

    A comparison can be asserted if every gap is positive and the smallest is at least twice the noise between repeats;
    the threshold is then halfway."""
    gap = F.col("value") - offset
    found = gaps.groupBy("key").agg(F.min(gap).alias("min_gap"), F.max(F.abs(F.col("value") - F.col("again"))).alias("noise"))
    good = (F.col("min_gap") > 0) & (F.col("min_gap") >= 2 * F.coalesce("noise", F.lit(0.0)))
    return found.select("key", "min_gap", "noise", good.alias("assertable"), F.when(good, F.lit(offset) + F.col("min_gap") / 2).alias("threshold"))
