"""Sampling and search over a bigram table (prev, term, p): steps are joins over all prompts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators.quality import hash_uniform


def gumbel(*parts: Column) -> Column:
    """A Gumbel number from a hash: the largest of log p + gumbel is a draw from p."""
    u = F.least(F.greatest(hash_uniform(*parts), F.lit(1e-9)), F.lit(1 - 1e-9))
    return -F.ln(-F.ln(u))


def sample_with_temperature(rows: DataFrame, by: str, item: str, logit: Column, tau: float, seed: str) -> DataFrame:
    """(by, item): one draw for each group from softmax(logit / tau), by the largest logit / tau + gumbel; nothing is sorted."""
    key = F.round(logit / tau + gumbel(F.lit(seed), F.col(by), F.col(item)), 9)
    return rows.groupBy(by).agg(F.max_by(item, F.struct(key, F.col(item))).alias(item))


def generate(prompts: DataFrame, bigrams: DataFrame, steps: int, tau: float, seed: str) -> DataFrame:
    """(prompt_id, text): prompts (prompt_id, prev) continued by steps draws from the bigram table; a prompt ends where the
    table has no continuation."""
    now = prompts.select("prompt_id", F.col("prev").alias("_last"), F.array().cast("array<string>").alias("_out"))
    for step in range(steps):
        options = now.join(bigrams.withColumnRenamed("prev", "_last"), "_last")
        drawn = sample_with_temperature(options, "prompt_id", "term", F.ln("p"), tau, f"{seed}{step}")
        now = now.join(drawn, "prompt_id", "left").select(
            "prompt_id", F.col("term").alias("_last"), F.when(F.col("term").isNotNull(), F.concat("_out", F.array("term"))).otherwise(F.col("_out")).alias("_out")
        )
    return now.select("prompt_id", F.array_join("_out", " ").alias("text"))


def beam_search(prompts: DataFrame, bigrams: DataFrame, width: int, steps: int, end: str = ".") -> DataFrame:
    """(prompt_id, text, log_p): the hypothesis with the best mean log probability a token among those that ended, or among the
    live ones if none did, for prompts (prompt_id, prev); ties to the shorter one.

    Each step keeps the width best continuations of a prompt, ties by text; a prompt is done when width hypotheses
    have ended. One without a continuation stays as it is. Only the width most likely continuations of a word can be
    among the best, so the table is cut to these first."""
    best = F.row_number().over(Window.partitionBy("prev").orderBy(F.desc("p"), "term"))
    table = bigrams.withColumn("_r", best).filter(F.col("_r") <= width).select(F.col("prev").alias("_last"), "term", F.ln("p").alias("_lp"))
    live = prompts.select("prompt_id", F.col("prev").alias("_last"), F.lit("").alias("text"), F.lit(0.0).alias("log_p"), F.lit(0).alias("n"))
    ended = live.limit(0)
    for _ in range(steps):
        more = F.col("term").isNotNull()
        grown = live.join(table, "_last", "left").select(
            "prompt_id", F.coalesce("term", "_last").alias("_last"), F.trim(F.concat_ws(" ", "text", "term")).alias("text"),
            F.round(F.col("log_p") + F.coalesce("_lp", F.lit(0.0)), 9).alias("log_p"), (F.col("n") + more.cast("int")).alias("n"),
        )
        order = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("log_p"), "text"))
        kept = grown.withColumn("_r", order).filter(F.col("_r") <= width).drop("_r")
        over = (F.col("_last") == end) & (F.col("n") > 0)
        ended = ended.unionByName(kept.filter(over))
        full = ended.groupBy("prompt_id").count().filter(F.col("count") >= width)
        live = kept.filter(~over).join(full, "prompt_id", "left_anti")
    pool = ended.withColumn("_e", F.lit(1)).unionByName(live.withColumn("_e", F.lit(0)))
    mean = F.round(F.try_divide("log_p", "n"), 9)
    pick = F.max_by(F.struct("text", "log_p"), F.struct("_e", mean, -F.col("n"), "text"))
    return pool.groupBy("prompt_id").agg(pick.alias("b")).select("prompt_id", "b.text", "b.log_p")


def expected_return(steps: DataFrame, target: DataFrame, first: str) -> DataFrame:
    """(expected): the expected share of places at which a Markov chain has the target's symbol.

    steps: (t, prev, term, p), the chance of term at place t (from 0) after prev; target: (t, term). The distribution of
    the last symbol is carried from place to place, a row for each symbol."""
    places = target.count()
    prev = target.sparkSession.createDataFrame([(first, 1.0)], "prev string, mass double")
    hits = None
    for t in range(places):
        now = steps.filter(F.col("t") == t).join(prev, "prev").groupBy("term").agg(F.sum(F.col("p") * F.col("mass")).alias("mass"))
        hit = now.join(target.filter(F.col("t") == t).select("term"), "term", "left_semi")
        hits = hit if hits is None else hits.unionByName(hit)
        prev = now.withColumnRenamed("term", "prev")
    return hits.agg((F.coalesce(F.sum("mass"), F.lit(0.0)) / places).alias("expected"))
