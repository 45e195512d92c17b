"""Loops, retries and judges."""

import re

from pyspark.sql import functions as F

from textmill.functions import udfs as U
from textmill.operators import agents as G


def test_judges_and_encoders(spark):
    answers = spark.createDataFrame([(1, "Cats purr. Dogs fly [1].", ["cats purr"]), (2, None, None), (3, "Cats.", None)], "answer_id int, answer string, sources array<string>")
    judge = U.judge_udf(lambda claim, sources: all(w in " ".join(sources).lower() for w in re.findall("[a-z]+", claim.lower())))
    got = {r.answer_id: (r.claims, r.supported, r.least) for r in U.faithfulness(answers, judge).collect()}
    assert got == {1: (2, 0.5, 0.0), 2: (0, None, None), 3: (1, 0.0, 0.0)}
    encode = U.embed_udf(lambda: lambda texts: [[len(t), 1] for t in texts])
    assert [r.v for r in answers.select("answer_id", encode(F.col("answer")).alias("v")).orderBy("answer_id").collect()] == [[24.0, 1.0], [0.0, 1.0], [5.0, 1.0]]


def test_loops_and_retries(spark):
    steps = [("a", 1, "ok", 2), ("a", 2, "ok", 0), ("a", 3, "ok", 5), ("b", 1, "ok", 1), ("b", 2, "refused", 3), ("c", 1, "ok", 1), ("c", 2, "ok", 1), ("c", 3, "ok", 1), ("c", 4, "ok", 0)]
    got = {r.loop_id: (r.status, r.calls) for r in G.replay_loops(spark.createDataFrame(steps, "loop_id string, k int, stop string, n_calls int"), 3).collect()}
    assert got == {"a": ("done", 2), "b": ("failed", 1), "c": ("step limit", 3)}
    replies = [("x", 1, "end", 1), ("x", 2, "end", 9), ("y", 1, "truncated", 9), ("y", 2, "end", 9), ("z", 1, "end", 1), ("z", 2, "end", 1), ("z", 3, "end", 1), ("z", 4, "end", 9)]
    found = G.extract_attempts(spark.createDataFrame(replies, "item_id string, attempt int, stop string, value int"), F.col("value") > 5, 2)
    assert {r.item_id: (r.attempt, r.value) for r in found.collect()} == {"x": (2, 9), "y": (1, None), "z": (3, None)}


def test_retries_as_rows(spark):
    rows = [("a", 1, 429, "2.5"), ("a", 2, 429, None), ("a", 3, 200, None), ("a", 4, 200, None), ("b", 1, 500, None), ("b", 2, 200, None), ("c", 1, 429, "1"), ("c", 2, 429, "x"), ("c", 3, 429, "9"), ("d", 1, 200, None), ("e", 1, None, None)]
    df = spark.createDataFrame(rows, "request_id string, attempt int, status int, retry_after string")
    got = {r.request_id: (r.calls, r.wait, r.ok) for r in G.retry_waits(df, tries=3).collect()}
    assert got["a"][::2] == (3, True) and 4.5 <= got["a"][1] < 6.5
    assert got["b"] == (1, 0.0, False) and got["d"] == (1, 0.0, True) and got["e"] == (1, 0.0, False)
    assert got["c"][::2] == (3, False) and 3 <= got["c"][1] < 5
