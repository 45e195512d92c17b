import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import bpe, ordering, quantiles


def test_running_totals_equal_one_window(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, rng.randint(-50, 50)]), rng.random()) for k in range(700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, v long, x double").repartition(3)
    for before in (False, True):
        got = ordering.running(df, [F.desc("x"), F.col("k")], {"total": F.col("v")}, {"least": F.struct("v", "k")}, before, parts=7).collect()
        total, least, seen = 0, None, {}
        for k, v, x in sorted(rows, key=lambda r: (-r[2], r[0])):
            after = total + (v or 0)
            key = (v is not None, v or 0, k)
            least_after = key if least is None else min(least, key)
            seen[k] = (total, least) if before else (after, least_after)
            total, least = after, least_after
        assert {r.k: r.total for r in got} == {k: s[0] for k, s in seen.items()}
    places = ordering.place(df, [F.col("x"), F.col("k")], "p", parts=5).collect()
    assert [r.k for r in sorted(places, key=lambda r: r.p)] == [k for k, _, _ in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert sorted(r.p for r in places) == list(range(1, 701))
    assert ordering.place(df.limit(0), [F.col("x")], "p").count() == 0


@pytest.mark.parametrize(("few", "buckets"), [(10_000, 1024), (20, 4), (1, 2)])
def test_quantiles_equal_percentile(spark, few, buckets):
    rng = random.Random(few)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1e6), 1.5, 1e-300 * rng.random(), 1e300])) for _ in range(900)]
    rows += [("one", 3.0), ("same", 2.0), ("same", 2.0), ("none", None), ("a", None), ("nan", float("nan")), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r.g, r.p): r.quantile for r in quantiles.quantiles(df, ["g"], "v", probs, buckets, few).collect()}
    clean = df.filter("v IS NOT NULL AND NOT isnan(v)")
    want = {(r.g, p): x for r in clean.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect() for p, x in zip(probs, r.q, strict=True)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-320) for k in want)
    alone = quantiles.quantiles(clean, [], "v", [0.5], buckets, few).collect()
    assert [r.quantile for r in alone] == [pytest.approx(float(np.percentile([v for _, v in rows if v is not None and v == v], 50)), rel=1e-12)]


def plain_bpe(words, merges):
    words = [(list(w), n) for w, n in words]
    found = []
    for step in range(merges):
        counts = Counter()
        for w, n in words:
            for p in zip(w, w[1:], strict=False):
                counts[p] += n
        if not counts:
            break
        (a, b), n = min(counts.items(), key=lambda x: (-x[1], x[0]))
        found.append((step, a, b, n))
        for w, _ in words:
            k = 0
            while k < len(w) - 1:
                if w[k] == a and w[k + 1] == b:
                    w[k : k + 2] = [a + b]
                k += 1
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bpe_equals_the_plain_trainer(spark, monkeypatch, seed):
    monkeypatch.setattr(bpe, "LOOK", 8 if seed == 2 else 64)
    rng = random.Random(seed)
    letters = "ab" if seed == 3 else "abcdefgh"  # few letters: overlapping runs, and merges that make a known symbol again
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.randint(1, 30) for _ in range(150)}
    rows = [([*w, bpe.END], n) for w, n in words.items()]
    got = bpe.train_bpe(spark.createDataFrame(rows, "symbols array<string>, n int").repartition(3), 40)
    assert sorted(map(tuple, got.collect())) == plain_bpe(rows, 40)
    assert bpe.train_bpe(spark.createDataFrame([(["a"], 3)], "symbols array<string>, n int"), 5).collect() == []
