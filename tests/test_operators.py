"""Hand-computed values of the reference operators on tiny frames."""

import math

import pytest
from pyspark.sql import functions as F

from textmill.functions import arrays as A
from textmill.functions import text as X
from textmill.operators import bpe, calibration, ngrams, quality, terms, vectors, windows


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "text string").select(fn(F.col("text")).alias("x")).first().x


def test_tokenize(spark):
    assert one(spark, "Let's eat, Grandma!", X.tokenize) == ["let's", "eat", ",", "grandma", "!"]
    assert one(spark, "", X.tokenize) == [] and one(spark, None, X.tokenize) is None


def test_build_vocab(spark):
    tokens = spark.createDataFrame([(t,) for t in "b a b c a b d".split()], "term string")
    assert {r.term: r.id for r in terms.build_vocab(tokens, min_count=2).collect()} == {"b": 2, "a": 3}


def test_add_k_and_empty_counts(spark):
    docs = spark.createDataFrame([(1, "a b a b c")], "doc_id long, text string")
    train = ngrams.bigram_table(docs, X.tokenize).select("ctx", "w").filter("ctx <> '<s>'")
    asked = spark.createDataFrame([("a", "b"), ("b", "c"), ("zzz", "b")], "ctx string, w string")
    vocabulary = spark.createDataFrame([("x", "a")], "ctx string, w string")
    p = {(r.ctx, r.w): r.p for r in ngrams.add_k(train.unionByName(vocabulary), asked, 0.5).collect()}
    assert p["a", "b"] == pytest.approx(2.5 / 3.5) and p["b", "c"] == pytest.approx(1.5 / 3.5)
    assert p["zzz", "b"] == pytest.approx(1 / 3)  # an unseen context is uniform over three words
    uniform = ngrams.add_k(train.unionByName(vocabulary), spark.createDataFrame([("q", "a")] * 4, "ctx string, w string"), 0.5)
    assert ngrams.perplexity(uniform).first().ppl == pytest.approx(3)


def test_bpe_merges_of_the_toy_words(spark):
    words = [("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)]
    frame = spark.createDataFrame([([*w, "_"], n) for w, n in words], "symbols array<string>, n long")
    merges = [(r.a, r.b) for r in bpe.train_bpe(frame, 5).orderBy("step").collect()]
    assert [a + b for a, b in merges] == ["es", "est", "est_", "lo", "low"]
    assert one(spark, "lowest", lambda c: bpe.encode_word(c, merges)) == ["low", "est_"]


def test_bm25_rises_with_term_frequency_and_saturates(spark):
    texts = ["x y y y", "x x y y", "x x x y", "z z z z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lengths = docs.select("doc_id", F.lit(4).alias("n_terms"))
    asked = spark.createDataFrame([(0, "x")], "query_id long, term string")
    s = {r.doc_id: r.score for r in terms.bm25(terms.term_table(docs), asked, lengths).collect()}
    assert set(s) == {0, 1, 2} and s[0] < s[1] < s[2] and s[2] - s[1] < s[1] - s[0]
    assert s[0] == pytest.approx(math.log((4 - 3 + 0.5) / 3.5 + 1))


def test_parse_decision(spark):
    replies = ['{"answer": "yes", "confidence": 0.8}', '{"answer": "yes", "confidence": "80%"}', '{"answer": "maybe", "confidence": 0.5}',
               '{"answer": "no", "confidence": true}', '{"answer": "no", "confidence": 1.2}', "no json", '{"answer": "no", "confidence": "0.25"}']
    rows = spark.createDataFrame([(r,) for r in replies], "r string").select(X.parse_decision(F.col("r"), ["yes", "no"]).alias("d")).collect()
    assert [(r.d.answer, r.d.confidence) for r in rows] == [
        ("yes", 0.8), ("yes", 0.8), (None, 0.5), ("no", None), ("no", None), (None, None), ("no", 0.25)]


def test_brier_softmax_and_entropy(spark):
    row = spark.createDataFrame([([0.7, 0.2, 0.1], [1.0, 1.0, 1.0])], "p array<double>, z array<double>").select(
        A.entropy(F.array(F.lit(1.0), F.lit(0.0))).alias("h"), A.softmax(F.col("z")).alias("s"), A.kl_divergence(F.col("p"), F.col("p")).alias("kl"),
        A.argmax(F.col("p")).alias("m"), A.cosine(F.col("p"), F.array(*[F.lit(0.0)] * 3)).alias("c"),
    ).first()
    assert row.h == 0 and row.s == pytest.approx([1 / 3] * 3) and row.kl == pytest.approx(0) and row.m == 0 and row.c is None


CASES = [(0.95, 1), (0.9, 0), (0.9, 1), (0.7, 1), (0.6, 0), (0.5, 1)]


def test_risk_coverage_has_one_point_for_each_confidence(spark):
    df = spark.createDataFrame(CASES, "conf double, correct int")
    curve = calibration.risk_coverage(df).orderBy("coverage").collect()
    assert [r.coverage for r in curve] == pytest.approx([1 / 6, 3 / 6, 4 / 6, 5 / 6, 1])
    assert [r.risk for r in curve] == pytest.approx([0, 1 / 3, 1 / 4, 2 / 5, 2 / 6])
    assert calibration.choose_threshold(df, wrong=10, abstain=1).first().threshold == 0.95


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(c,) for c in (0.0, 0.2, 0.2000001, 1.0)], "conf double")
    assert [r.b for r in df.select(calibration.width_bin(F.col("conf"), 5).alias("b")).collect()] == [0, 0, 1, 4]


def test_rates_of_nothing_are_null(spark):
    row = spark.createDataFrame([], "x int").agg(*calibration.rate_with_error(F.col("x") > 0, "r")).first()
    assert (row.r_n, row.r, row.r_se) == (0, None, None)


def test_largest_remainder(spark):
    df = spark.createDataFrame([("a", 10), ("b", 8), ("c", 6)], "k string, w int")
    assert {r.k: r.n for r in quality.largest_remainder(df, "k", "w", 8).collect()} == {"a": 3, "b": 3, "c": 2}


def test_nearest_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 1.0]), (4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.knn(df.filter("vec_id = 1"), df, 2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 3]
    assert [r.sim for r in got] == pytest.approx([0.9 / math.sqrt(0.82), 1 / math.sqrt(2)], abs=1e-6)


def test_nearest_neighbours_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 4)
    monkeypatch.setattr(vectors, "ROWS", 3)
    monkeypatch.setattr(vectors, "TILE", (2, 2))
    rows = [(i, [float(i % 4), 1.0]) for i in range(1, 13)] + [(20, [0.0, 0.0]), (21, None), (22, [1.0, None]), (23, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    nan = lambda s: "nan" if s is not None and math.isnan(s) else s
    got = {}
    for r in vectors.knn(df, df, 13).collect():
        got.setdefault(r.query, []).append((r["rank"], r.vec_id, nan(r.sim)))
    cosine = lambda a, b: None if not a or not b or None in a + b or len(a) != len(b) else "nan" if not any(a) or not any(b) else round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)
    for q, v in rows[:-1]:
        every = [(cosine(v, w), i) for i, w in rows[:-1] if i != q]
        best = sorted(every, key=lambda x: (0 if x[0] == "nan" else 1 if x[0] is not None else 2, -x[0] if isinstance(x[0], float) else 0, x[1]))[:13]
        assert sorted(got[q]) == [(n + 1, i, s) for n, (s, i) in enumerate(best)]


def test_windows(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0), (2, 1, 5.0)], "g int, t int, r double")
    assert [x.ret for x in windows.returns_to_go(df, "g", "t", "r").orderBy("g", "t").collect()] == [6, 5, 3, 5]
    assert [x.baseline for x in windows.leave_one_out(df, "g", "r").orderBy("g", "t").collect()] == [2.5, 2, 1.5, None]
    ranges = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 8, 9), (1, 1, 2)], "g int, lo int, hi int")
    assert sorted(tuple(r) for r in windows.merge_ranges(ranges, "g", "lo", "hi").select("lo", "hi", "n").collect()) == [(0, 7, 3), (8, 9, 1)]
    ranks = spark.createDataFrame([(3,), (1,), (3,), (2,)], "v int")
    assert sorted((r.v, r.k) for r in windows.average_rank(ranks, "v", "k").collect()) == [(1, 0.0), (2, 1.0), (3, 2.5), (3, 2.5)]


def test_refund_dates_and_citations(spark):
    df = spark.createDataFrame([(14, 25), (7, 25), (6, 25)], "d int, paid int")
    assert [r.x for r in df.select(X.tiered_refund(F.col("d"), F.col("paid")).alias("x")).collect()] == [25, 12, 0]
    assert [one(spark, d, X.is_iso_date) for d in ("2024-02-29", "2023-02-29", "2024-2-9", None)] == [True, False, False, False]
    assert one(spark, "As in [2, 1] and [1].", X.cited_ids) == [1, 2]
    assert one(spark, "One. Two! three? Four", X.sentences) == ["One.", "Two! three?", "Four"]
    assert one(spark, "  I can not say. ", lambda c: X.is_abstention(c, "I can not say.")) is True


def test_range_join_has_no_nested_loop(spark):
    from textmill.plans.table_queries import contacts

    plan = contacts(lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_naive_bayes_by_hand(spark):
    terms_ = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 3), (3, "a", 1), (4, "z", 1)], "doc_id int, term string, tf long")
    labels = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "doc_id int, label string")
    got = {r.doc_id: (r.predicted, r.log_posterior) for r in terms.naive_bayes(terms_, labels).collect()}
    # The words a and b are known; x has seen a a b, and y has seen b b b.
    assert got[1] == ("x", pytest.approx(math.log(1 / 2) + 2 * math.log(3 / 5) + math.log(2 / 5)))
    assert got[2] == ("y", pytest.approx(math.log(1 / 2) + 3 * math.log(4 / 5)))
    assert got[3] == ("x", pytest.approx(math.log(1 / 2) + math.log(3 / 5)))
    assert got[4] == ("y", pytest.approx(math.log(1 / 2) + math.log(1 / 5)))
    assert terms.naive_bayes(terms_, labels.limit(0)).collect() == []
