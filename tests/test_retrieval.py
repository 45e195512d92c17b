"""Chunks, sections, spans, second stages, fits and generation against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import terms as O
from textmill.operators import checks as K
from textmill.operators import fitting as M
from textmill.operators import generation as G
from textmill.operators import retrieval as S


def test_sentence_chunks_hold_whole_sentences():
    rng = random.Random(3)
    for _ in range(60):
        text = " ".join("W" + " ".join(rng.choice("abcd") * rng.randint(1, 6) for _ in range(rng.randint(1, 25))) + rng.choice(".!?") for _ in range(rng.randint(0, 30)))
        size, overlap = rng.randint(5, 30), rng.randint(0, 4)
        chunks = S.sentence_chunks(text, size, overlap)
        assert all(n == len(text[a:b].split()) <= size for a, b, n in chunks)
        assert all(a < c and b < d and c <= b + 1 for (a, b, _), (c, d, _) in zip(chunks, chunks[1:], strict=False))
        if text:
            assert chunks[0][0] == 0 and chunks[-1][1] == len(text)
            ends = {m.start() for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z])", text)} | {len(text)}
            sentences = [len(x.split()) for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text)]
            if max(sentences) <= size:
                assert all(b in ends for _, b, _ in chunks)
    assert S.sentence_chunks("  \n", 5, 1) == []


def test_index_ids_and_sections(spark):
    text = "intro here.\n## First part\nBody one. Body two.\n## Second\nEnd."
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", "No heading.")], "doc_id string, text string")
    chunks = S.build_index(docs, 4, 0)
    rows = S.section_of(chunks, S.headings(docs, r"^## (.+)$", "doc_id", "text"), "doc_id").orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == [f"a:{i:04d}" for i in range(len(rows) - 1)] + ["c:0000"]
    for r in rows[:-1]:
        heads = [m for m in re.finditer(r"^## (.+)$", text, re.M) if m.start() <= r.start]
        assert r.section == (heads[-1].group(1) if heads else "") and r.chunk == text[r.start : r.stop]
    assert rows[-1].section == ""


def test_containing_finds_short_and_long_items(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten."), (2, "two three"), (3, None), (4, "")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "ne two three four five six seven eight ni"), (2, "two three"), (3, "zzz"), (4, ""), (5, "one two three four five six seven")], "item_id int, text string")
    got = {(r.item_id, r.doc_id) for r in S.containing(items, docs, "item_id", "doc_id").collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (5, 1)}
    quotes = spark.createDataFrame([("q1", 1, "two"), ("q2", 1, "t"), ("q3", 9, "x"), ("q4", 3, "x"), ("q5", 2, "zz")], "q string, doc_id int, quote string")
    assert {(r.q, r.n) for r in S.quote_errors(quotes, docs, "q", "doc_id").collect()} == {("q2", 4), ("q3", None), ("q4", None), ("q5", 0)}


def test_longest_run_equals_dynamic_programming(spark):
    rng = random.Random(5)
    left = [(i, [rng.choice("ab") for _ in range(rng.randint(0, 14))]) for i in range(12)]
    right = [(i, [rng.choice("ab") for _ in range(rng.randint(0, 14))]) for i in range(12)]

    def run(a, b):
        best = 0
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, n)
        return best

    frames = [spark.createDataFrame(x, f"{k} int, tokens array<string>") for x, k in ((left, "a"), (right, "b"))]
    got = {(r.a, r.b): r.run for r in S.longest_shared_run(*frames, "a", "b", 3).collect()}
    assert got == {(i, j): n for i, a in left for j, b in right if (n := run(a, b)) >= 3}


def test_overlaps_and_agreement(spark):
    rng = random.Random(6)
    spans = lambda: [(rng.randint(0, 3), rng.randint(0, 2), s, s + rng.choice([0, 5, 700, 4000])) for s in (rng.randint(0, 5000) for _ in range(40))]
    a, b = spans(), spans()
    names = "item_id int, page_id int, start int, stop int"
    fa, fb = spark.createDataFrame(a, names), spark.createDataFrame(b, names)
    want = sorted((i, p, s, e, t, f) for i, p, s, e in a for j, q, t, f in b if (i, p) == (j, q) and min(e, f) > max(s, t) and e > s and f > t)
    got = sorted(tuple(r[c] for c in ("item_id", "page_id", "start_a", "stop_a", "start_b", "stop_b")) for r in S.overlaps(fa, fb, ["item_id", "page_id"]).collect())
    assert got == want
    row = S.agreement(fa, fb).first()
    assert (row.agreeing, row.answerable) == (len({w[0] for w in want}), len({x[0] for x in a}))


def test_ties_and_reranking(spark):
    a = [("q", i, r, s) for r, (i, s) in enumerate([("x", 3.0), ("y", 2.0), ("z", 2.0), ("w", 2.0), ("v", 1.0)], 1)]
    base = spark.createDataFrame(a, "query_id string, id string, rank int, score double")
    check = lambda ids, k: S.same_up_to_ties(base, spark.createDataFrame([("q", i, r) for r, i in enumerate(ids, 1)], "query_id string, id string, rank int"), k).first().same
    assert check("xzw", 3) and check("xwzyv", 5) and check("xyzwv", 9)
    assert not check("zxy", 3) and not check("xzz", 3) and not check("xz", 3) and not check("xyv", 3)
    ranked = spark.createDataFrame([(1, "abc", d, r) for r, d in enumerate("pqr", 1)], "query_id int, query string, doc_id string, rank int")
    texts = spark.createDataFrame([("p", "a"), ("q", "abc"), ("r", "abc")], "doc_id string, text string")
    best = S.rerank_with(ranked, texts, lambda q, ts: [len(t) for t in ts], 2).orderBy("place").collect()
    assert [r.doc_id for r in best] == ["q", "r"]
    fails = S.rerank_with(ranked, texts, lambda q, ts: [][0], 2).orderBy("place").collect()
    assert [r.doc_id for r in fails] == ["p", "q"]


def test_temperature_and_noise_floor(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z / 2))).astype(int)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(z, y, strict=True)], "z double, y int")
    tau, loss = M.fit_temperature(rows, M.logit_nll(F.col("z"), F.col("y")))
    grid = np.exp(np.linspace(-3, 3, 6001))
    losses = [np.log1p(np.exp(-np.where(y == 1, z, -z) / t)).mean() for t in grid]
    assert tau == pytest.approx(grid[int(np.argmin(losses))], rel=5e-3) and loss == pytest.approx(min(losses), abs=1e-7) and 1.7 < tau < 2.3
    conf = rng.integers(0, 101, 1500) / 100
    got = M.noise_floor(spark.createDataFrame([(float(c),) for c in conf], "conf double"), 10, 300).first()
    bins = np.maximum(np.ceil(conf * 10 - 1e-9).astype(int), 1) - 1
    values = []
    for _ in range(300):
        hit = rng.random(len(conf)) < conf
        values.append(sum(abs((hit[bins == b] - conf[bins == b]).sum()) for b in range(10)) / len(conf))
    assert got.mean == pytest.approx(np.mean(values), rel=0.08) and got.p95 == pytest.approx(np.percentile(values, 95), rel=0.12)


def test_silhouette(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.5, (15, 2)) for c in ((0, 0), (4, 0), (0, 4))] + [[[9.0, 9.0]]])
    labels = [0] * 15 + [1] * 15 + [2] * 15 + [3]
    rows = spark.createDataFrame([(i, [float(x) for x in p], k) for i, (p, k) in enumerate(zip(points, labels, strict=True))], "key int, vector array<double>, label int")
    want = []
    for i, p in enumerate(points):
        d = np.linalg.norm(points - p, axis=1)
        own = [j for j, k in enumerate(labels) if k == labels[i] and j != i]
        if not own:
            want.append(0.0)
            continue
        a, b = d[own].mean(), min(d[[j for j, k in enumerate(labels) if k == c]].mean() for c in {*labels} - {labels[i]})
        want.append((b - a) / max(a, b))
    assert M.silhouette(rows, F.lit(True)).first().silhouette == pytest.approx(np.mean(want))
    assert M.choose_k(rows, F.lit(True), range(2, 5))[0][0] in (3, 4)
    names = spark.createDataFrame([(0, -1.0, 1.0, 1.0), (1, -1.0, 0.9, 0.9), (2, 1.0, -1.0, -1.0), (3, 1.0, 1.0, 0.0), (4, -0.1, -1.0, 0.0)], "cluster int, r double, f double, m double")
    assert {r.cluster: r.name for r in M.name_segments(names).collect()} == {0: "Champions", 1: "Champions (2)", 2: "Lost", 3: "At risk", 4: "New or promising"}


def test_silhouettes_of_several_labels_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "QUERIES", 7)
    monkeypatch.setattr(M, "ROWS", 11)
    monkeypatch.setattr(M, "TILE", (3, 5))
    rng = np.random.default_rng(4)
    points, labels = rng.normal(size=(60, 3)), [[i % 3 for i in range(60)], [i * i % 4 for i in range(60)]]
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    rows = spark.createDataFrame([(i, p.tolist(), labels[0][i], labels[1][i]) for i, p in enumerate(points)], "key int, vector array<double>, l0 int, l1 int")
    got = M.silhouettes(rows, F.col("key") % 2 == 0, ["l0", "l1"])
    for of, value in zip(labels, got, strict=True):
        of, want = np.array(of), []
        for i in range(0, 60, 2):
            a = d[i, of == of[i]].sum() / ((of == of[i]).sum() - 1)
            b = min(d[i, of == c].mean() for c in set(of.tolist()) - {int(of[i])})
            want.append((b - a) / max(a, b))
        assert value == pytest.approx(np.mean(want))
    assert M.silhouettes(rows.limit(0), F.lit(True), ["l0"]) == [None]


def test_generation(spark):
    table = [("a", "b", 0.9), ("a", ".", 0.1), ("b", "a", 0.5), ("b", ".", 0.5), ("c", "d", 1.0)]
    bigrams = spark.createDataFrame(table, "prev string, term string, p double")
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "zz")], "prompt_id int, prev string")
    got = {r.prompt_id: (r.text, round(r.log_p, 6)) for r in G.beam_search(prompts, bigrams, 3, 4).collect()}
    assert got == {1: ("b .", round(float(np.log(0.45)), 6)), 2: ("a b .", round(float(np.log(0.225)), 6)), 3: ("d", 0.0), 4: ("", 0.0)}
    drawn = G.generate(prompts, bigrams, 3, 1.0, "s").collect()
    nexts = {(a, b) for a, b, _ in table}
    for r in drawn:
        words = [dict(enumerate("abc", 1)).get(r.prompt_id, "zz"), *r.text.split()]
        assert all(pair in nexts for pair in zip(words, words[1:], strict=False))
    many = spark.range(4000).select(F.col("id"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("item")).withColumn("z", F.when(F.col("item") == "x", 2.0).otherwise(0.0))
    share = G.sample_with_temperature(many, "id", "item", F.col("z"), 2.0, "s").filter("item = 'x'").count() / 4000
    assert share == pytest.approx(1 / (1 + np.exp(-1)), abs=0.03)
    steps = spark.createDataFrame([(0, "^", "a", 0.25), (0, "^", "b", 0.75), (1, "a", "a", 1.0), (1, "b", "a", 0.5), (1, "b", "b", 0.5)], "t int, prev string, term string, p double")
    target = spark.createDataFrame([(0, "a"), (1, "a")], "t int, term string")
    assert G.expected_return(steps, target, "^").first().expected == pytest.approx((0.25 + 0.625) / 2)


def test_allocation_and_statuses(spark):
    slots = lambda strata, n: {(r.source, r.kind): r.slots for r in K.allocate_slots(spark.createDataFrame(strata, "source string, kind string, size long"), n).collect()}
    assert slots([("a", "x", 90), ("a", "y", 9), ("b", "x", 1)], 10) == {("a", "x"): 8, ("a", "y"): 1, ("b", "x"): 1}
    assert slots([("a", "x", 2), ("b", "x", 3)], 99) == {("a", "x"): 2, ("b", "x"): 3}
    assert slots([("a", "x", 2)], 0) == {("a", "x"): 0} and slots([], 5) == {}
    rows = spark.createDataFrame([("pass", False, 0), ("pass", True, 0), ("fail", False, 0), (None, None, 0), ("pass", None, 9)], "s string, t boolean, age int")
    day = F.lit("2026-03-10").cast("date")
    why = rows.select(K.lab_blocker(F.col("s"), F.col("t"), F.date_sub(day, F.col("age")), day, 5).alias("w"), K.passed(F.col("s"), F.col("t")).alias("p")).collect()
    assert [(r.w, r.p) for r in why] == [(None, True), ("stale", False), ("failed", False), ("none", False), ("old", True)]
    assert rows.select(K.with_staleness(F.lit("x"), F.lit(None).cast("string"), True).alias("x")).first().x is True


def test_blocks_keep_their_best_documents(spark, monkeypatch):
    monkeypatch.setattr(O, "RANKED", 8)
    monkeypatch.setattr(O, "ASKED", 2)
    rows = [(d, w, 1) for d in range(60) for w in [f"w{d % 7}", f"w{d % 7}", f"w{d % 3}", "all", f"own{d // 2}"]]
    terms = spark.createDataFrame(rows, "doc_id int, term string, tf int")
    lengths = spark.createDataFrame([(d, 5) for d in range(60)] + [(60, 0), (7, 9)], "doc_id int, n_terms int")  # doc_id 7 twice
    queries = spark.createDataFrame([(q, w) for q in range(5) for w in (f"w{q}", f"own{q}", "all", "none")], "query_id int, term string")
    rounded = lambda x: x.withColumn("score", F.round("score", 6))
    every = O.bm25(terms.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")), queries, lengths)
    found = O.bm25_best(terms, queries, lengths, 3)
    want = {tuple(r) for r in O.top_k(rounded(every), 3, "query_id").select("query_id", "doc_id", "rank", "score").collect()}
    assert {tuple(r) for r in O.top_k(rounded(found), 3, "query_id").select("query_id", "doc_id", "rank", "score").collect()} == want and len(want) == 15
    assert found.count() < every.count()
    assert O.bm25_best(terms, queries.limit(0), lengths, 3).count() == 0


def _macro_f1(pairs) -> float:
    classes = {c for pair in pairs for c in pair}
    return float(np.mean([2 * sum(y == p == c for y, p in pairs) / sum((y == c) + (p == c) for y, p in pairs) for c in classes]))


def test_macro_f1s_of_several_predictions(spark):
    rng = random.Random(5)
    # Class 4 is never true and never predicted, 3 is only predicted, 2 is never predicted by the second.
    rows = [(float(rng.choice([0, 0, 1, 2])), float(rng.randint(0, 3)), float(rng.randint(0, 1))) for _ in range(200)]
    frame = spark.createDataFrame(rows, "y double, a double, b double")
    want = [_macro_f1([(y, a) for y, a, _ in rows]), _macro_f1([(y, b) for y, _, b in rows])]
    assert M.macro_f1s(frame, "y", ["a", "b"]) == pytest.approx(want, abs=1e-12)
    assert all(np.isnan(M.macro_f1s(frame.limit(0), "y", ["a", "b"])))


def test_logistic_regression_reads_a_text_once(spark):
    rng = random.Random(8)
    words = {"de": "der die und nicht ein auto", "en": "the and not one car auto", "fr": "le la et pas une auto"}
    make = lambda n, langs: [(" ".join(rng.choices(words[x].split() + ["auto", "radio"], k=rng.randint(1, 5))), x) for x in rng.choices(langs, k=n)]
    train, held = make(120, ["de", "en", "en", "fr"]), make(40, ["de", "en"])
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    # No held text is French, and one is in a language that was not learned: it is skipped unread.
    frames = [spark.createDataFrame(rows, "text string, lang string").select(seen("text").alias("text"), "lang") for rows in (train, [*held, ("il gatto", "it")])]
    (features, model), ridge, f1 = M.logistic_regression(*frames, (0.01, 50.0), label="lang", dims=64)
    assert read.value == len(train) + len(held)
    rows = model.transform(features.transform(frames[1])).select("_y", "prediction").collect()
    assert len(rows) == len(held) and f1 == pytest.approx(_macro_f1([tuple(r) for r in rows]), abs=1e-12)
    assert ridge == 0.01 and f1 > 0.5
