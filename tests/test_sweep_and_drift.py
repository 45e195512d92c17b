import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textmill.functions.stem import stem
from textmill.operators import divergence, sweep
from textmill.operators import retrieval as R
from textmill.plans import catalogue as registry
from textmill.plans.retrieval_queries import ENGLISH_STOP, bm25_stem


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "delta", "x1", "is", "of", "running", "İron", "zeta"])
    return [" ".join(" ".join(word() for _ in range(rng.randint(1, 12))).capitalize() + rng.choice([".", "!", ""]) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_sweep_equals_a_plain_count(spark):
    rng = random.Random(1)
    docs = {i: t for i, t in enumerate(texts(3, 12))} | {50: None, 51: "... !!!"}
    queries = {1: {"alpha", "x1"}, 2: {"gamma", "zeta"}, 3: {"nowhere"}, 4: {"beta"}}
    evidence = [(q, g, d, a, a + 20) for q in (1, 2, 3) for g in range(2) for d in rng.sample(range(12), 2) for a in [rng.randint(0, 60)]]
    frame = spark.createDataFrame(list(docs.items()), "doc_id int, text string").repartition(3)
    chunks = sweep.chunk_terms(frame, [8, 20])
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id int, term string")
    spans = spark.createDataFrame(evidence, "query_id int, group int, doc_id int, start int, stop int")
    got = {(r.size, r.k): (r.questions, r.recall, r.mrr) for r in sweep.sweep(sweep.ranked_chunks(chunks, asked, 4), spans, 4).collect()}
    for size in (8, 20):
        parts = [(d, no, a, z, Counter(re.findall("[a-z0-9]+", "".join(c.lower() if len(c.lower()) == 1 else c for c in t)[a:z]))) for d, t in docs.items() for no, (a, z, _) in enumerate(R.sentence_chunks(t or "", size, size // 8))]
        n, mean = len(parts), sum(sum(c.values()) for *_, c in parts) / len(parts)
        df = Counter(t for *_, c in parts for t in c)
        ranked = {}
        for q, terms in queries.items():
            score = lambda c, terms=terms: round(sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in terms if c[t]), 6)
            ranked[q] = [p for p in sorted(parts, key=lambda p: (-score(p[4]), p[0], p[1])) if score(p[4])][:4]  # noqa: B023
        for k in range(1, 5):
            recall, mrr = [], []
            for q in (1, 2, 3):
                covers = lambda p, e: p[0] == e[2] and 2 * (min(p[3], e[4]) - max(p[2], e[3])) >= e[4] - e[3]
                top = ranked[q][:k]
                groups = [[e for e in evidence if e[0] == q and e[1] == g] for g in range(2)]
                recall.append(sum(any(covers(p, e) for p in top for e in g) for g in groups) / 2)
                mrr.append(next((1 / r for r, p in enumerate(top, 1) if any(covers(p, e) for g in groups for e in g)), 0.0))
            assert got[size, k] == (3, pytest.approx(sum(recall) / 3, abs=1e-6), pytest.approx(sum(mrr) / 3, abs=1e-6))


def test_pieces_bound_what_a_task_turns_into_chunks():
    frame = pd.DataFrame({"doc_id": range(2000), "text": [None if i % 7 == 0 else "w " * (i % 50) for i in range(2000)]})
    frame.loc[500, "text"] = "x" * 5000
    parts = list(R.pieces([frame, frame.iloc[:0], frame.iloc[:3]], "text", 1000))
    assert [i for p in parts for i in p["doc_id"]] == [*range(2000), 0, 1, 2]
    sizes = [sum(len(x or "") for x in p["text"]) for p in parts]
    assert sorted(sizes)[-1] >= 5000 and sorted(sizes)[-2] <= 1000
    assert all(len(p) == 1 for p, n in zip(parts, sizes, strict=True) if n > 1000)


def test_containing_finds_items_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(R, "FEW_ITEMS", 3)
    docs = [(i, t) for i, t in enumerate(texts(7, 40))] + [(99, None), (98, "")]
    rng = random.Random(2)
    items = []
    for i in range(60):
        t = docs[rng.randrange(40)][1]
        a = rng.randint(0, max(0, len(t) - 1))
        items.append((i, t[a : a + rng.choice([1, 3, 8, 15, 30, 70])]))
    items += [(100, ""), (101, None), (102, "not there"), (103, "is"), (104, "is"), (105, " of "), (106, "alpha  beta")]
    got = R.containing(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string"), "item_id", "doc_id")
    want = sorted((i, d) for i, x in items if x for d, t in docs if t and x in t)
    assert sorted((r.item_id, r.doc_id) for r in got.collect()) == want


def test_sparse_divergence_equals_the_dense_formula(spark):
    rng = random.Random(3)
    vocabulary, k = 40, 0.5
    counts = [(w, f"t{t}", rng.randint(1, 9)) for w in (1, 2, 3, 7, 8) for t in rng.sample(range(vocabulary), 12)]
    frame = spark.createDataFrame(counts, "window int, term string, n int")
    size = spark.createDataFrame([(vocabulary,)], "size int")
    got = {r.window: r.kl for r in divergence.drift(frame, size, k).collect()}
    n = {(w, t): c for w, t, c in counts}

    def p(w):
        total = sum(c for (v, _), c in n.items() if v == w)
        return [(n.get((w, f"t{t}"), 0) + k) / (total + k * vocabulary) for t in range(vocabulary)]

    want = {w: sum(a * math.log(a / b) for a, b in zip(p(w), p(w - 1), strict=True)) for w in (2, 3, 8)}
    assert got == {w: pytest.approx(x, abs=1e-12) for w, x in want.items()}
    same = divergence.sparse_kl(frame, frame, size, k).agg(F.max(F.abs("kl")).alias("m")).first().m
    assert same == pytest.approx(0, abs=1e-12)


def test_bm25_over_stems(spark):
    docs = [(i, t) for i, t in enumerate(texts(9, 25))] + [(30, None), (31, "the of")]
    items = [(1, "The runs of alpha"), (2, "gammas zeta a"), (3, "of the")]
    tables = {"documents": spark.createDataFrame(docs, "doc_id int, text string"), "benchmark": spark.createDataFrame(items, "item_id int, text string")}
    got = {(r.query_id, r.doc_id): r.score for r in bm25_stem(tables.__getitem__).collect()}
    bag = lambda t: Counter(stem(w) for w in re.findall(r"\b\w\w+\b", (t or "").lower()) if w not in ENGLISH_STOP)
    bags = {d: bag(t) for d, t in docs}
    mean, df = sum(sum(b.values()) for b in bags.values()) / len(bags), Counter(t for b in bags.values() for t in b)
    for q, text in items:
        score = {d: sum(math.log((len(bags) - df[t] + 0.5) / (df[t] + 0.5) + 1) * b[t] / (b[t] + 1.5 * (0.25 + 0.75 * sum(b.values()) / mean)) for t in bag(text) if b[t]) for d, b in bags.items()}
        best = sorted((d for d in score if score[d]), key=lambda d: (-round(score[d], 6), d))[:10]
        assert {d for a, d in got if a == q} == set(best) and all(got[q, d] == pytest.approx(score[d], abs=2e-6) for d in best)


def test_best_chunks_make_no_row_for_each_term(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sweep, "BLOCK", 5)
    monkeypatch.setattr(sweep, "RANKED", 3)
    monkeypatch.setattr(sweep, "ASKED", 2)
    docs = [*enumerate(texts(11, 40)), (1 << 60, None), ((1 << 60) + 1, "... !!!"), ((1 << 60) + 3, "alpha beta. Zeta")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([("a", "alpha"), ("a", "x1"), ("b", "gamma"), ("b", "zeta"), ("c", "nowhere"), ("d", "beta"), ("e", "alpha")], "query_id string, term string")
    want = sweep.ranked_chunks(sweep.chunk_terms(frame, [8, 20]), asked, 4)
    found = sweep.best_chunks(frame, [8, 20], asked, 4)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.select(found.columns).collect()}
    assert found.count() == 2 * 4 * 4
    assert sweep.best_chunks(frame.limit(0), [8], asked, 4).collect() == sweep.best_chunks(frame, [8], asked.limit(0), 4).collect() == []
    # The query itself sends nothing of a text's terms but those that are asked.
    seen = []
    monkeypatch.setattr(sweep, "chunk_terms", lambda *a: seen.append(a))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta"), (2, "Zeta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert registry.QUERIES["chunk_recall"](spark, str(tmp_path)).count() == 30 and not seen
