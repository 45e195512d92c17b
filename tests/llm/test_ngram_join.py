import random
import re

import numpy as np
import pytest

from textmill.llm import ngram_join as J
from textmill.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def sample(seed, groups, copies, words=60):
    """Groups of near copies at distances around the limit, a passage that all share, exact copies, short and blank texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage = " ".join(word() for _ in range(25))
    texts = [None, "", " \n", "one", "One", "one two", "a b c d", "A b c d", "a b c d e", "a b c d e f g h", passage, passage]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(words // 2, words))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[: rng.randint(len(copy) - 12, len(copy))]
            texts.append(" ".join(copy) + (f" {passage}" if rng.random() < 0.2 else ""))
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("short", "frequent", "members"), [(64, 20, 1000), (2, 1, 4)])  # the second: nearly all lists are long
def test_components_equal_brute_force(spark, monkeypatch, short, frequent, members):
    monkeypatch.setattr(J, "SHORT_LIST", short)
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "MEMBERS", members)
    monkeypatch.setattr(J, "PARTNERS", members)
    rows = sample(5, 12, 9)
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, n int, component_id int")
    got = J.jaccard_components(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    kept = sorted(r.doc_id for r in J.one_of_each(docs).collect())
    assert kept == sorted({c for _, _, c in brute(rows)})


def test_empty_table_repeats_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert J.jaccard_components(docs.limit(0)).count() == 0
    assert J.one_of_each(docs.limit(0)).count() == 0
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()) == [(1, 2, 1), (1, 2, 1), (2, 0, 2)]
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words), " ".join(words[:56]), " ".join(words[:52])]  # the middle one holds the ends together
    rows = [(1, chain[0], "x"), (None, chain[1], "y"), (3, chain[2], "z"), (None, "w1 " * 9, "q"), (None, None, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()}
    assert got == {(1, 56, 1), (None, 52, 1), (3, 48, 1), (None, 1, None), (None, 0, None)}
    assert sorted((r.doc_id or 0, r.node) for r in J.one_of_each(docs).collect()) == [(0, "q"), (0, "r"), (0, "y"), (1, "x")]


def test_links_equal_brute_force(spark):
    rows = sample(8, 6, 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links, membership = J.jaccard_links(docs)
    sets = {k: frozenset(shingles(t)) for k, t in rows}
    least = {}
    for k, s in sorted(sets.items(), reverse=True):
        least[s] = k
    want = set()
    for s, a in least.items():
        for t, b in least.items():
            if a < b and s and 100 * len(s & t) >= 75 * len(s | t):
                want.add((a, b, len(s), len(t), len(s & t)))
    assert {tuple(sorted(((r.a, r.n_a), (r.b, r.n_b)))) + (r.shared,) for r in links.collect()} == {((a, n), (b, m), x) for a, b, n, m, x in want}
    assert {(r.doc_id, r.class_id, r.n_shingles) for r in membership.collect()} == {(k, least[s] if s else None, len(s)) for k, s in sets.items()}


def templates(n):
    """Texts that share 160 of 196 words, alike to just under the limit."""
    shared = [f"s{i}" for i in range(160)]
    return [(i, " ".join(shared + [f"u{i}x{k}" for k in range(36)])) for i in range(n)]


def test_templates_below_the_limit_give_few_candidates(spark):
    for n in (100, 500):
        docs = spark.createDataFrame(templates(n), "doc_id long, text string").coalesce(2).select("doc_id", "text")
        _, _, pairs, members, _, _ = J._candidates(docs, None)
        assert pairs.count() + members.count() <= n
    assert all(r.component_id == r.doc_id for r in J.jaccard_components(docs).collect())


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy[rng.randrange(120)] = f"x{rng.randint(0, 9999)}"
        rows.append((i, " ".join(copy)))
    rows.append((900, "very " * 50 + "long " * 50_000 + " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = J.jaccard_components(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_sketches_never_miss_a_link():
    rng = np.random.default_rng(4)
    for n in (3, 40, 700, 9000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, n // 8).astype(np.uint64)]))
        x, y = J.from_sketch(J.sketch(a)), J.from_sketch(J.sketch(b))
        assert (x == (a >> np.uint64(40))).all() and len(y) == len(b)
        true = len(np.intersect1d(a, b))
        assert true <= J.common(x, y) <= true + J.most_chance(len(a), len(b))
    assert J.most_chance(60, 60) < 6 < J.most_chance(20_000, 20_000) < 100


def test_linked_sets_meet_with_room():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(600):
        n = int(rng.integers(3, 90))
        a = np.unique(rng.integers(1, 1 << 62, n)).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(1, 1 << 62, rng.integers(0, 5)).astype(np.uint64)]))
        often = np.unique(rng.choice(a, len(a) // 2))
        for order in (J.NO_ORDER, J.Order(often, rng.permutation(len(often)).astype(np.int32))):
            shared = len(np.intersect1d(a, b))
            if J.linked(shared, len(a), len(b)) and len(np.setxor1d(a, b)):
                met += 1
                for boundary in (2, 8, 24, 64):
                    (ka, pa), (kb, pb) = J.keys_of(a, order, boundary), J.keys_of(b, order, boundary)
                    _, i, j = np.intersect1d(ka, kb, return_indices=True)
                    assert J.room(len(a), pa[i], len(b), pb[j]).any()
    assert met > 100


def test_connected_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_parity_sketches_never_part_linked_sets(spark):
    rng = np.random.default_rng(0)
    rows, far = [], 0
    for n in (3, 50, 196, 900, 3000):
        for edits in range(0, n, max(1, n // 25)):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            b = np.concatenate([a[edits:], rng.integers(0, 1 << 62, edits).astype(np.uint64)])
            rows.append((n, J.parity(a).tolist(), n, J.parity(b).tolist(), bool(J.linked(n - edits, n, n)), edits))
    got = spark.createDataFrame(rows, "a long, pa array<long>, b long, pb array<long>, linked boolean, edits int").withColumn("near", J.near(J.F.col("a"), J.F.col("pa"), J.F.col("b"), J.F.col("pb"))).collect()
    assert all(r.near for r in got if r.linked)
    far = [r.near for r in got if not r.linked and r.a <= 900 and r.edits > 0.3 * r.a and r.a > 3]
    assert sum(far) < 0.1 * len(far)


def test_pairs_of_alike_texts_without_links_grow_with_their_number(spark, monkeypatch):
    base = [f"b{k}" for k in range(200)]

    def compared(n):
        rng, rows, seen = random.Random(n), [], []
        for k in range(n):
            words = list(base)
            for at in rng.sample(range(200), 6):
                words[at] = f"x{rng.random()}"
            rows.append((k, " ".join(words)))
        meet = J._meet
        monkeypatch.setattr(J, "_meet", lambda pairs, *rest, **more: seen.append(pairs.count()) or meet(pairs, *rest, **more))
        got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert sorted(map(tuple, got.collect())) == (brute(rows) if n <= 300 else sorted(map(tuple, got.collect())))
        monkeypatch.setattr(J, "_meet", meet)
        return sum(seen)

    few, many = compared(300), compared(1200)
    assert many <= 6 * few, (few, many)
