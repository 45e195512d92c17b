import hashlib
import random

import pytest

from textmill.llm import exact_dedup as D


def brute(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    return sorted(
        (i, hashlib.sha256((t or "").encode()).hexdigest(), max(texts[t or ""]), len(texts[t or ""]), i == max(texts[t or ""])) for i, t in rows
    )


def sample(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab c.\n") for _ in range(rng.randint(1, 40))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "x" * 30_000), (203, "x" * 30_000), (204, "x" * 29_999)]


@pytest.mark.parametrize("bits", [64, 3])  # three bits: nearly every fingerprint stands for several contents
def test_groups_equal_brute_force(spark, bits):
    rows = sample(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.exact_groups(docs, min_chars=8, max_chars=32, bits=bits).collect()
    assert sorted((r.doc_id, r.text_sha256, r.keep_id, r.group_size, r.kept) for r in got) == brute(rows)


def test_chunks_join_to_the_text(spark):
    rows = [r for r in sample(3) if r[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in docs.select("text", D.chunks(docs.text, 8, 32).alias("c")).collect():
        assert "".join(r.c) == r.text and all(len(c) <= 33 for c in r.c)


def test_clashing_columns_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", 9, "z"), (1, "a", 9, "z"), (2, "b", 8, "y"), (3, "a", 7, "x")], "doc_id long, text string, keep_id int, text_sha256 string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in D.exact_groups(docs).collect()}
    assert got == {(1, 3, 3, False), (2, 2, 1, True), (3, 3, 3, True)}
    kept = D.deduplicate(docs.unionByName(docs.filter("doc_id = 2")))
    assert sorted((r.doc_id, r.keep_id) for r in kept.collect()) == [(2, 8), (3, 7)]
    assert D.exact_groups(docs.limit(0)).count() == 0
