import hashlib
import random
import re

import numpy as np
import pytest

from textmill.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        for k in range(len(words) - window + 1 if doc is not None else 0):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for k in range(len(words) - window + 1 if doc is not None else 0):
            if first[tuple(words[k : k + window])] < doc:
                gone |= set(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        edges = sorted(k for k in gone if k - 1 not in gone), sorted(k + 1 for k in gone if k + 1 not in gone)
        out.append((doc if doc is not None else -1, len(words), len(gone), tuple(zip(*edges, strict=True)), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, tuple((i.start, i.stop) for i in r.intervals), r.kept_sha256) for r in df.collect())


def sample(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400)) + rng.choice(["", "é", "日", "."])
    passages = [[word() for _ in range(rng.randint(50, 90))] for _ in range(4)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            p = rng.choice(passages)
            words[at:at] = p[: rng.randint(45, len(p))]
        rows.append([3 * i, "".join(w + rng.choice([" ", "\n", "\t ", "\x0b"]) for w in words)])
    rows += [[500 + k, rows[k][1]] for k in range(0, 40, 3)]  # copies
    rows += [[600 + k, rows[k][1].replace("\n", "  ")] for k in range(0, 20, 3)]  # copies but for white space
    rows += [[700, " ".join(passages[0]) * 1], [701, " ".join(passages[0]).upper()], [702, " ".join(["same"] * 400)], [703, " ".join(["same"] * 90 + ["end"])], [704, "same " * 300]]
    rows += [[710, rows[1][1]], [710, rows[1][1]], [710, rows[2][1]], [0, rows[1][1]], [None, rows[1][1]], [None, None], [711, None], [712, ""], [713, " \n"]]
    rng.shuffle(rows)
    return [tuple(r) for r in rows]


@pytest.mark.parametrize(("seed", "window", "together"), [(1, 50, 4_000_000), (2, 50, 300), (3, 7, 50)])
def test_equals_brute_force(spark, monkeypatch, seed, window, together):
    monkeypatch.setattr(S, "TOGETHER", together)
    rows = sample(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, n_words int").repartition(5)
    assert found(S.shared_passages(docs, window)) == brute(rows, window)


def test_a_hot_passage_and_a_hot_copy(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{rng.random()} {passage} {rng.random()}" if k % 3 == 0 else passage + " x" if k % 3 == 1 else " ".join(f"{k}w{i}" for i in range(55))) for k in range(1500)]
    assert found(S.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == brute(rows, 50)


def test_long_text_and_empty_table(spark):
    words = [f"w{k}" for k in range(200_000)]
    rows = [(1, " ".join(words[1000:1100])), (2, " ".join(words)), (3, "x " + " ".join(words[150_000:]))]
    got = found(S.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 0, ()), (2, 100, ((1000, 1100),)), (3, 50_000, ((1, 50_001),))]
    assert S.shared_passages(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).collect() == []


def test_anchor_is_the_least_hash_of_a_windows_grams():
    h = np.random.default_rng(0).integers(0, 1 << 63, 200).astype(np.uint64)
    for window, gram in ((50, 20), (7, 7), (9, 2), (33, 1), (50, 1)):
        grams = S.rolled(h, gram)
        want = [grams[k : k + window - gram + 1].min() for k in range(len(h) - window + 1)]
        assert S.anchors(h, window, gram).tolist() == want
    assert len(S.anchors(h[:5], 50, 20)) == 0
