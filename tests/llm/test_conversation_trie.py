import hashlib
import random
import zlib

import pytest

from textmill.llm import conversation_trie as T


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            key = (role or "", text or "")
            digest = hashlib.sha256(f"{len(key[0])}:{key[0]}{key[1]}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, digest), key))
    own = {c: [k for _, k in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(own.get(first, [])[:h] + turns[h:])
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(p))))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((len(p), min(members), parent, len(members), len(children.get(p, [])), sum(q not in children for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    names = ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def sample(seed, convs, first=0):
    rng = random.Random(seed)
    rows = []
    for c in range(first, first + convs):
        if rng.random() < 0.8:
            for t in range(rng.choice([1, 2, 3, 9, 14])):
                rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(["", None, "a", "bé", "a", "hello there"])))
    rows += rows[::7] + [(None, 1, "user", "no id"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "first", "parts"), [(1, 0, 4), (2, -30, 7)])
def test_equals_brute_force(spark, seed, first, parts):
    rows = sample(seed, 60, first)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, x string").repartition(3)
    assert found(T.prefix_trie(df, parts)) == brute(rows)


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(T, "IDS", 3)
    rows = [(7, t, "user", f"turn {t}") for t in range(150)] + [(c, t, "user", "same") for c in range(10, 90) for t in range(2)]
    rows += [(c, 0, None, None) for c in range(100, 105)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert found(T.prefix_trie(df, 6)) == brute(rows)
    pieces = T.ordered_turns(df, 6).filter("conv_id = 7")
    assert pieces.select("piece").distinct().count() > 1  # dealt over several tasks
    assert sorted(r.pos for r in pieces.collect()) == list(range(1, 151))


def test_empty_table(spark):
    assert T.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
