import hashlib
import math
import random

import pytest

from textmill.llm import vector_codes as V


def brute(rows, parts, entries, rounds):
    kept = [(k, label, [math.floor(256 * x) for x in v]) for k, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(ordered[0][2])
    kept = [r for r in kept if len(r[2]) == width]
    step = width // parts
    cut = lambda q, p: q[p * step : (p + 1) * step]
    books = [[cut(r[2], p) for r in ordered[:entries] if len(r[2]) == width] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda q, p: min(range(len(books[p])), key=lambda e: (far(cut(q, p), books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for _, _, q in kept:
                groups.setdefault(assign(q, p), []).append(cut(q, p))
            new.append([[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [[k, "".join(f"{assign(q, p):02x}" for p in range(parts)), sum(far(cut(q, p), books[p][assign(q, p)]) for p in range(parts)), label] for k, label, q in kept]
    sums = {}
    for r in out:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    return sorted(((r[0], r[1], r[2], sums[r[3]], digest) for r in out), key=str)


def found(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, q int"


@pytest.mark.parametrize(("seed", "parts", "entries", "rounds", "spread"), [(1, 16, 64, 2, 1.0), (2, 4, 5, 3, 0.004), (3, 2, 200, 1, 1.0)])
def test_equals_brute_force(spark, monkeypatch, seed, parts, entries, rounds, spread):
    monkeypatch.setattr(V, "BLOCK", 7)
    rng = random.Random(seed)
    rows = [(3 * k, [rng.gauss(0, spread) for _ in range(32)], rng.choice([None, 1, 2, 2, 2])) for k in range(150)]
    rows += [(900 + k, rows[k % 5][1], 1) for k in range(70)]  # one vector many times
    rows += [(1, None, 1), (2, [], 1), (4, [1.0] * 31 + [None], 1), (5, [1.0] * 31 + [float("nan")], 2), (7, [float("-inf")] + [0.0] * 31, 2), (8, [1.0] * 16, 1)]
    rows += [(9, [0.0] * 32, None), (9, [-0.5] * 32, 2), (None, [0.25] * 32, None), (None, [0.25] * 32, None)]
    rng.shuffle(rows)
    as_float = [(k, None if v is None else [None if x is None else float(V.np.float32(x)) for x in v], label) for k, v, label in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    assert found(V.compress(df, parts, entries, rounds)) == brute(as_float, parts, entries, rounds)


def test_empty_short_and_unfit(spark):
    frame = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert V.compress(frame([])).collect() == []
    assert V.compress(frame([(1, None, 1), (2, [float("nan")] * 16, 1)])).collect() == []
    got = found(V.compress(frame([(2, [0.5] * 16, 3)])))
    assert got == brute([(2, [0.5] * 16, 3)], 16, 64, 2) and got[0][1:4] == ("00" * 16, 0, 0)
    with pytest.raises(ValueError, match="equal parts"):
        V.compress(frame([(1, [0.5] * 17, 1)]))
    with pytest.raises(Exception, match="131072 or more"):
        V.compress(frame([(1, [1e30] * 16, 1)])).collect()
