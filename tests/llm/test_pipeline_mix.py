"""The mix that the pipeline's result shows, against a plain Pfair schedule."""

import hashlib
from collections import defaultdict

import corpus_pipeline as P


def plain_pfair(rows, alpha=0.7, quanta=1000, block=8, buckets=1024):
    """(doc_ids in the order of the mix, number of them before the first missing block) for (doc_id, source) rows."""
    of = defaultdict(list)
    for i, s in rows:
        h = hashlib.md5(str(i).encode()).hexdigest()
        of[s].append((int(h[:4], 16) % buckets, h, i))
    names = sorted(of)
    w = {s: len(of[s]) ** alpha for s in names}
    share = {s: (quanta - len(names)) * w[s] / sum(w.values()) for s in names}
    q = {s: 1 + int(share[s]) for s in names}
    for s in sorted(names, key=lambda s: (-round(share[s] % 1, 9), s))[: quanta - sum(q.values())]:
        q[s] += 1
    left = {s: [i for *_, i in sorted(of[s])] for s in names}
    done, order, stretch, slot = dict.fromkeys(names, 0), [], None, 0
    while any(left.values()):
        ready = [s for s in names if done[s] * quanta // q[s] <= slot]
        if ready:
            s = min(ready, key=lambda s: (-(-(done[s] + 1) * quanta // q[s]), s))
            done[s] += 1
            if not left[s] and stretch is None:
                stretch = len(order)
            order += left[s][:block]
            del left[s][:block]
        slot += 1
    return order, len(order) if stretch is None else stretch


def test_result_has_the_place_of_every_row_in_the_mix(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame([(i, f"text {i}", "en", s, 9) for i, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for sample in (rows, rows[:0]):
        kept = docs.limit(len(sample))
        stages = dict(P.STAGES)
        mixed = P.materialize(stages["source_mix"](spark, kept, ""), "mix")
        final = stages["sentencepiece"](spark, mixed, "").collect()
        want, stretch = plain_pfair(sample)
        assert sorted(r.mix_position for r in final) == list(range(len(sample)))
        assert [r.doc_id for r in sorted(final, key=lambda r: r.mix_position)] == want
        assert all(r.in_mix == (r.mix_position < stretch) for r in final)
    source = dict(rows)
    want, stretch = plain_pfair(rows)
    assert 0 < stretch < len(rows)
    share = sum(source[i] == "hot" for i in want[:stretch]) / stretch
    assert share < 1 / 3 - 0.02  # the weight of the mix, not the share in the input
