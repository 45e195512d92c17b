import random
import re
from collections import Counter

import numpy as np

from textmill.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(words, n, first):
    grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
    count, seen, out = Counter(grams), set(), set()
    for k, g in enumerate(grams):
        if (first and count[g] > 1) or (not first and g in seen):
            out.update(range(k, k + n))
        seen.add(g)
    return out


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    repeat = len(covered(words, 8, True))
    chars = sum(map(len, words))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    share = {n: sum(len(words[k]) for k in covered(words, n, False)) / max(1, chars) for n in Q.MAX_NGRAM_SHARE}
    line = (len(lines) - len(set(lines))) / max(1, len(lines))
    line_chars = (sum(map(len, lines)) - sum(map(len, set(lines)))) / max(1, sum(map(len, lines)))
    kept = not failed and line <= 0.3 and line_chars <= 0.2 and all(share[n] <= m for n, m in Q.MAX_NGRAM_SHARE.items())
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return (len(words), chars, symbols, len(lines) - len(set(lines)), repeat, failed, kept, *share.values())


def texts():
    rng = random.Random(4)
    out = [None, "", "one", " \n\t", "x\ny\nx\n \nx", "a b c d e f g h " * 9]
    out += [" ".join(rng.choice("abc#") for _ in range(rng.randint(0, 70))) for _ in range(120)]
    out += ["".join(rng.choice("ab \n\x0b") for _ in range(200)) for _ in range(60)]
    words = [f"w{i}" for i in range(400)]
    return out + [" ".join(rng.choice(words) for _ in range(300)) for _ in range(5)] + ["long " + " ".join(rng.choice(words) for _ in range(30_000))]


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"dup_{n}gram_share" for n in Q.MAX_NGRAM_SHARE)]


def test_operator_equals_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(1, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in Q.quality(docs).collect())
    want = sorted((i, *brute(t)) for i, t, _ in rows)
    for g, w in zip(got, want, strict=True):
        assert g[:8] == w[:8] and np.allclose(g[8:], w[8:])
    assert Q.quality(docs.limit(0)).count() == 0


def test_hash_clashes_are_resolved():
    """All hashes equal: the words themselves decide."""
    words = np.array([1, 2, 1, 2, 3, 1, 2], np.int64)
    at = np.arange(6)
    again, before = Q._repeats(np.zeros(6, np.uint64), at, words, np.zeros(7, np.int64), 2)
    assert again.tolist() == [True, False, True, False, False, True]
    assert before.tolist() == [False, False, True, False, False, True]
