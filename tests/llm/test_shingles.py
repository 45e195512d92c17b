import random
import re

import numpy as np
import pyarrow as pa
import pytest

from textmill.llm.shingles import shingle_sets

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(text):
    words = [w.lower() for w in WORD.findall((text or "").encode())]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.parametrize("block", [1 << 20, 64, 7])
def test_sets_are_those_of_the_words(block):
    rng = random.Random(1)
    texts = [None, "", "  ", "a", "A b", "a b c d", "a b c d e", " a b c d e f\n", "é x\x0bq 日本 w e r", "x" * 5000 + " y z", "q " * 3000]
    texts += ["".join(rng.choice("ab CD\n\té") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    hashes, words = {}, {}
    for column in (pa.array(texts), pa.array([None, "zz", *texts]).slice(2), pa.array(texts, pa.large_string())):
        seen = 0
        for start, stop, sets in shingle_sets(column, block):
            assert start == seen
            seen = stop
            for text, found in zip(texts[start:stop], sets, strict=True):
                want = brute(text)
                assert len(found) == len(want) and (np.diff(found.astype(object)) > 0).all()
                assert hashes.setdefault(want, found.tobytes()) == found.tobytes()
                assert words.setdefault(found.tobytes(), want) == want
        assert seen == len(texts)
