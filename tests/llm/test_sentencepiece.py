import hashlib
import random

import pytest
import sentencepiece

from textmill.llm import sentencepiece_bpe as S
from textmill.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as file:
        return S.PieceModel(file.read()), sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(1)
    letters = "aaab  ▁▁\n\tthe re in é日本😀x0019#$%​\x00.,"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    out += [c * n for c in ("a", " ", "=", "ab", "▁") for n in (1, 2, 3, 7, 16, 17, 33, 64)]
    return out + ["", "a" * 5000, " " * 5000, "thethethe" * 700, "日" * 4500 + " x", "".join(rng.choice(letters.strip()) for _ in range(30_000)).replace(" ", ""), "".join(rng.choice("abcdefghijklmnop") for _ in range(60_000))]


def test_encode_and_decode_equal_the_library(both):
    model, library = both
    some = texts()
    ids = model.encode(some)
    assert ids == library.encode(some, num_threads=1)
    assert [model.decode(x) for x in ids] == library.decode(ids)


def test_decode_of_any_ids(both):
    model, library = both
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.randint(0, 300) if rng.random() < 0.7 else rng.randint(0, 31999) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_operator(spark, both):
    _, library = both
    rows = [(i, t, 5) for i, t in enumerate([*texts()[:200], None])] + [(0, "twice", 1), (0, "twice", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = S.sentencepiece(docs, PATH).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), ids, library.decode(ids)))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded) for r in got) == sorted(want)
    assert S.sentencepiece(docs.limit(0), PATH).count() == 0
