import random
import zlib

import numpy as np

from textmill.llm import language_id as L
from textmill.llm import toxicity as X

SYLLABLES = {"aa": ["the", "ing", "er", "and", "ou"], "bb": ["sch", "ung", "ein", "keit", "ö"], "cc": ["ción", "que", "los", "ar", "ñ"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def kernel_by_definition(a, b, n, decay):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(a)), n):
        for j in combinations(range(len(b)), n):
            if all(a[x] == b[y] for x, y in zip(i, j, strict=True)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_equals_its_definition():
    pairs = [("idiot", "idiot"), ("idxiot", "idiot"), ("abcabc", "acb"), ("ab", "abc"), ("schlecht", "schlicht")]
    a, b = (X._codes([p[k] for p in pairs], 8) for k in (0, 1))
    want = [kernel_by_definition(x, y, 3, 0.8) for x, y in pairs]
    assert np.allclose(X.subsequence_kernel(a, b), want, rtol=1e-4)


def labelled(seed=3, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(rng, "aa", rng.randint(5, 80)).split()
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["blockhead", "numskull", "dimwit"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_held_out_and_gapped_insults(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in rows] + [(1000, None, "s", 0.1), (1001, "", "s", 0.2)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, None)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert got[1000].score == got[1001].score and 0 <= got[1000].score <= 1
    clean = prose(random.Random(9), "aa", 60)
    bent = "b.l.o.c.k.h.e.a.d numxskull d i m w i t"
    assert model.score([X.tokens_of(f"{clean} {bent}")], {})[0] > 0.5 > model.score([X.tokens_of(clean)], {})[0]
    kept = {r.doc_id for r in X.clean(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.5}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = X.score(docs, X.fit(docs, labels)).collect()
    assert len(got) == 2 and all(r.predicted == 0 for r in got)
    assert X.score(docs.limit(0), X.fit(docs, labels)).count() == 0


def test_language_held_out(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randint(5, 60)), lang) for i in range(300) for lang in [rng.choice([*SYLLABLES])]]
    odd = [(900, None, "aa"), (901, "", None), (902, "12 %% 34", "bb"), (903, rows[0][1] + " 77 !", None), (904, "x" * 200_000, None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id long, text string, lang string, score double")
    model = L.fit(docs)
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred == rows[0][2] and got[904].rejected
    assert L.training_sample(docs, texts=30, least=5).count() <= 30


def plain_vector(text, idf):
    """TF-IDF of hashed n-grams, one n-gram at a time."""
    import unicodedata

    code, last = [], None
    for c in f" {text.lower()} ":
        x = ord(c) if unicodedata.category(c)[0] == "L" else 0
        if x or last != 0:
            code.append(x)
        last = x
    v = np.zeros(L.DIMENSIONS)
    for n in L.LENGTHS:
        for i in range(len(code) - n + 1):
            h = 0
            for k, x in enumerate(code[i : i + n], 1):
                h = (h * 0x100000001B3 + x + k) % 2**64
            v[(h * 0x9E3779B97F4A7C15 % 2**64) >> 51] += 1
    v = np.log1p(v) * idf
    return v / max(np.linalg.norm(v), 1e-12)


def test_language_equals_a_plain_nearest_centroid():
    rng = random.Random(4)
    rows = [(prose(rng, lang, rng.randint(3, 40)), lang) for _ in range(120) for lang in [rng.choice([*SYLLABLES])]]
    model = L.CentroidModel.fit([t for t, _ in rows], [x for _, x in rows])
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5) and len(model.centroids) == L.CENTROIDS * 3
    texts = [prose(rng, rng.choice([*SYLLABLES]), rng.randint(0, 30)) + rng.choice(["", " 12", "\n\t!", " Ä"]) for _ in range(60)] + ["", "x", " é "]
    names, score, cosine, rejected = model.predict(texts)
    for text, name, s, c, r in zip(texts, names, score, cosine, rejected, strict=True):
        near = model.centroids @ plain_vector(text, model.idf)
        if not any(ch.isalpha() for ch in text):
            assert (name, s, c, r) == ("und", 0, 0, True)
            continue
        by = [max(near[model.owner == k]) for k in range(len(model.languages))]
        assert name == model.languages[int(np.argmax(by))] and abs(c - near.max()) < 1e-4
        assert abs(s - np.exp(L.SHARPNESS * max(by)) / np.exp(L.SHARPNESS * np.array(by)).sum()) < 1e-2
        assert r == (c < model.least[int(np.argmax(near))]) or abs(c - model.least[int(np.argmax(near))]) < 1e-5


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(i, f"abc def {chr(0x4E00 + i // 2)}", "aa" if i < 60 else f"x{i // 2}") for i in range(1300)], "doc_id long, text string, lang string")
    free = {r.lang for r in docs.filter(~L.held_out()).select("lang").distinct().collect()}
    assert len(free) > 500 and {r.lang for r in L.training_sample(docs).collect()} == free


def test_toxicity_odd_rows(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = X.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    odd = [(1, "plain " * 50_000 + "dimwit numskull blockhead"), (1, "dimwit numskull blockhead"), (1, "dimwit numskull blockhead"), (None, "dimwit numskull blockhead"), (2, "d" * 100_000)]
    frame = spark.createDataFrame([(*r, "x") for r in odd], "doc_id long, text string, predicted string")
    got = X.score(frame, model).collect()
    assert len(got) == 5 and len({r.score for r in got[1:4]}) == 1 and got[1].predicted == 1 and got[3].held_out is False
    assert all(0 <= r.score <= 1 for r in got) and X.clean(frame, model).columns == frame.columns


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    row = L.identify(docs, L.fit(docs)).first()
    assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)
    assert L.identify(docs.limit(0), L.fit(docs.limit(0))).count() == 0
