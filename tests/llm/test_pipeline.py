import corpus_pipeline as P
import pytest

from tests.llm.test_ngram_join import brute
from textmill.llm import sentencepiece_bpe as S
from textmill.llm import toxicity
from textmill.llm.common import table
from textmill.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        return S.PieceModel(file.read())


def test_stages_one_after_the_other(spark, model):
    docs = whole_docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = [{r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}]
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, SF), name)
        assert docs.columns == names
        rows = docs.select("doc_id", "text").collect()
        now = {r.doc_id: r.text for r in rows}
        assert len(now) == len(rows) and now.items() <= seen[-1].items()
        seen.append(now)
    whole, clean, unlike, apart, mixed = seen
    scores = toxicity.score(whole_docs, toxicity.fit(whole_docs, table(spark, SF, "labels"))).collect()
    assert set(clean) == {r.doc_id for r in scores if r.score < 0.5} and len(clean) < len(whole)
    largest = {t: max(i for i, u in clean.items() if u == t) for t in clean.values()}
    assert set(unlike) == set(largest.values())
    assert set(apart) == {c for _, _, c in brute(sorted(unlike.items()))}
    assert set(mixed) == set(apart)
    final = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id: r.ids for r in final} == {i: model.encode([t])[0] for i, t in mixed.items()}
    assert sorted(r.mix_position for r in final) == list(range(len(mixed)))


def test_stages_on_odd_tables(spark, model, tmp_path):
    near = [f"w{i}" for i in range(80)]
    rows = [
        (1, "a b c", "en", "s", 5, "x"), (1, "a b c", "en", "s", 5, "x"), (2, "a b c", None, None, None, None), (3, None, "en", "s", 0, "y"), (4, "", None, "t", 0, None),
        (None, "no id", "en", "s", 5, "z"), (None, None, None, None, None, None), (7, " ".join(near), "en", "s", 1, "q"), (8, " ".join(near[:78]), "en", "t", 1, "r"),
        (9, "very long " * 40_000, "en", "u", 1, "l"), (10, "other", "de", "s", 5, None),
    ]
    labels = [(7, 0), (None, 1), (3, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")
    for sample in (docs, docs.limit(0)):
        now = sample
        for name, stage in P.STAGES[:-1]:
            now = P.materialize(stage(spark, now, str(tmp_path)), name)
            assert now.columns == docs.columns
        kept = now.collect()
        final = P.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        if sample is not docs:
            assert not kept and not final
            continue
        assert sorted((r.doc_id or 0, r.node or "") for r in kept) == [(0, "z"), (2, ""), (4, ""), (7, "q"), (9, "l"), (10, "")]
        texts = {r.doc_id: r.text for r in kept}
        assert {r.doc_id: r.ids for r in final} == {i: model.encode([t or ""])[0] for i, t in texts.items()}
