import pytest
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators import blocks, terms


@pytest.fixture(scope="module")
def odd(spark):
    """A repeated key, keys and texts that are null, texts without a word, a word of one document only."""
    rows = [(1, "The cat, the dog's cat", "en"), (1, "a Cat again", "de"), (2, None, "en"), (3, "!!", "en"), (None, "cat dog", "de"), (None, "dog dog", None), (4, "dog  ä bird", None), (5, "bird the", "de")]
    rows += [(i, f"word{i % 7} cat {i}", "en" if i % 3 else "de") for i in range(10, 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string")


def plain(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_weights_by_blocks_equal_those_of_the_term_table(spark, odd, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 5)
    n = odd.agg(F.count(F.lit(1)).alias("n"))
    dealt, counts = blocks.document_terms(odd)
    idf = blocks.inverse(counts, n)
    want = terms.tfidf(terms.term_table(odd), n)
    assert plain(blocks.tfidf(dealt, counts, idf)) == plain(want)
    some = spark.createDataFrame([("cat",), ("bird",), ("absent",)], "term string")
    assert plain(blocks.tfidf(dealt, counts, idf, wanted=some)) == plain(want.filter("term IN ('cat', 'bird')"))
    # A word goes back to a block once, not to each of its documents.
    assert counts.filter("term = 'cat'").count() == counts.filter("term = 'cat'").select("_b").distinct().count()


def test_naive_bayes_by_blocks_equals_that_of_the_term_table(odd, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 5)
    keyed = odd.filter("doc_id IS NOT NULL")
    want = terms.naive_bayes(terms.term_table(keyed), keyed.select("doc_id", "label"))
    assert plain(terms.naive_bayes_texts(keyed)) == plain(want)
    assert terms.naive_bayes_texts(odd.withColumn("label", F.lit(None).cast("string"))).collect() == []


@pytest.mark.parametrize("drop", [False, True])
def test_codes_by_blocks_equal_those_of_the_token_table(odd, drop, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 5)
    tokens = terms.token_table(odd.filter("doc_id > 1"))
    coded = terms.encode(tokens, terms.build_vocab(tokens), drop).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"))
    ids = F.array_join(F.transform("x", lambda e: e["id"].cast("string")), " ")
    want = coded.select("doc_id", F.size("x").cast("long").alias("n"), F.md5(ids).alias("ids_md5"))
    assert plain(blocks.encoded(odd.filter("doc_id > 1"), terms.numbered, drop)) == plain(want)


def test_words_are_those_of_the_columns(spark):
    texts = ["It's 2 KKelvin x y é퟿ İ a\u000bb\tc'd", "", "A-B_C\n藍ß"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select(F.lower("text").alias("low"), X.alnum_tokens(F.col("text")).alias("a"), X.tokenize(F.col("text")).alias("t")).collect():
        assert (blocks.ALNUM.findall(r.low), blocks.TOKENS.findall(r.low)) == (r.a, r.t)
