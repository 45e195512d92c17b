"""N-gram counts, add-k language models and overlap measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.arrays import ngrams


def ngram_counts(docs: DataFrame, tokens, n: int, text: str = "text") -> DataFrame:
    """(gram, n): how often each run of n tokens occurs, joined by spaces; runs never span two documents."""
    from pyspark.ml.feature import NGram

    rows = NGram(n=n, inputCol="_k", outputCol="_g").transform(docs.select(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("_k")))
    return rows.select(F.explode("_g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def bigram_table(docs: DataFrame, tokens, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ctx, w) for every token; the first of a document has the context ``<s>``."""
    docs = docs.select(key, F.concat(F.array(F.lit("<s>")), tokens(F.col(text))).alias("_seq"))
    seq = F.col("_seq")
    pairs = F.arrays_zip(F.slice(seq, F.lit(1), F.size(seq) - 1).alias("ctx"), F.slice(seq, F.lit(2), F.size(seq)).alias("w"))
    return docs.select(key, F.explode(pairs).alias("p")).select(key, "p.ctx", "p.w")


def add_k(train: DataFrame, test: DataFrame, k: float) -> DataFrame:
    """test (…, ctx, w) with p: (c(ctx, w) + k) / (c(ctx) + k V); an unseen context gives 1 / V; with k = 0 it gives null.

    V is the number of distinct words in train."""
    pair = train.groupBy("ctx", "w").agg(F.count(F.lit(1)).alias("_c"))
    context = train.groupBy("ctx").agg(F.count(F.lit(1)).alias("_cc"))
    size = train.agg(F.countDistinct("w").alias("_v"))
    joined = test.join(pair, ["ctx", "w"], "left").join(context, "ctx", "left").join(F.broadcast(size))
    p = F.try_divide(F.coalesce("_c", F.lit(0)) + k, F.coalesce("_cc", F.lit(0)) + k * F.col("_v"))
    return joined.withColumn("p", p).drop("_c", "_cc", "_v")


def perplexity(scored: DataFrame) -> DataFrame:
    """tokens, nll (nats), bits and perplexity over rows with p."""
    nll = -F.avg(F.ln("p"))
    return scored.agg(F.count(F.lit(1)).alias("tokens"), nll.alias("nll"), (nll / F.ln(F.lit(2.0))).alias("bits"), F.exp(nll).alias("ppl"))


def unseen_share(train: DataFrame, test: DataFrame) -> DataFrame:
    """Share of the occurrences in test (gram, n) whose gram train lacks."""
    marked = test.join(train.select("gram", F.lit(1).alias("_seen")), "gram", "left")
    return marked.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("_seen").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("unseen_share"))


def rouge_recall(candidates: DataFrame, references: DataFrame, tokens, n: int) -> DataFrame:
    """(doc_id, item_id, rouge) of candidates that share an n-gram with a reference: clipped recall.

    candidates (doc_id, text); references (item_id, text)."""

    def grams(df: DataFrame, key: str) -> DataFrame:
        rows = df.select(key, tokens(F.col("text")).alias("_k")).select(key, F.explode(ngrams(F.col("_k"), n)).alias("gram"))
        return rows.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))

    c, r = grams(candidates, "doc_id"), grams(references, "item_id")
    total = r.groupBy("item_id").agg(F.sum("n").alias("_total"))
    shared = c.withColumnRenamed("n", "_c").join(r, "gram").groupBy("doc_id", "item_id").agg(F.sum(F.least("_c", "n")).alias("_hit"))
    return shared.join(total, "item_id").select("doc_id", "item_id", (F.col("_hit") / F.col("_total")).alias("rouge"))
