"""Vocabulary, term weights and ranking over token tables.

A token table has (doc_id, pos, term); a term table (doc_id, term, tf). Vocabularies grow with the corpus, so joins
leave the choice of a strategy to the optimizer's statistics.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions.text import alnum_tokens, tokenize
from textmill.operators.blocks import class_sums
from textmill.operators.lineage import stored
from textmill.operators.ordering import place


def token_table(docs: DataFrame, tokens=tokenize, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key), F.posexplode(tokens(F.col(text))).alias("pos", "term"))


def term_table(docs: DataFrame, tokens=alnum_tokens, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each term in each document."""
    terms = docs.select(F.col(key), F.explode(tokens(F.col(text))).alias("term"))
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def build_vocab(tokens: DataFrame, min_count: int = 2, first_id: int = 2) -> DataFrame:
    """(term, n, id): ids from first_id by count, the largest first, then by term. 0 and 1 are left to ``<unk>`` and ``<s>``.

    Ids are dense: the vocabulary is put in one order, part by part."""
    return numbered(tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")), min_count, first_id)


def numbered(counts: DataFrame, min_count: int = 2, first_id: int = 2) -> DataFrame:
    """build_vocab from the counts (term, n) of all terms."""
    counts = counts.filter(F.col("n") >= min_count)
    return place(counts, [F.desc("n"), F.col("term")], "id", first_id).withColumn("id", F.col("id").cast("int"))


def encode(tokens: DataFrame, vocab: DataFrame, drop_unknown: bool = False) -> DataFrame:
    """tokens with id; unknown terms get 0, or go if drop_unknown."""
    if drop_unknown:
        return tokens.join(vocab.select("term", "id"), "term")
    return tokens.join(vocab.select("term", "id"), "term", "left").withColumn("id", F.coalesce("id", F.lit(0)))


def idf(terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + N) / (1 + df)) + 1. n_docs: one row (n)."""
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = n_docs.select(F.col("n").alias("_n"))
    return df.join(F.broadcast(n)).select("term", "df", (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(terms: DataFrame, n_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """terms with w: tf * idf over the L2 norm of the document."""
    weighted = terms.join(idf(terms, n_docs), "term").withColumn("_x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(key)))  # one exchange by document, no second pass
    return weighted.select(key, "term", "tf", (F.col("_x") / norm).alias("w"))


def bm25(terms: DataFrame, queries: DataFrame, lengths: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with a query.

    terms (doc_id, term, tf); queries (query_id, term), each term once; lengths (doc_id, n_terms) of all documents.
    The postings of query terms only are weighted and summed."""
    totals = lengths.agg(F.count(F.lit(1)).alias("_n"), F.avg("n_terms").alias("_avg"))
    wanted = queries.select("term").distinct()
    postings = terms.join(wanted, "term", "left_semi")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    weighted = postings.join(df, "term").join(lengths, "doc_id").join(F.broadcast(totals))
    weight = F.ln((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1) * (
        F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / F.col("_avg")))
    )
    weighted = weighted.select("term", "doc_id", weight.alias("_w"))
    return queries.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.sum("_w").alias("score"))


#: Documents of a block, and queries that it scores at once.
RANKED, ASKED = 2_000, 256


def bm25_best(terms: DataFrame, queries: DataFrame, lengths: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, gain: float | None = None) -> DataFrame:
    """(query_id, doc_id, score) of bm25's k best documents for each query among them, and those that could tie with the last in six
    places. gain stands for k1 + 1.

    terms need hold those of the queries only, and may repeat a (doc_id, term). Blocks of documents meet all queries and keep their own best, so no
    row for each pair of a query and a document is moved."""
    slack = 2e-6
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "doc_id": terms.schema["doc_id"].dataType.simpleString()}
    counted = stored(terms.join(queries.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")))
    sizes = stored(lengths.select("doc_id", F.col("n_terms").cast("long").alias("tf")))
    n, mean = sizes.agg(F.count(F.lit(1)), F.avg("tf")).first()
    blocks = max(1, -(-n // RANKED))
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    asked = stored(queries.select("query_id", "term").distinct().join(df, "term").withColumn("idf", F.ln((F.lit(n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)).select("query_id", "term", "idf"))
    rows = counted.select("doc_id", "term", "tf").unionByName(sizes.select("doc_id", F.lit(None).cast("string").alias("term"), "tf")).filter(F.col("doc_id").isNotNull())
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    every = asked.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": left["query_id"][:0], "doc_id": right["doc_id"][:0], "score": np.zeros(0)})]
        term_of, names = pd.factorize(left["term"])
        query_of, asking = pd.factorize(left["query_id"])
        at, docs = pd.factorize(right["doc_id"])
        size = right["term"].isna().to_numpy()
        col = pd.Index(names).get_indexer(right["term"])
        tf = np.zeros((len(docs), len(names)))
        tf[at[col >= 0], col[col >= 0]] = right["tf"].to_numpy(float)[col >= 0]
        weight = np.zeros_like(tf)
        order = np.argsort(at[size], kind="stable")
        places, values = at[size][order], right["tf"].to_numpy(float)[size][order]
        turn = np.arange(len(places)) - np.searchsorted(places, places)  # rows that repeat a doc_id count one by one
        for no in range(int(turn.max()) + 1 if len(turn) else 0):
            own, long = places[turn == no], values[turn == no]
            part = tf[own]
            weight[own] += part * (k1 + 1 if gain is None else gain) / np.where(part > 0, part + (k1 * (1 - b + b * long / mean))[:, None], 1) if mean else 0
        for low in range(0, len(asking), ASKED):
            mine = (query_of >= low) & (query_of < low + ASKED)
            idf = np.zeros((len(names), min(ASKED, len(asking) - low)))
            idf[term_of[mine], query_of[mine] - low] = left["idf"].to_numpy()[mine]
            scores = (weight @ idf).T
            least = np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, max(0, scores.shape[1] - k)] if scores.size else np.zeros(len(scores))
            query, doc = np.nonzero((scores > 0) & (scores >= (least - slack)[:, None]))
            out.append(pd.DataFrame({"query_id": asking[query + low], "doc_id": docs[doc], "score": scores[query, doc]}))
        return pd.concat(out[1:] or out)

    return every.groupBy("_b").cogroup(dealt.groupBy("_b")).applyInPandas(score, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")


def top_k(scored: DataFrame, k: int, by: str, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each group with rank, ties by the tie column."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def naive_bayes(terms: DataFrame, labels: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(doc_id, predicted, log_posterior) of every labelled document under a multinomial model fitted to all of them.

    labels: (doc_id, label). Terms that a class lacks count by smoothing: each class starts from the score of a
    document of unseen terms, and the terms that it has add their difference. The classes, a few, pass through the driver;
    a null label is none. Documents without a label are scored too."""
    labels = labels.filter(F.col("label").isNotNull())
    classes = [r["label"] for r in labels.groupBy("label").agg(F.count(F.lit(1))).orderBy("label").collect()]
    if not classes:
        return terms.select("doc_id", F.lit(None).cast(labels.schema["label"].dataType).alias("predicted"), F.lit(0.0).alias("log_posterior")).limit(0)
    of = [F.col("label") == F.lit(c) for c in classes]
    rows = terms.join(labels, "doc_id")
    # A class is a column: a term's counts stand side by side, and a document is summed up once, whatever the classes.
    counts = rows.groupBy("term").agg(*(F.sum(F.when(own, F.col("tf")).otherwise(0)).alias(f"_c{k}") for k, own in enumerate(of)))
    priors = labels.agg(F.count(F.lit(1)).alias("_all"), *(F.count_if(own).alias(f"_d{k}") for k, own in enumerate(of)))
    totals = counts.agg(F.count(F.lit(1)).alias("_v"), *(F.sum(f"_c{k}").alias(f"_t{k}") for k in range(len(classes))))
    gains = counts.select("term", *(F.ln((F.col(f"_c{k}") + alpha) / alpha).alias(f"_g{k}") for k in range(len(classes))))
    sums = terms.join(gains, "term", "left").groupBy("doc_id").agg(F.sum("tf").alias("_len"), *(F.sum(F.col("tf") * F.coalesce(F.col(f"_g{k}"), F.lit(0.0))).alias(f"_s{k}") for k in range(len(classes))))
    return _likeliest(sums, totals.join(F.broadcast(priors)), classes, alpha)


def naive_bayes_texts(docs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """naive_bayes of the alphanumeric words of documents (doc_id, text, label): blocks of documents look their words up, and no row for
    each word of each document is moved."""
    labels = docs.select("doc_id", "label").filter(F.col("label").isNotNull())
    found = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()
    classes = [r["label"] for r in found]
    if not classes:
        return docs.select("doc_id", F.lit(None).cast(docs.schema["label"].dataType).alias("predicted"), F.lit(0.0).alias("log_posterior")).limit(0)
    sums, totals = class_sums(docs, classes, alpha)
    priors = [F.lit(sum(r["n"] for r in found)).alias("_all"), *(F.lit(r["n"]).alias(f"_d{k}") for k, r in enumerate(found))]
    return _likeliest(sums, totals.select("*", *priors), classes, alpha)


def _likeliest(sums: DataFrame, totals: DataFrame, classes: list, alpha: float) -> DataFrame:
    """sums: (doc_id, _len, _s0 and on); totals: one row of _v, _all, and _t and _d of each class."""
    base = lambda k: F.col(f"_t{k}") + alpha * F.col("_v")
    value = lambda k: F.ln(F.col(f"_d{k}") / F.col("_all")) + F.col(f"_s{k}") + F.col("_len") * F.ln(alpha / base(k))
    scored = sums.join(F.broadcast(totals)).select("doc_id", *(value(k).alias(f"_p{k}") for k in range(len(classes))))
    each = F.array(*(F.struct(F.round(f"_p{k}", 6).alias("rounded"), F.lit(c).alias("label"), F.col(f"_p{k}").alias("log_posterior")) for k, c in enumerate(classes)))
    return scored.select("doc_id", F.array_max(each).alias("_b")).select("doc_id", F.col("_b.label").alias("predicted"), F.col("_b.log_posterior").alias("log_posterior"))


def confusion_metrics(pairs: DataFrame) -> DataFrame:
    """precision, recall and F1 of each class from (actual, predicted)."""
    cells = pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    actual = cells.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("_a"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("_p"))
    both = actual.join(predicted, "label", "full").fillna(0, ["_a", "_p", "tp"])
    p, r = F.coalesce(F.try_divide("tp", "_p"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "_a"), F.lit(0.0))
    return both.select("label", F.col("_a").alias("support"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def pmi(pairs: DataFrame, marginals: DataFrame | None = None) -> DataFrame:
    """(a, b, n, pmi) from co-occurrence counts (a, b, n): ln p(a, b) / (p(a) p(b)) with marginals of the pairs.

    marginals: (term, n) of all terms, where they are known without the pairs and the same for both sides; pairs may then
    lack those the other way round."""
    left = pairs.groupBy(F.col("a").alias("term")).agg(F.sum("n").alias("n")) if marginals is None else marginals
    right = pairs.groupBy(F.col("b").alias("term")).agg(F.sum("n").alias("n")) if marginals is None else marginals
    every = left.agg(F.sum("n").alias("_all"))
    left, right = (side.select(F.col("term").alias(c), F.col("n").alias(f"_n{c}")) for side, c in ((left, "a"), (right, "b")))
    joined = pairs.join(left, "a").join(right, "b").join(F.broadcast(every))
    return joined.select("a", "b", "n", F.ln(F.col("n") * F.col("_all") / (F.col("_na") * F.col("_nb"))).alias("pmi"))
