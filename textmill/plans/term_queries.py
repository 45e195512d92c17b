"""Vocabulary, ranking and n-gram queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions import text as X
from textmill.operators import blocks as B
from textmill.operators import ngrams as G
from textmill.operators import terms as O
from textmill.operators.lineage import stored
from textmill.operators.quantiles import quantiles
from textmill.plans.registry import query
from textmill.plans.text_queries import ALNUM_SQL, TOK_SQL

TOKENS = f"tok AS (SELECT doc_id, unnest({TOK_SQL}) AS term FROM documents)"
VOCAB = "voc AS (SELECT term, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, term) + 1 AS id FROM tok GROUP BY term HAVING count(*) >= 2)"
TERMS = f"terms AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({ALNUM_SQL}) AS term FROM documents) GROUP BY ALL)"
IDF = "idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM terms GROUP BY term)"
LEN = f"len AS (SELECT doc_id, len({ALNUM_SQL}) AS n_terms FROM documents)"
QUERY = f"q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({ALNUM_SQL}) AS term FROM benchmark))"
BM25 = f"""{TERMS}, {LEN}, {QUERY}, avg_len AS (SELECT avg(n_terms) AS a, count(*) AS n FROM len),
    dfs AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
    scored AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n_terms / a))) AS score
               FROM q JOIN terms USING (term) JOIN dfs USING (term) JOIN len USING (doc_id), avg_len GROUP BY query_id, doc_id)"""


def n_docs(t):
    return t("documents").agg(F.count(F.lit(1)).alias("n"))


def doc_lengths(t):
    return t("documents").select("doc_id", F.size(X.alnum_tokens(F.col("text"))).cast("long").alias("n_terms"))


def query_terms(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.explode(X.alnum_tokens(F.col("text"))).alias("term")).distinct()


def weights(t):
    """TF-IDF of every document and alphanumeric word."""
    blocks, counts = B.document_terms(t("documents"))
    return B.tfidf(blocks, counts, B.inverse(counts, n_docs(t)))


def bm25_scores(t):
    return O.bm25(O.term_table(t("documents")), query_terms(t), doc_lengths(t))


def asked_terms(t):
    """The words of documents that a benchmark item has, a row for each place."""
    terms = t("documents").select("doc_id", F.explode(X.alnum_tokens(F.col("text"))).alias("term"), F.lit(1).alias("tf"))
    return terms.join(query_terms(t).select("term").distinct(), "term", "left_semi")


def bm25_candidates(t, k: int):
    """bm25_scores of the k best documents for each item, and of those that tie with the last, in six places."""
    return O.bm25_best(asked_terms(t), query_terms(t), doc_lengths(t), k).withColumn("score", F.round("score", 6))


def bm25_top(t, k: int):
    """The k best documents for each item, with their rank."""
    return O.top_k(bm25_candidates(t, k), k, "query_id")


@query("build_vocab", f"WITH {TOKENS}, {VOCAB} SELECT term, n, CAST(id AS INT) AS id FROM voc")
def build_vocab(t):
    return O.build_vocab(O.token_table(t("documents")))


@query("vocab_map", f"WITH {TOKENS} SELECT term, n, CAST(row_number() OVER (ORDER BY n DESC, term) - 1 AS INT) AS id FROM (SELECT term, count(*) AS n FROM tok GROUP BY term HAVING count(*) >= 5)")
def vocab_map(t):
    return O.build_vocab(O.token_table(t("documents")), min_count=5, first_id=0)


@query("vocab_coverage", f"WITH {TOKENS}, {VOCAB} SELECT doc_id, round(avg(CAST(voc.term IS NOT NULL AS INT)), 6) AS coverage FROM tok LEFT JOIN voc USING (term) GROUP BY doc_id")
def vocab_coverage(t):
    tokens = O.token_table(t("documents"))
    coded = O.encode(tokens, O.build_vocab(tokens))
    return coded.groupBy("doc_id").agg(F.round(F.avg((F.col("id") > 0).cast("int")), 6).alias("coverage"))


@query("zipf", f"WITH {TOKENS}, c AS (SELECT term, count(*) AS n FROM tok GROUP BY term) SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS rank, n = 1 AS hapax FROM c")
def zipf(t):
    counts = O.build_vocab(O.token_table(t("documents")), min_count=1, first_id=1)
    return counts.select("term", "n", F.col("id").cast("long").alias("rank"), (F.col("n") == 1).alias("hapax"))


@query("encode_ids", f"""WITH t AS (SELECT doc_id, unnest(k) AS term, generate_subscripts(k, 1) AS p FROM (SELECT doc_id, {TOK_SQL} AS k FROM documents)),
    tok AS (SELECT * FROM t), {VOCAB}
    SELECT doc_id, count(*) AS n, md5(string_agg(CAST(coalesce(id, 0) AS VARCHAR), ' ' ORDER BY p)) AS ids_md5 FROM tok LEFT JOIN voc USING (term) GROUP BY doc_id""")
def encode_ids(t):
    return B.encoded(t("documents"), O.numbered)


@query("encode_drop_oov", f"""WITH t AS (SELECT doc_id, unnest(k) AS term, generate_subscripts(k, 1) AS p FROM (SELECT doc_id, {TOK_SQL} AS k FROM documents)),
    tok AS (SELECT * FROM t), {VOCAB}
    SELECT doc_id, count(*) AS n, md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY p)) AS ids_md5 FROM tok JOIN voc USING (term) GROUP BY doc_id""")
def encode_drop_oov(t):
    return B.encoded(t("documents"), O.numbered, drop_unknown=True)


@query("idf", f"WITH {TERMS}, {IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf(t):
    return O.idf(O.term_table(t("documents")), n_docs(t)).select("term", "df", F.round("idf", 6).alias("idf"))


TFIDF = f"""{TERMS}, {IDF}, x AS (SELECT doc_id, term, tf, tf * idf AS x FROM terms JOIN idf USING (term)),
    w AS (SELECT doc_id, term, tf, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM x)"""


@query("tfidf", f"WITH {TFIDF} SELECT doc_id, term, tf, round(w, 6) AS w FROM w")
def tfidf(t):
    return weights(t).withColumn("w", F.round("w", 6))


@query("term_density", f"WITH {TERMS} SELECT count(*) AS nnz, round(count(*) / (CAST((SELECT count(*) FROM documents) AS DOUBLE) * count(DISTINCT term)), 9) AS density FROM terms")
def term_density(t):
    terms = O.term_table(t("documents")).agg(F.count(F.lit(1)).alias("nnz"), F.countDistinct("term").alias("v"))
    return terms.join(F.broadcast(n_docs(t))).select("nnz", F.round(F.col("nnz") / (F.col("n").cast("double") * F.col("v")), 9).alias("density"))


@query("bm25", f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM scored")
def bm25(t):
    return bm25_scores(t).withColumn("score", F.round("score", 6))


@query("bm25_stop", f"""WITH {BM25.replace("SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(" + ALNUM_SQL + ") AS term FROM benchmark)",
    "SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(" + ALNUM_SQL + ") AS term FROM benchmark) WHERE term NOT IN (" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")")}
    SELECT query_id, doc_id, round(score, 6) AS score FROM scored""")
def bm25_stop(t):
    wanted = query_terms(t).filter(~F.col("term").isin(list(X.STOPWORDS)))
    return O.bm25(O.term_table(t("documents")), wanted, doc_lengths(t)).withColumn("score", F.round("score", 6))


@query("bm25_topk", f"""WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored) WHERE rank <= 10""")
def bm25_topk(t):
    """The ten best documents for every benchmark item."""
    return bm25_top(t, 10)


@query("tfidf_cosine_topk", f"""WITH {TFIDF}, qt AS (SELECT item_id AS query_id, term, count(*) AS tf FROM (SELECT item_id, unnest({ALNUM_SQL}) AS term FROM benchmark) GROUP BY ALL),
    qx AS (SELECT query_id, term, tf * idf AS x FROM qt JOIN idf USING (term)), qw AS (SELECT query_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS qw FROM qx),
    s AS (SELECT query_id, doc_id, round(sum(qw * w), 6) AS score FROM qw JOIN w USING (term) GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def tfidf_cosine_topk(t):
    terms = O.term_table(t("benchmark"), key="item_id")
    blocks, counts = B.document_terms(t("documents"))
    idf = B.inverse(counts, n_docs(t))
    weighted = B.tfidf(blocks, counts, idf, wanted=terms.select("term").distinct()).select("doc_id", "term", "w")
    asked = terms.join(idf, "term").select(F.col("item_id").alias("query_id"), "term", (F.col("tf") * F.col("idf")).alias("x"))
    norm = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    asked = stored(asked.join(norm, "query_id").select("query_id", "term", (F.col("x") / F.col("norm")).alias("qw")))
    scored = asked.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qw") * F.col("w")), 6).alias("score"))
    return O.top_k(scored, 5, "query_id")


NB = f"""{TERMS}, lab AS (SELECT doc_id, lang AS label FROM documents), r AS (SELECT * FROM terms JOIN lab USING (doc_id)), v AS (SELECT count(DISTINCT term) AS v FROM r),
    cls AS (SELECT label, ln(docs / CAST(sum(docs) OVER () AS DOUBLE)) AS prior, total + v AS base FROM (SELECT label, count(*) AS docs FROM lab GROUP BY label) JOIN
        (SELECT label, sum(tf) AS total FROM r GROUP BY label) USING (label), v),
    cnt AS (SELECT label, term, sum(tf) AS c FROM r GROUP BY ALL),
    post AS (SELECT d.doc_id, cls.label, prior + sum(d.tf * ln((coalesce(c, 0) + 1) / CAST(base AS DOUBLE))) AS lp FROM terms d CROSS JOIN cls LEFT JOIN cnt ON cnt.term = d.term AND cnt.label = cls.label GROUP BY d.doc_id, cls.label, prior),
    pred AS (SELECT doc_id, label AS predicted FROM post QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(lp, 6) DESC, label DESC) = 1)"""


@query("naive_bayes", f"WITH {NB} SELECT doc_id, predicted FROM pred")
def naive_bayes(t):
    return O.naive_bayes_texts(t("documents").select("doc_id", "text", F.col("lang").alias("label"))).select("doc_id", "predicted")


_PRF = """cells AS (SELECT label, sum(a) AS support, sum(p) AS np, sum(tp) AS tp FROM (
    SELECT actual AS label, 1 AS a, 0 AS p, CAST(actual = predicted AS INT) AS tp FROM pairs UNION ALL SELECT predicted, 0, 1, 0 FROM pairs) GROUP BY label)
    SELECT label, CAST(support AS BIGINT) AS support, round(coalesce(tp / nullif(np, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall,
    round(coalesce(2.0 * tp / nullif(np + support, 0), 0), 6) AS f1 FROM cells"""


@query("prf", f"WITH pairs AS (SELECT CAST(quality AS VARCHAR) AS actual, CAST(toxic AS VARCHAR) AS predicted FROM labels), {_PRF}")
def prf(t):
    pairs = t("labels").select(F.col("quality").cast("string").alias("actual"), F.col("toxic").cast("string").alias("predicted"))
    return _rounded(O.confusion_metrics(pairs))


def _rounded(df):
    return df.select("label", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("naive_bayes_prf", f"WITH {NB}, pairs AS (SELECT lang AS actual, predicted FROM pred JOIN documents USING (doc_id)), {_PRF}")
def naive_bayes_prf(t):
    actual = t("documents").select("doc_id", F.col("lang").alias("actual"))
    return _rounded(O.confusion_metrics(naive_bayes(t).join(actual, "doc_id")))


@query("top_terms_per_class", f"""WITH {TFIDF}, s AS (SELECT lang, term, round(sum(w), 6) AS weight FROM w JOIN documents USING (doc_id) GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM s) WHERE rank <= 10""")
def top_terms_per_class(t):
    found = weights(t).join(t("documents").select("doc_id", "lang"), "doc_id")
    summed = found.groupBy("lang", "term").agg(F.round(F.sum("w"), 6).alias("weight"))
    return O.top_k(summed, 10, "lang", score="weight", tie="term")


@query("noise_dist", f"WITH {TOKENS}, c AS (SELECT term, pow(count(*), 0.75) AS x FROM tok GROUP BY term) SELECT term, round(x / sum(x) OVER (), 10) AS p FROM c")
def noise_dist(t):
    powered = O.token_table(t("documents")).groupBy("term").agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(0.75)).alias("x"))
    total = powered.agg(F.sum("x").alias("s"))
    return powered.join(F.broadcast(total)).select("term", F.round(F.col("x") / F.col("s"), 10).alias("p"))


COOC = f"""seq AS (SELECT doc_id, unnest(k) AS term, generate_subscripts(k, 1) AS pos FROM (SELECT doc_id, {ALNUM_SQL} AS k FROM documents)),
    co AS (SELECT a.term AS a, b.term AS b, count(*) AS n FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.pos - a.pos IN (-2, -1, 1, 2) GROUP BY ALL)"""


def _neighbours(t, reach: int):
    """(a, b, n) with a <= b: how often the two stand within ``reach`` words of each other, either way round; from shifted copies of
    each document's own array, so nothing is joined and each pair crosses the network once."""
    rows = t("documents").select(X.alnum_tokens(F.col("text")).alias("k"))
    pairs = [
        F.arrays_zip(F.slice("k", F.lit(1), left).alias("a"), F.slice("k", F.lit(s + 1), left).alias("b"))
        for s in range(1, reach + 1) for left in [F.greatest(F.size("k") - s, F.lit(0))]
    ]
    each = rows.select(F.explode(F.concat(*pairs)).alias("p"))
    one = each.groupBy(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return one.withColumn("n", F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")))


def _both_ways(pairs):
    """Pairs with a <= b, and each of two different words the other way round too."""
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    ways = F.when(F.col("a") == F.col("b"), F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))
    return pairs.withColumn("_p", F.explode(ways)).withColumns({"a": F.col("_p.a"), "b": F.col("_p.b")}).drop("_p")


def cooccurrence(t, reach: int = 2):
    """Pairs within ``reach`` words of each other, in both orders."""
    return _both_ways(_neighbours(t, reach))


@query("cooccurrence_pairs", f"WITH {COOC} SELECT a, b, n FROM co")
def cooccurrence_pairs(t):
    return cooccurrence(t)


@query("pmi", f"WITH {COOC} SELECT a, b, n, round(ln(n * CAST(sum(n) OVER () AS DOUBLE) / (sum(n) OVER (PARTITION BY a) * CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE))), 6) AS pmi FROM co")
def pmi(t):
    """A word's marginal is the number of its neighbours, counted from its places: no pair is moved for it."""
    reach = 2
    words = t("documents").select(X.alnum_tokens(F.col("text")).alias("k")).select(F.size("k").alias("_m"), F.posexplode("k").alias("_i", "term"))
    near = F.least(F.col("_i"), F.lit(reach)) + F.least(F.col("_m") - 1 - F.col("_i"), F.lit(reach))
    marginals = words.groupBy("term").agg(F.sum(near).alias("n")).filter("n > 0")
    return _both_ways(O.pmi(_neighbours(t, reach), marginals)).select("a", "b", "n", F.round("pmi", 6).alias("pmi"))


#: The table of CRC-32, and the CRC-32 of words of ASCII.
CRC_SQL = """crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
    crcs AS (SELECT term, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(term, ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) AS crc
        FROM (SELECT DISTINCT term FROM terms), crc)"""


@query("hash_embed", f"""WITH {TERMS}, {CRC_SQL}, b AS (SELECT doc_id, CAST(crc % 512 AS BIGINT) AS bucket, sum(tf) AS x FROM terms JOIN crcs USING (term) GROUP BY ALL)
    SELECT doc_id, bucket, round(x / sqrt(sum(CAST(x AS DOUBLE) * x) OVER (PARTITION BY doc_id)), 6) AS v FROM b""")
def hash_embed(t):
    bucket = F.crc32(F.col("term").cast("binary")) % 512
    b = O.term_table(t("documents")).groupBy("doc_id", bucket.alias("bucket")).agg(F.sum("tf").alias("x"))
    norm = F.sqrt(F.sum(F.col("x").cast("double") * F.col("x")).over(Window.partitionBy("doc_id")))
    return b.select("doc_id", "bucket", F.round(F.col("x") / norm, 6).alias("v"))


# -- n-grams


@query("ngram_counts", f"""SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(k) - 1), lambda i: array_to_string(k[i:i + 2], ' '))) AS gram
    FROM (SELECT {TOK_SQL} AS k FROM documents)) GROUP BY gram""")
def ngram_counts(t):
    return G.ngram_counts(t("documents"), X.tokenize, 3)


@query("ngram_lag", f"""SELECT ctx, w, count(*) AS n FROM (SELECT unnest(list_zip(['<s>'] || k[1:len(k) - 1], k), recursive := true) FROM (SELECT {TOK_SQL} AS k FROM documents)) x(ctx, w) GROUP BY ALL""")
def ngram_lag(t):
    return G.bigram_table(t("documents"), X.tokenize).groupBy("ctx", "w").agg(F.count(F.lit(1)).alias("n"))


@query("char_ngram_counts", """SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(text) - 1), lambda i: text[i:i + 2])) AS gram FROM documents WHERE length(text) >= 3) GROUP BY gram""")
def char_ngram_counts(t):
    from textmill.functions.arrays import ngrams

    rows = t("documents").select(F.filter(F.split("text", ""), lambda c: c != "").alias("k"))
    return rows.select(F.explode(ngrams(F.col("k"), 3, sep="")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def split_bigrams(t):
    """Training and test halves by the parity of doc_id."""
    table = G.bigram_table(t("documents"), X.tokenize).withColumn("test", F.col("doc_id") % 2 == 1)
    return table.filter("NOT test").select("ctx", "w"), table.filter("test").select("ctx", "w")


LM = f"""big AS (SELECT doc_id % 2 = 1 AS test, unnest(list_zip(['<s>'] || k[1:len(k) - 1], k)) AS p FROM (SELECT doc_id, {TOK_SQL} AS k FROM documents)),
    tr AS (SELECT p[1] AS ctx, p[2] AS w FROM big WHERE NOT test), te AS (SELECT p[1] AS ctx, p[2] AS w FROM big WHERE test),
    c2 AS (SELECT ctx, w, count(*) AS c FROM tr GROUP BY ALL), c1 AS (SELECT ctx, count(*) AS cc FROM tr GROUP BY ctx), v AS (SELECT count(DISTINCT w) AS v FROM tr),
    j AS (SELECT te.ctx, te.w, coalesce(c, 0) AS c, coalesce(cc, 0) AS cc, v FROM te LEFT JOIN c2 USING (ctx, w) LEFT JOIN c1 USING (ctx), v)"""


@query("addk_prob", f"WITH {LM} SELECT DISTINCT ctx, w, round((c + 0.5) / (cc + 0.5 * v), 9) AS p FROM j")
def addk_prob(t):
    train, test = split_bigrams(t)
    return G.add_k(train, test.distinct(), 0.5).select("ctx", "w", F.round("p", 9).alias("p"))


@query("perplexity", f"WITH {LM} SELECT count(*) AS tokens, round(-avg(ln((c + 0.1) / (cc + 0.1 * v))), 6) AS nll, round(-avg(ln((c + 0.1) / (cc + 0.1 * v))) / ln(2), 6) AS bits, round(exp(-avg(ln((c + 0.1) / (cc + 0.1 * v)))), 4) AS ppl FROM j")
def perplexity(t):
    train, test = split_bigrams(t)
    return G.perplexity(G.add_k(train, test, 0.1)).select("tokens", F.round("nll", 6).alias("nll"), F.round("bits", 6).alias("bits"), F.round("ppl", 4).alias("ppl"))


@query("zero_prob_share", f"WITH {LM} SELECT round(avg(CAST(c = 0 AS INT)), 6) AS share FROM j")
def zero_prob_share(t):
    train, test = split_bigrams(t)
    scored = G.add_k(train, test, 0.0)
    return scored.agg(F.round(F.avg((F.coalesce("p", F.lit(0.0)) == 0).cast("int")), 6).alias("share"))


_KS = [0.01, 0.1, 0.5, 1.0]


@query("select_k", f"""WITH {LM}, g AS (SELECT k, round(-avg(ln((c + k) / (cc + k * v))), 6) AS nll FROM j, (SELECT unnest({_KS}) AS k) GROUP BY k)
    SELECT CAST(k AS DOUBLE) AS k, nll, k = (SELECT arg_min(k, (nll, k)) FROM g) AS best FROM g""")
def select_k(t):
    """All values of k in one pass over the joined counts."""
    train, test = split_bigrams(t)
    pair, context = train.groupBy("ctx", "w").agg(F.count(F.lit(1)).alias("c")), train.groupBy("ctx").agg(F.count(F.lit(1)).alias("cc"))
    size = train.agg(F.countDistinct("w").alias("v"))
    j = test.join(pair, ["ctx", "w"], "left").join(context, "ctx", "left").fillna(0, ["c", "cc"]).join(F.broadcast(size))
    row = j.agg(*(F.round(-F.avg(F.ln((F.col("c") + k) / (F.col("cc") + k * F.col("v")))), 6).alias(f"nll{i}") for i, k in enumerate(_KS)))
    grid = row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"nll{i}").alias("nll")) for i, k in enumerate(_KS)))).alias("g")).select("g.*")
    best = F.min(F.struct("nll", "k")).over(Window.partitionBy())["k"]
    return grid.withColumn("best", F.col("k") == best)


@query("unseen_share", f"""WITH g AS (SELECT doc_id % 2 = 1 AS test, unnest(list_transform(range(1, len(k) - 1), lambda i: array_to_string(k[i:i + 2], ' '))) AS gram FROM (SELECT doc_id, {TOK_SQL} AS k FROM documents))
    SELECT count(*) AS n, round(avg(CAST(gram NOT IN (SELECT gram FROM g WHERE NOT test) AS INT)), 6) AS unseen_share FROM g WHERE test""")
def unseen_share(t):
    d = t("documents")
    train, test = (G.ngram_counts(d.filter(F.col("doc_id") % 2 == r), X.tokenize, 3) for r in (0, 1))
    return G.unseen_share(train, test).select("n", F.round("unseen_share", 6).alias("unseen_share"))


@query("unseen_ngrams", f"""WITH g AS (SELECT doc_id % 2 = 1 AS test, unnest(list_transform(range(1, len(k)), lambda i: array_to_string(k[i:i + 1], ' '))) AS gram FROM (SELECT doc_id, {TOK_SQL} AS k FROM documents))
    SELECT gram, count(*) AS n FROM g WHERE test AND gram NOT IN (SELECT gram FROM g WHERE NOT test) GROUP BY gram""")
def unseen_ngrams(t):
    d = t("documents")
    train, test = (G.ngram_counts(d.filter(F.col("doc_id") % 2 == r), X.tokenize, 2) for r in (0, 1))
    return test.join(train, "gram", "left_anti")


@query("distinct_n", f"""SELECT lang, round(count(DISTINCT gram) / greatest(count(gram), 1), 6) AS distinct_2 FROM (SELECT lang, unnest(list_transform(range(1, len(k)), lambda i: array_to_string(k[i:i + 1], ' '))) AS gram
    FROM (SELECT lang, {TOK_SQL} AS k FROM documents)) GROUP BY lang""")
def distinct_n(t):
    from textmill.functions.arrays import ngrams

    rows = t("documents").select("lang", X.tokenize(F.col("text")).alias("k"))
    grams = rows.select("lang", F.explode(ngrams(F.col("k"), 2)).alias("gram"))
    counts = grams.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("lang").agg(F.round(F.count(F.lit(1)) / F.greatest(F.sum("n"), F.lit(1)), 6).alias("distinct_2"))


_GRAM2 = "unnest(list_transform(range(1, len(k)), lambda i: array_to_string(k[i:i + 1], ' '))) AS gram"


@query("rouge_n", f"""WITH c AS (SELECT doc_id, gram, count(*) AS c FROM (SELECT doc_id, {_GRAM2} FROM (SELECT doc_id, {ALNUM_SQL} AS k FROM documents)) GROUP BY ALL),
    r AS (SELECT item_id, gram, count(*) AS n FROM (SELECT item_id, {_GRAM2} FROM (SELECT item_id, {ALNUM_SQL} AS k FROM benchmark)) GROUP BY ALL),
    tot AS (SELECT item_id, sum(n) AS total FROM r GROUP BY item_id)
    SELECT doc_id, item_id, round(sum(least(c, n)) / any_value(total), 6) AS rouge FROM c JOIN r USING (gram) JOIN tot USING (item_id) GROUP BY doc_id, item_id""")
def rouge_n(t):
    return G.rouge_recall(t("documents"), t("benchmark"), X.alnum_tokens, 2).withColumn("rouge", F.round("rouge", 6))


@query("bpe_pair_counts", f"""WITH w AS (SELECT term, count(*) AS f FROM (SELECT unnest({ALNUM_SQL}) AS term FROM documents) GROUP BY term),
    s AS (SELECT string_split(term, '') || ['_'] AS k, f FROM w)
    SELECT p[1] AS a, p[2] AS b, CAST(sum(f) AS BIGINT) AS n FROM (SELECT unnest(list_zip(k[1:len(k) - 1], k[2:])) AS p, f FROM s) GROUP BY ALL""")
def bpe_pair_counts(t):
    from textmill.operators.bpe import pair_counts, word_symbols

    return pair_counts(word_symbols(t("documents")))


@query("tokens_per_word", f"SELECT lang, round(sum(length(array_to_string(k, ''))) / sum(len(k)), 6) AS per_word FROM (SELECT lang, {ALNUM_SQL} AS k FROM documents) GROUP BY lang")
def tokens_per_word(t):
    k = X.alnum_tokens(F.col("text"))
    sizes = t("documents").select("lang", F.length(F.array_join(k, "")).alias("c"), F.size(k).alias("w"))
    return sizes.groupBy("lang").agg(F.round(F.sum("c") / F.sum("w"), 6).alias("per_word"))


@query("length_stats", f"SELECT lang, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS longest FROM (SELECT lang, len({TOK_SQL}) AS n FROM documents) GROUP BY lang")
def length_stats(t):
    n = stored(t("documents").select("lang", F.size(X.tokenize(F.col("text"))).cast("long").alias("n")))  # each pass reads numbers, not texts
    found = quantiles(n, ["lang"], "n", [0.5, 0.95]).groupBy("lang")
    tails = found.agg(*(F.round(F.max(F.when(F.col("p") == p, F.col("quantile"))), 6).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"))))
    return tails.join(n.groupBy(F.col("lang").alias("_l")).agg(F.max("n").alias("longest")), F.col("lang").eqNullSafe(F.col("_l"))).drop("_l")


@query("bpe_merges")
def bpe_merges(t):
    """The first 20 merges over the corpus; the toy case in the tests has the expected merges."""
    from textmill.operators.bpe import train_bpe, word_symbols

    return train_bpe(word_symbols(t("documents")), 20)
