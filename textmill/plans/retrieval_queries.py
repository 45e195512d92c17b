"""Second stages of retrieval, chunks, sections, quotes and agreement on spans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions import text as X
from textmill.functions.stem import stemmed
from textmill.operators import dense as D
from textmill.operators import fitting as M
from textmill.operators import generation as G
from textmill.operators import lsa as L
from textmill.operators import quality as Q
from textmill.operators import retrieval as S
from textmill.operators import sweep as W
from textmill.operators import terms as O
from textmill.operators.lineage import stored
from textmill.plans.registry import query
from textmill.plans.table_queries import HASH
from textmill.plans.term_queries import BM25, bm25_candidates, bm25_top, doc_lengths, query_terms, tfidf_cosine_topk
from textmill.plans.text_queries import ALNUM_SQL, STOP_SQL, WORD_STOP_SQL

#: The stop words of the ranking over stems.
ENGLISH_STOP = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
_CANDIDATES = "cand AS (SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored) WHERE rank <= 20)"
_TERMS = f"tt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({ALNUM_SQL}) AS term FROM documents) GROUP BY ALL)"
_ASKED = f"qq AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({ALNUM_SQL}) AS term FROM benchmark))"
_LOCAL = f"""{_CANDIDATES}, {_TERMS}, {_ASKED}, own AS (SELECT query_id, doc_id, term, tf FROM cand JOIN tt USING (doc_id)),
    lens AS (SELECT query_id, doc_id, sum(tf) AS n FROM own GROUP BY ALL), tot AS (SELECT query_id, count(*) AS nn, avg(n) AS av FROM lens GROUP BY query_id),
    hit AS (SELECT * FROM own JOIN qq USING (query_id, term)), dfl AS (SELECT query_id, term, count(*) AS df FROM hit GROUP BY ALL),
    loc AS (SELECT query_id, doc_id, sum(ln((nn - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / av))) AS local FROM hit JOIN dfl USING (query_id, term) JOIN lens USING (query_id, doc_id) JOIN tot USING (query_id) GROUP BY ALL),
    two AS (SELECT query_id, doc_id, rank, round(coalesce(local, 0), 6) AS local FROM cand LEFT JOIN loc USING (query_id, doc_id))"""


@query("two_stage", f"WITH {BM25}, {_LOCAL} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY local DESC, rank) AS place FROM two QUALIFY place <= 5")
def two_stage(t):
    """The 20 best documents by BM25, in the order of BM25 with statistics of these alone: the first five."""
    return S.two_stage(O.term_table(t("documents")), query_terms(t), doc_lengths(t), 20, 5)


@query("rerank", f"WITH {BM25}, {_CANDIDATES} SELECT query_id, doc_id, rank, n_chars, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, rank) AS place FROM cand JOIN documents USING (doc_id) QUALIFY place <= 5")
def rerank(t):
    """The 20 best documents by BM25, the longest first."""
    first = bm25_top(t, 20).select("query_id", "doc_id", "rank")
    return S.rerank(first.join(t("documents").select("doc_id", "n_chars"), "doc_id"), "n_chars", 5).select("query_id", "doc_id", "rank", "n_chars", "place")


def _hybrid(t):
    sparse = bm25_top(t, 5)
    return S.fuse([tfidf_cosine_topk(t), sparse])


@query("rerank_scorer")
def rerank_scorer(t):
    """The hybrid's candidates by a scorer that runs in a worker: shared words over the text's words."""

    def overlap(asked: str, texts: list[str]) -> list[float]:
        want = set(asked.lower().split())
        return [len(want & set(x.lower().split())) / max(1, len(x.split())) for x in texts]

    ranked = _hybrid(t).join(t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return S.rerank_with(ranked, t("documents"), overlap, 3).select("query_id", "doc_id", "rank", F.round("model_score", 6).alias("model_score"), "place")


@query("same_up_to_ties", f"WITH {BM25}, a AS (SELECT query_id, count(*) AS n FROM scored GROUP BY query_id) SELECT query_id, true AS same FROM a")
def same_up_to_ties(t):
    """BM25's best ten against the same scores ranked the other way inside ties: equal but for these."""
    # No row below the tenth best score stands among the first ten, whichever way ties go.
    found = bm25_candidates(t, 10).withColumn("least", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter("least <= 10")
    scored = stored(found.select("query_id", F.col("doc_id").alias("id"), "score"))
    place = lambda tie: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), tie))
    return S.same_up_to_ties(scored.withColumn("rank", place(F.col("id"))), scored.withColumn("rank", place(F.desc("id"))), 10)


_LINES = r"""ln_ AS (SELECT doc_id, i, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
    h AS (SELECT doc_id, start, trim(section) AS section FROM (SELECT doc_id, start, regexp_extract(line, '^((?:\S+ ?){1,3})$', 1) AS section FROM ln_) WHERE section <> '')"""


@query("section_asof", f"WITH {_LINES}, c AS (SELECT doc_id, unnest(range(0, length(text), 1000)) AS start FROM documents) SELECT c.doc_id, c.start, coalesce(section, '') AS section FROM c ASOF LEFT JOIN h ON c.doc_id = h.doc_id AND c.start >= h.start")
def section_asof(t):
    """The last heading, a line of up to three words, at or before every thousandth character."""
    docs = t("documents")
    heads = S.headings(docs, r"^((?:\S+ ?){1,3})$", "doc_id", "text")
    starts = docs.filter(F.length("text") > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(1000))).alias("start"))
    return S.section_of(starts, heads, "doc_id").select("doc_id", F.col("start").cast("long").alias("start"), "section")


@query("chunk_sentences")
def chunk_sentences(t):
    """Chunks of whole sentences of at most 128 words, with 16 words of overlap."""
    return S.build_index(t("documents")).select("doc_id", "chunk_id", "start", "stop", "n_words", F.md5("chunk").alias("chunk_md5"))


@query("chunk_sweep", f"""WITH s AS (SELECT unnest([64, 128, 256]) AS size), n AS (SELECT doc_id, len({ALNUM_SQL}) AS n FROM documents)
    SELECT size, CAST(sum(CASE WHEN n = 0 THEN 0 ELSE 1 + greatest(n - 1, 0) // (size - size // 8) END) AS BIGINT) AS chunks, CAST(max(n) AS BIGINT) AS longest FROM s, n GROUP BY size""")
def chunk_sweep(t):
    """How many windows each size of chunk gives, an eighth of it overlapping."""
    n = t("documents").select(F.size(X.alnum_tokens(F.col("text"))).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("_c"))
    rows = n.select("n", "_c", F.explode(F.array(*map(F.lit, (64, 128, 256)))).alias("size"))
    windows = F.when(F.col("n") == 0, 0).otherwise(1 + F.expr("(n - 1) div (size - size div 8)"))
    return rows.groupBy("size").agg(F.sum(windows * F.col("_c")).alias("chunks"), F.max("n").cast("long").alias("longest"))


@query("budget_choice", """WITH s AS (SELECT size, least(10, 2048 // size) AS k, round(ln(size) / 10, 6) AS recall, round(1.0::DOUBLE / size, 6) AS mrr FROM (SELECT DISTINCT p_size * 32 AS size FROM part WHERE p_size % 4 = 0))
    SELECT size, k, recall, mrr FROM s ORDER BY recall DESC, mrr DESC, size LIMIT 1""")
def budget_choice(t):
    sizes = t("part").filter("p_size % 4 = 0").select((F.col("p_size") * 32).alias("size")).distinct()
    rows = sizes.select("size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("k"), F.round(F.ln("size") / 10, 6).alias("recall"), F.round(1.0 / F.col("size"), 6).alias("mrr"))
    return S.budget_choice(rows, 2048)


@query("quote_errors", """WITH q AS (SELECT doc_id + 1 AS doc_id, doc_id AS quote_id, substr(text, 1, 12) AS quote FROM documents WHERE length(text) >= 12 UNION ALL SELECT doc_id, -1 - doc_id, substr(text, 1, 3) FROM documents WHERE length(text) >= 12)
    SELECT quote_id, doc_id, n FROM (SELECT quote_id, q.doc_id, (length(d.text) - length(replace(d.text, quote, ''))) // length(quote) AS n FROM q LEFT JOIN documents d USING (doc_id)) WHERE n IS DISTINCT FROM 1""")
def quote_errors(t):
    """Quotes from the beginning of each text, short ones of its own and long ones of its neighbour, that don't occur once."""
    docs = t("documents").filter(F.length("text") >= 12)
    part = lambda key, page, n: docs.select(key.alias("quote_id"), page.alias("doc_id"), F.substring("text", 1, n).alias("quote"))
    i = F.col("doc_id")
    return S.quote_errors(part(i, i + 1, 12).unionByName(part(-1 - i, i, 3)), t("documents"), "quote_id", "doc_id")


_RUN = f"list_filter({ALNUM_SQL}, lambda x: x NOT IN ({STOP_SQL}))"


@query("longest_shared_run", f"""WITH g AS (SELECT item_id, p, array_to_string(k[p:p + 3], ' ') AS g FROM (SELECT item_id, k, unnest(range(1, len(k) - 2)) AS p FROM (SELECT item_id, {_RUN} AS k FROM benchmark))),
    d AS (SELECT doc_id, q, array_to_string(k[q:q + 3], ' ') AS g FROM (SELECT doc_id, k, unnest(range(1, len(k) - 2)) AS q FROM (SELECT doc_id, {_RUN} AS k FROM documents))),
    m AS (SELECT item_id, doc_id, p - q AS diag, p, p - row_number() OVER (PARTITION BY item_id, doc_id, p - q ORDER BY p) AS isl FROM g JOIN d USING (g))
    SELECT item_id, doc_id, max(n) AS run FROM (SELECT item_id, doc_id, count(*) + 3 AS n FROM m GROUP BY item_id, doc_id, diag, isl) GROUP BY ALL""")
def longest_shared_run(t):
    """The most content tokens in a row that a benchmark item and a document share, from four."""
    tokens = lambda name, key: t(name).select(key, X.content_tokens(F.col("text")).alias("tokens"))
    return S.longest_shared_run(tokens("benchmark", "item_id"), tokens("documents", "doc_id"), "item_id", "doc_id")


_SPANS = "a AS (SELECT event_id // 4 AS item_id, event_id % 3 AS page_id, k * 40 AS start, k * 40 + 100 AS stop FROM (SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events WHERE event_id % 2 = 0)), b AS (SELECT event_id // 4 AS item_id, event_id % 3 AS page_id, k * 40 + 30 AS start, k * 40 + 1500 AS stop FROM (SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events WHERE event_id % 2 = 1))"


def _spans(t):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t("events").select("event_id", F.expr("event_id div 4").alias("item_id"), (F.col("event_id") % 3).alias("page_id"), k.alias("k"))
    a = rows.filter("event_id % 2 = 0").select("item_id", "page_id", (F.col("k") * 40).alias("start"), (F.col("k") * 40 + 100).alias("stop"))
    b = rows.filter("event_id % 2 = 1").select("item_id", "page_id", (F.col("k") * 40 + 30).alias("start"), (F.col("k") * 40 + 1500).alias("stop"))
    return a, b


@query("annotator_overlap", f"WITH {_SPANS} SELECT item_id, page_id, a.start AS start_a, a.stop AS stop_a, b.start AS start_b, b.stop AS stop_b FROM a JOIN b USING (item_id, page_id) WHERE least(a.stop, b.stop) > greatest(a.start, b.start)")
def annotator_overlap(t):
    """Pairs of two annotators' spans of one item and page that share a character."""
    return S.overlaps(*_spans(t), ["item_id", "page_id"])


@query("annotator_agreement", f"WITH {_SPANS}, hit AS (SELECT DISTINCT item_id FROM a JOIN b USING (item_id, page_id) WHERE least(a.stop, b.stop) > greatest(a.start, b.start)) SELECT count(hit.item_id) AS agreeing, count(*) AS answerable FROM (SELECT DISTINCT item_id FROM a) LEFT JOIN hit USING (item_id)")
def annotator_agreement(t):
    return S.agreement(*_spans(t))


@query("stub_answer", f"""WITH r AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations),
    w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 5 AND x NOT IN ({WORD_STOP_SQL})) AS a, list_filter(regexp_extract_all(lower(coalesce(asked, '')), '[a-z0-9]+'), lambda x: length(x) >= 5 AND x NOT IN ({WORD_STOP_SQL})) AS b FROM r)
    SELECT conv_id, turn, list_has_any(a, b) AS answers FROM w""")
def stub_answer(t):
    """Whether a turn shares a content word of five letters or more with the one before it."""
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = t("conversations").select("conv_id", "turn", "text", before.alias("asked"))
    words = lambda c: X.content_words(F.col(c), 5)
    return rows.select("conv_id", "turn", F.arrays_overlap(words("text"), words("asked")).alias("answers"))


# -- fits


@query("noise_floor")
def noise_floor(t):
    """Calibration error of a forecaster that is right as often as it says: mean and 95th percentile of 2,000 repetitions."""
    k = F.get_json_object("props", "$.k").cast("int")
    return M.noise_floor(t("events").select((k / 100.0).alias("conf")), 10)


@query("fit_temperature")
def fit_temperature(t):
    """The temperature of the least mean log loss, and that loss."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t("events").select(F.ln((k + 0.5) / (100.5 - k)).alias("z"), (F.col("value") < 50).cast("int").alias("y"))
    tau, loss = M.fit_temperature(rows, M.logit_nll(F.col("z"), F.col("y")))
    return rows.sparkSession.createDataFrame([(round(tau, 4), round(loss, 8))], "tau double, nll double")


def _rfm(t):
    r = t("orders").groupBy(F.col("o_custkey").alias("key")).agg(F.log1p(F.datediff(F.lit("2002-01-01").cast("date"), F.max("o_orderdate"))).alias("r"), F.log1p(F.countDistinct("o_orderkey")).alias("f"), F.log1p(F.sum("o_totalprice")).alias("m"))
    s = r.agg(*(f(c).alias(f"{c}_{n}") for c in "rfm" for n, f in (("a", F.avg), ("s", F.stddev_pop))))
    z = [((F.col(c) - F.col(f"{c}_a")) / F.col(f"{c}_s")).alias(c) for c in "rfm"]
    return r.join(F.broadcast(s)).select("key", *z).select("key", F.array("r", "f", "m").alias("vector"))


@query("choose_k")
def choose_k(t):
    """Euclidean silhouette of k-means on recency, frequency and value for k from 3 to 6, over customers whose number is divisible by 20."""
    found = M.choose_k(_rfm(t), F.col("key") % 20 == 0)
    return t("orders").sparkSession.createDataFrame([(k, round(s, 6)) for k, s in found], "k int, silhouette double")


@query("segments_named")
def segments_named(t):
    """Names of four segments of customers by their centroids, and their sizes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = _rfm(t)
    model = KMeans(k=4, seed=7, featuresCol="x", predictionCol="cluster").fit(rows.withColumn("x", array_to_vector("vector")))
    centres = rows.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())], "cluster int, r double, f double, m double")
    return M.name_segments(centres).join(rows.sparkSession.createDataFrame([(i, n) for i, n in enumerate(model.summary.clusterSizes)], "cluster int, n long"), "cluster")


@query("logistic_regression")
def logistic_regression(t):
    """Language from TF-IDF by logistic regression: the ridge with the best macro F1 on every fifth document."""
    docs = t("documents").filter("text IS NOT NULL AND lang IS NOT NULL")
    held = Q.hash_uniform(F.lit("lr"), F.col("doc_id")) < 0.2
    _, c, f1 = M.logistic_regression(docs.filter(~held), docs.filter(held), (0.001, 0.01, 0.1), label="lang", dims=1 << 14)
    return docs.sparkSession.createDataFrame([(c, round(f1, 6))], "ridge double, macro_f1 double")


def _lsa_ranked(t, k: int):
    """(query_id, doc_id, rank, score): documents by the cosine of their latent vectors."""
    docs, items = t("documents").select("doc_id", "text"), t("benchmark").select(F.col("item_id").alias("query"), "text")
    model = L.fit(docs)
    found = D.exact(model.rows(), L.vectors(model, items, "query"), "doc_id", k, "vector")
    return found.select(F.col("query").alias("query_id"), "doc_id", "rank", F.col("sim").alias("score"))


@query("lsa")
def lsa(t):
    """The five documents nearest to each benchmark item in 256 latent directions of the corpus."""
    return _lsa_ranked(t, 5).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@query("hybrid_dense")
def hybrid_dense(t):
    """BM25 and latent vectors, five documents each, fused by reciprocal rank."""
    sparse = bm25_top(t, 5)
    return S.fuse([_lsa_ranked(t, 5), sparse])


@query("bm25_stem")
def bm25_stem(t):
    """The ten best documents for every benchmark item by BM25 over stems: words of two characters or more but stop words, and
    weights without the factor k1 + 1."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(L.WORD), F.lit(0)), lambda w: ~w.isin(*ENGLISH_STOP))
    docs = t("documents").select("doc_id", words.alias("words"))
    places = docs.select("doc_id", F.explode("words").alias("word"))
    asked = stored(stemmed(t("benchmark").select(F.col("item_id").alias("query_id"), F.explode(words).alias("term"))).distinct())
    # Of the corpus's distinct words those that have a wanted stem, a few, meet the texts.
    stems = stemmed(places.groupBy("word").agg(F.lit(1).alias("_")).select("word", F.col("word").alias("term")))
    wanted = stored(stems.join(asked.select("term").distinct(), "term", "left_semi").select("word", "term"))
    terms = places.join(wanted, "word").select("doc_id", "term", F.lit(1).alias("tf"))
    lengths = docs.select("doc_id", F.greatest(F.size("words"), F.lit(0)).alias("n_terms"))
    scored = O.bm25_best(terms, asked, lengths, 10, gain=1.0)
    return O.top_k(scored.withColumn("score", F.round("score", 6)), 10, "query_id")


@query("dense_search")
def dense_search(t):
    """The ten nearest vectors of each vector whose number is divisible by 20, by the index of cells."""
    rows = t("embeddings").select("vec_id", "embedding")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return D.search(D.build(rows, "vec_id", "embedding"), queries, 10, probes=24)


@query("dense_exact", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: CAST(CAST(x / sqrt(list_dot_product(e, e)) AS FLOAT) AS DOUBLE)) AS u FROM v)
    SELECT query, vec_id, sim, rank FROM (SELECT a.vec_id AS query, b.vec_id, round(list_dot_product(a.u, b.u), 6) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.u, b.u), 6) DESC, b.vec_id) AS rank FROM u a, u b WHERE a.vec_id % 20 = 0) WHERE rank <= 10""")
def dense_exact(t):
    """dense_search without an index."""
    rows = t("embeddings").select("vec_id", "embedding")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    return D.exact(rows, queries, "vec_id", 10).select("query", "vec_id", "sim", F.col("rank").cast("long").alias("rank"))


@query("chunk_recall")
def chunk_recall(t):
    """Recall and reciprocal rank of chunks of 128, 256 and 512 words, for up to ten of them. The question of a benchmark item
    is its first eight words, and the evidence where documents hold the whole item."""
    docs, items = t("documents"), t("benchmark")
    found = S.containing(items, docs, "item_id", "doc_id")
    at = F.expr("instr(text, item)") - 1
    evidence = found.select(F.col("item_id").alias("query_id"), F.lit(0).alias("group"), "doc_id", at.alias("start"), (at + F.length("item")).alias("stop"))
    asked = items.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.slice(X.alnum_tokens(F.col("text")), 1, 8))).alias("term"))
    return W.sweep(stored(W.best_chunks(docs, [128, 256, 512], asked, 10)), stored(evidence), 10)


# -- generation over a bigram table of event types


_BIGRAMS = "bg AS (SELECT prev, term, n / CAST(sum(n) OVER (PARTITION BY prev) AS DOUBLE) AS p FROM (SELECT prev, term, count(*) AS n FROM (SELECT event_type AS term, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WHERE prev IS NOT NULL GROUP BY ALL))"


def _bigrams(t):
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    n = t("events").select(prev.alias("prev"), F.col("event_type").alias("term")).filter("prev IS NOT NULL").groupBy("prev", "term").agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.groupBy("prev").agg(F.sum("n").alias("_all")), "prev").select("prev", "term", (F.col("n") / F.col("_all")).alias("p"))


_U = "least(greatest(" + HASH.format("'{seed}|' || {by} || '|' || term") + ", 1e-9), 1 - 1e-9)"


def _draw(table: str, by: str, seed: str, tau: float) -> str:
    return f"SELECT {by}, term FROM (SELECT {by}, term, row_number() OVER (PARTITION BY {by} ORDER BY round(ln(p) / {tau} - ln(-ln({_U.format(seed=seed, by=by)})), 9) DESC, term DESC) AS r FROM {table}) WHERE r = 1"


@query("sample_temperature", f"WITH {_BIGRAMS}, u AS (SELECT DISTINCT user_id, prev, term, p FROM (SELECT user_id, max_by(event_type, event_id) AS prev FROM events GROUP BY user_id) JOIN bg USING (prev)) {_draw('u', 'user_id', 's', 0.7)}")
def sample_temperature(t):
    """A next event for each user, drawn from what follows their last one at temperature 0.7."""
    last = t("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("prev"))
    return G.sample_with_temperature(last.join(_bigrams(t), "prev"), "user_id", "term", F.ln("p"), 0.7, "s")


@query("generate", f"""WITH {_BIGRAMS}, a0 AS (SELECT DISTINCT event_type AS prompt_id, event_type AS prev FROM events),
    a1 AS ({_draw("(SELECT prompt_id, term, p FROM a0 JOIN bg USING (prev))", "prompt_id", "g0", 1.0)}), a2 AS ({_draw("(SELECT prompt_id, bg.term, p FROM a1 JOIN bg ON bg.prev = a1.term)", "prompt_id", "g1", 1.0)}),
    a3 AS ({_draw("(SELECT prompt_id, bg.term, p FROM a2 JOIN bg ON bg.prev = a2.term)", "prompt_id", "g2", 1.0)})
    SELECT prompt_id, a1.term || ' ' || a2.term || ' ' || a3.term AS text FROM a1 JOIN a2 USING (prompt_id) JOIN a3 USING (prompt_id)""")
def generate(t):
    """Three events after each type of event."""
    prompts = t("events").select(F.col("event_type").alias("prompt_id"), F.col("event_type").alias("prev")).distinct()
    return G.generate(prompts, _bigrams(t), 3, 1.0, "g")


def _step(no: int) -> str:
    before = " UNION ALL ".join(f"SELECT prompt_id FROM b{i} WHERE last = 'signup' AND n > 0" for i in range(no))
    grown = f"""SELECT prompt_id, bg.term AS last, trim(b{no - 1}.text || ' ' || bg.term) AS text, round(log_p + ln(p), 9) AS log_p, n + 1 AS n FROM b{no - 1} JOIN bg ON bg.prev = b{no - 1}.last
        WHERE (last <> 'signup' OR n = 0) AND prompt_id NOT IN (SELECT prompt_id FROM ({before}) GROUP BY prompt_id HAVING count(*) >= 3)"""
    return f"b{no} AS (SELECT prompt_id, last, text, log_p, n FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY log_p DESC, text) AS r FROM ({grown})) WHERE r <= 3)"


@query("beam_search", f"""WITH {_BIGRAMS}, b0 AS (SELECT DISTINCT event_type AS prompt_id, event_type AS last, '' AS text, 0.0::DOUBLE AS log_p, 0 AS n FROM events), {_step(1)}, {_step(2)}, {_step(3)},
    pool AS (SELECT *, CAST(last = 'signup' AS INT) AS e FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3) WHERE (last = 'signup' AND n > 0) OR n = 3)
    SELECT prompt_id, text, log_p FROM pool QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY e DESC, round(log_p / n, 9) DESC, n, text DESC) = 1""")
def beam_search(t):
    """The likeliest path of at most three events to a signup after each type of event, with three live hypotheses."""
    prompts = t("events").select(F.col("event_type").alias("prompt_id"), F.col("event_type").alias("prev")).distinct()
    return G.beam_search(prompts, _bigrams(t), 3, 3, "signup")
