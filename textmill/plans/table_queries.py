"""Retrieval, data quality, segmentation and base algebra."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions import text as X
from textmill.functions.arrays import ngrams
from textmill.operators import quality as Q
from textmill.operators import retrieval as S
from textmill.operators import terms as O
from textmill.operators.lineage import stored
from textmill.operators.ordering import place
from textmill.plans.registry import query
from textmill.plans.term_queries import BM25, TFIDF, bm25_top, n_docs, tfidf_cosine_topk
from textmill.plans.text_queries import ALNUM_SQL

HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0"


# -- retrieval


@query("chunk_fixed", f"""SELECT doc_id, start, md5(array_to_string(k[start + 1:start + 128], ' ')) AS chunk_md5 FROM
    (SELECT doc_id, k, unnest(range(0, greatest(len(k), 1), 112)) AS start FROM (SELECT doc_id, {ALNUM_SQL} AS k FROM documents) WHERE len(k) > 0)""")
def chunk_fixed(t):
    """Windows of 128 tokens that overlap by 16."""
    rows = t("documents").select("doc_id", X.alnum_tokens(F.col("text")).alias("k")).filter(F.size("k") > 0)
    starts = F.sequence(F.lit(0), F.size("k") - 1, F.lit(112))
    return rows.select("doc_id", "k", F.explode(starts).alias("start")).select("doc_id", F.col("start").cast("long"), F.md5(F.array_join(F.slice("k", F.col("start") + 1, F.lit(128)), " ")).alias("chunk_md5"))


GRAM4 = "unnest(list_transform(range(1, len(k) - 2), lambda i: array_to_string(k[i:i + 3], ' '))) AS gram"


@query("contamination_4gram", f"""WITH b AS (SELECT DISTINCT item_id, gram FROM (SELECT item_id, {GRAM4} FROM (SELECT item_id, {ALNUM_SQL} AS k FROM benchmark))),
    d AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, {GRAM4} FROM (SELECT doc_id, {ALNUM_SQL} AS k FROM documents)))
    SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (gram) GROUP BY ALL""")
def contamination_4gram(t):
    """Grams of documents that no item has are dropped where they arise."""
    def grams(df, key):
        rows = df.select(key, X.alnum_tokens(F.col("text")).alias("k"))
        return rows.select(key, F.explode(ngrams(F.col("k"), 4)).alias("gram"))

    asked = stored(grams(t("benchmark"), "item_id").distinct())
    held = grams(t("documents"), "doc_id").join(asked.select("gram"), "gram", "left_semi").distinct()
    return held.join(asked, "gram").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


_TFK = f"""tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
    (SELECT query_id, doc_id, round(sum(qw * w), 6) AS score FROM qw JOIN w USING (term) GROUP BY ALL)) WHERE rank <= 5)"""
RRF = f"""WITH {BM25}, bk AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored) WHERE rank <= 5),
    {TFIDF[TFIDF.index("idf AS"):]}, qt AS (SELECT item_id AS query_id, term, count(*) AS tf FROM (SELECT item_id, unnest({ALNUM_SQL}) AS term FROM benchmark) GROUP BY ALL),
    qx AS (SELECT query_id, term, tf * idf AS x FROM qt JOIN idf USING (term)), qw AS (SELECT query_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS qw FROM qx), {_TFK},
    u AS (SELECT query_id, doc_id, rank, 1 AS list FROM bk UNION ALL SELECT query_id, doc_id, rank, 2 FROM tk),
    f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS seen FROM u GROUP BY ALL)"""


def fused(t):
    keep = bm25_top(t, 5).select("query_id", "doc_id", "rank", F.lit(1).alias("list"))
    dense = tfidf_cosine_topk(t).select("query_id", "doc_id", "rank", F.lit(2).alias("list"))
    both = keep.unionByName(dense)
    return both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"), F.min(F.col("list") * 1000 + F.col("rank")).alias("seen"))


@query("rrf", f"{RRF} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM f")
def rrf(t):
    """Two rankings fused; ties in the order of first appearance."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return fused(t).select("query_id", "doc_id", "score", F.row_number().over(order).alias("rank"))


@query("interleave_merge", f"{RRF} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM (SELECT query_id, doc_id, min(rank * 10 + list) AS first FROM u GROUP BY ALL)")
def interleave_merge(t):
    keep = bm25_top(t, 5).select("query_id", "doc_id", "rank", F.lit(1).alias("list"))
    both = keep.unionByName(tfidf_cosine_topk(t).select("query_id", "doc_id", "rank", F.lit(2).alias("list")))
    first = both.groupBy("query_id", "doc_id").agg(F.min(F.col("rank") * 10 + F.col("list")).alias("first"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).alias("place"))


@query("recall_at_k", f"""WITH {BM25}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored),
    g AS (SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
    h AS (SELECT item_id, min(rank) AS best FROM g LEFT JOIN r ON r.query_id = item_id AND r.doc_id = g.doc_id AND rank <= 10 GROUP BY item_id)
    SELECT count(*) AS items, round(avg(CASE WHEN best <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0 / best, 0)), 6) AS mrr FROM h""")
def recall_at_k(t):
    """A document is evidence for an item if it holds the item's text; items without evidence don't count."""
    gold = S.containing(t("benchmark"), t("documents"), "item_id", "doc_id").select("item_id", "doc_id")
    ranked = bm25_top(t, 10).select(F.col("query_id").alias("item_id"), "doc_id", "rank")
    best = gold.join(ranked, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("rank").alias("best"))
    hit = lambda k: F.round(F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)), 6)
    return best.agg(F.count(F.lit(1)).alias("items"), hit(1).alias("recall_1"), hit(10).alias("recall_10"), F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"))


@query("unique_sentences", r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS para FROM documents),
    q AS (SELECT doc_id, trim(regexp_replace(para, '\s+', ' ', 'g')) AS flat FROM p WHERE NOT regexp_matches(para, '^(?:[#|$\-`!]|1\.)') AND NOT contains(para, '$') AND NOT contains(para, '`')),
    s AS (SELECT DISTINCT doc_id, unnest(string_split(regexp_replace(flat, '([.!?]) ([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sentence FROM q)
    SELECT doc_id, instr(text, sentence) AS at, sentence FROM s JOIN documents USING (doc_id) WHERE len(string_split(sentence, ' ')) BETWEEN 12 AND 40 AND (length(text) - length(replace(text, sentence, ''))) // length(sentence) = 1""")
def unique_sentences(t):
    """Sentences of 12 to 40 words that the whole text of their document holds exactly once, with their place from 1.

    Paragraphs of markup, formulas and code have none. A sentence that white space other than one space interrupts is not in the text as it reads here."""
    prose = F.filter(F.split("text", "\n\n"), lambda p: ~p.rlike(r"^(?:[#|$\-`!]|1\.)") & ~p.contains("$") & ~p.contains("`"))
    parts = F.flatten(F.transform(prose, lambda p: X.sentences(X.collapse(p))))
    sized = F.array_distinct(F.filter(parts, lambda s: F.size(F.split(s, " ")).between(12, 40)))
    rows = t("documents").select("doc_id", "text", sized.alias("parts")).withColumn("parts", F.expr("transform(parts, s -> struct(instr(text, s) AS at, s AS sentence))"))
    once = F.expr("filter(parts, x -> x.at > 0 AND locate(x.sentence, text, x.at + length(x.sentence)) = 0)")
    return rows.select("doc_id", F.explode(once).alias("x")).select("doc_id", F.col("x.at").cast("long").alias("at"), "x.sentence")


# -- quality


@query("validation_errors", "SELECT event_id, unnest(list_filter([CASE WHEN NOT (value >= 1) THEN 'value_low' END, CASE WHEN NOT (event_type IN ('click', 'view', 'purchase')) THEN 'type' END, CASE WHEN NOT (CAST(props->>'$.k' AS INT) < 90) THEN 'k_high' END], lambda x: x IS NOT NULL)) AS rule FROM events")
def validation_errors(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return Q.validate(t("events"), "event_id", {"value_low": F.col("value") >= 1, "type": F.col("event_type").isin("click", "view", "purchase"), "k_high": k < 90})


@query("duplicate_ids", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(t):
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("split_leakage", "SELECT sha256(text) AS sha, count_if(doc_id % 2 = 0) AS train, count_if(doc_id % 2 = 1) AS test FROM documents GROUP BY text HAVING train > 0 AND test > 0")
def split_leakage(t):
    by = t("documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count_if(F.col("doc_id") % 2 == 0).alias("train"), F.count_if(F.col("doc_id") % 2 == 1).alias("test"))
    return by.filter("train > 0 AND test > 0")


@query("largest_remainder", "WITH c AS (SELECT source, 500.0::DOUBLE * count(*) / sum(count(*)) OVER () AS e FROM documents GROUP BY source), r AS (SELECT source, floor(e) AS b, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, source) AS place, 500 - sum(floor(e)) OVER () AS left_over FROM c) SELECT source, CAST(b + CAST(place <= left_over AS INT) AS BIGINT) AS n FROM r")
def largest_remainder(t):
    return Q.largest_remainder(t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("w")), "source", "w", 500)


@query("stratified_sample", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('s1|' || doc_id)) <= 20")
def stratified_sample(t):
    return Q.stratified_sample(t("documents").select("doc_id", "lang"), "lang", "doc_id", 20, "s1")


@query("flip_labels", f"SELECT doc_id, CASE WHEN {HASH.format(chr(39) + 'flip|' + chr(39) + ' || doc_id')} < 0.1 THEN 1 - toxic ELSE toxic END AS noisy FROM labels")
def flip_labels(t):
    return t("labels").select("doc_id", F.when(Q.hash_uniform(F.lit("flip"), F.col("doc_id")) < 0.1, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("noisy"))


@query("length_filtered_split", f"SELECT doc_id, CASE WHEN {HASH.format(chr(39) + 'split|' + chr(39) + ' || doc_id')} < 0.9 THEN 'train' ELSE 'test' END AS split FROM documents WHERE n_chars BETWEEN 200 AND 20000")
def length_filtered_split(t):
    return t("documents").filter(F.col("n_chars").between(200, 20000)).select("doc_id", F.when(Q.hash_uniform(F.lit("split"), F.col("doc_id")) < 0.9, "train").otherwise("test").alias("split"))


@query("mlm_mask", f"""WITH x AS (SELECT doc_id, p, {HASH.format("doc_id || '|' || p")} AS u FROM (SELECT doc_id, unnest(range(0, len({ALNUM_SQL}))) AS p FROM documents))
    SELECT doc_id, count_if(u < 0.12) AS masked, count_if(u >= 0.12 AND u < 0.135) AS random, count_if(u >= 0.135 AND u < 0.15) AS same FROM x GROUP BY doc_id""")
def mlm_mask(t):
    """15 % of the tokens are chosen; of these 80 % are masked, 10 % replaced and 10 % left."""
    tokens = O.token_table(t("documents"), tokens=X.alnum_tokens)
    u = Q.hash_uniform(F.col("doc_id"), F.col("pos"))
    rows = tokens.select("doc_id", u.alias("u"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("u") < 0.12).alias("masked"), F.count_if((F.col("u") >= 0.12) & (F.col("u") < 0.135)).alias("random"), F.count_if((F.col("u") >= 0.135) & (F.col("u") < 0.15)).alias("same"))


@query("response_labels", "SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(text, '\\S+')) ELSE 0 END) AS learned, sum(len(regexp_extract_all(text, '\\S+'))) AS tokens FROM conversations GROUP BY conv_id")
def response_labels(t):
    n = F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)))
    return t("conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("learned"), F.sum(n).alias("tokens"))


@query("vocab_intersect", f"SELECT term FROM (SELECT unnest({ALNUM_SQL}) AS term FROM documents WHERE lang = 'en') INTERSECT SELECT term FROM (SELECT unnest({ALNUM_SQL}) AS term FROM documents WHERE lang = 'de')")
def vocab_intersect(t):
    words = lambda lang: t("documents").filter(F.col("lang") == lang).select(F.explode(X.alnum_tokens(F.col("text"))).alias("term"))
    return words("en").intersect(words("de"))


@query("vocab_except", f"SELECT term FROM (SELECT unnest({ALNUM_SQL}) AS term FROM benchmark) EXCEPT SELECT term FROM (SELECT unnest({ALNUM_SQL}) AS term FROM documents)")
def vocab_except(t):
    words = lambda name: t(name).select(F.explode(X.alnum_tokens(F.col("text"))).alias("term"))
    return words("benchmark").subtract(words("documents"))


@query("union_lists", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def union_lists(t):
    return t("orders").select(F.col("o_custkey").alias("k")).union(t("customer").select("c_custkey")).distinct()


@query("distinct_first_seen", "SELECT event_type, min(event_id) AS first, row_number() OVER (ORDER BY min(event_id)) AS place FROM events GROUP BY event_type")
def distinct_first_seen(t):
    first = t("events").groupBy("event_type").agg(F.min("event_id").alias("first"))
    return place(first, [F.col("first")], "place")


@query("top_values", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 12")
def top_values(t):
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(12)


@query("modal_label", "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang) WHERE r = 1")
def modal_label(t):
    n = t("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("lang"))


@query("stats_zero_filled", "SELECT s.source, l.lang, count(d.doc_id) AS n FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (SELECT DISTINCT lang FROM documents) l LEFT JOIN documents d ON d.source = s.source AND d.lang = l.lang GROUP BY ALL")
def stats_zero_filled(t):
    """Pivot and unpivot over the few languages fill the gaps; nothing is crossed."""
    langs = [r.lang for r in t("documents").select("lang").distinct().orderBy("lang").collect()]
    wide = t("documents").groupBy("source").agg(*(F.count_if(F.col("lang") == x).alias(x) for x in langs))
    return wide.unpivot(["source"], langs, "lang", "n")


@query("multiset_equal", "SELECT event_id, list_sort(string_split(CAST(event_id AS VARCHAR), '')) = list_sort(string_split(CAST(event_id AS VARCHAR)[2:] || CAST(user_id AS VARCHAR)[1:1], '')) AS equal FROM events")
def multiset_equal(t):
    """Whether two numbers have the same digits, each as often: the event's, and that with its first digit put for the user's."""
    digits = lambda c: F.array_sort(F.split(c, ""))
    event, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    other = F.concat(F.substring(event, F.lit(2), F.length(event)), F.substring(user, 1, 1))
    return t("events").select("event_id", (digits(event) == digits(other)).alias("equal"))


# -- segmentation


@query("rfm", "SELECT o_custkey, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2002-01-01') AS recency, count(DISTINCT o_orderkey) AS frequency, round(sum(o_totalprice), 2) AS monetary FROM orders GROUP BY o_custkey")
def rfm(t):
    return t("orders").groupBy("o_custkey").agg(F.datediff(F.lit("2002-01-01").cast("date"), F.max("o_orderdate")).cast("long").alias("recency"), F.countDistinct("o_orderkey").alias("frequency"), F.round(F.sum("o_totalprice"), 2).alias("monetary"))


@query("rfm_z", "WITH r AS (SELECT o_custkey, ln(1 + count(DISTINCT o_orderkey)) AS f, ln(1 + sum(o_totalprice)) AS m FROM orders GROUP BY o_custkey) SELECT o_custkey, round((f - avg(f) OVER ()) / stddev_pop(f) OVER (), 5) AS zf, round((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 5) AS zm FROM r")
def rfm_z(t):
    r = t("orders").groupBy("o_custkey").agg(F.log1p(F.countDistinct("o_orderkey")).alias("f"), F.log1p(F.sum("o_totalprice")).alias("m"))
    s = r.agg(F.avg("f").alias("af"), F.stddev_pop("f").alias("sf"), F.avg("m").alias("am"), F.stddev_pop("m").alias("sm"))
    return r.join(F.broadcast(s)).select("o_custkey", F.round((F.col("f") - F.col("af")) / F.col("sf"), 5).alias("zf"), F.round((F.col("m") - F.col("am")) / F.col("sm"), 5).alias("zm"))


@query("segment_names", "WITH r AS (SELECT o_custkey, count(*) AS f FROM orders GROUP BY o_custkey), s AS (SELECT CASE WHEN f >= 20 THEN 'loyal' WHEN f >= 10 THEN 'regular' ELSE 'rare' END AS name, count(*) AS n, min(f) AS low FROM r GROUP BY f) SELECT name || ' ' || row_number() OVER (PARTITION BY name ORDER BY low DESC) AS segment, n FROM s")
def segment_names(t):
    r = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("f"))
    name = F.when(F.col("f") >= 20, "loyal").when(F.col("f") >= 10, "regular").otherwise("rare")
    s = r.groupBy("f").agg(F.count(F.lit(1)).alias("n")).withColumn("name", name)
    order = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("f")))
    return s.select(F.concat_ws(" ", "name", order.cast("string")).alias("segment"), "n")


@query("contacts", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND b.c_custkey - a.c_custkey >= 3 AND abs(a.c_acctbal - b.c_acctbal) <= 8")
def contacts(t):
    """A range self-join: rows meet in cells as wide as the range, each in its own and the next."""
    c = t("customer").select("c_nationkey", "c_custkey", "c_acctbal", F.floor(F.col("c_acctbal") / 8).alias("cell"))
    left = c.select("c_nationkey", F.col("c_custkey").alias("a"), F.col("c_acctbal").alias("x"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    right = c.select("c_nationkey", F.col("c_custkey").alias("b"), F.col("c_acctbal").alias("y"), "cell")
    near = left.join(right, ["c_nationkey", "cell"]).filter((F.col("b") - F.col("a") >= 3) & (F.abs(F.col("x") - F.col("y")) <= 8))
    return near.select("a", "b")


@query("degree_count", "WITH p AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND b.c_custkey - a.c_custkey >= 3 AND abs(a.c_acctbal - b.c_acctbal) <= 8) SELECT k, count(*) AS degree FROM (SELECT a AS k FROM p UNION ALL SELECT b FROM p) GROUP BY k")
def degree_count(t):
    p = contacts(t)
    return p.select(F.col("a").alias("k")).union(p.select("b")).groupBy("k").agg(F.count(F.lit(1)).alias("degree"))


# -- base algebra


@query("join_records_items", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_records_items(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("o_orderkey", "c_name", "n_name", "r_name")


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(t):
    return t("customer").join(t("orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("cross_join_pairs", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join_pairs(t):
    return t("region").crossJoin(t("nation")).select("r_name", "n_name")


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"))


@query("rollup_sales", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_sales(t):
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("cube_parts", "SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY CUBE (p_brand, p_type)")
def cube_parts(t):
    return t("part").cube("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("full_outer", "SELECT coalesce(s_nationkey, c_nationkey) AS nation, coalesce(s, 0) AS suppliers, coalesce(c, 0) AS customers FROM (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON s_nationkey = c_nationkey")
def full_outer(t):
    s = t("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = t("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    return s.join(c, "nation", "full").fillna(0, ["suppliers", "customers"])
