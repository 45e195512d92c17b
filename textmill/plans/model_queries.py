"""Sequences, rewards, prices, messages and time tables: the smaller functions around models and their records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions import arrays as A
from textmill.functions import text as X
from textmill.operators import quality as Q
from textmill.operators import sequences as S
from textmill.operators import terms as O
from textmill.operators import vectors as V
from textmill.operators.lineage import stored
from textmill.operators.windows import average_rank
from textmill.plans.record_queries import REC, UNIT, rec
from textmill.plans.registry import query
from textmill.plans.table_queries import HASH
from textmill.plans.term_queries import BM25, bm25_top
from textmill.plans.text_queries import ALNUM_SQL

_IDS = "ids AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '\\S+'), lambda w: length(w)) AS ids FROM conversations)"


def _word_lengths(t):
    words = F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))
    return t("conversations").select("conv_id", "turn", "role", F.transform(words, lambda w: F.length(w)).alias("ids"))


@query("ids_until_end", f"WITH {_IDS} SELECT conv_id, turn, CAST(CASE WHEN list_position(ids, 9) > 0 THEN list_position(ids, 9) - 1 ELSE len(ids) END AS BIGINT) AS n FROM ids")
def ids_until_end(t):
    """How many ids, here the lengths of words, come before the first end mark, 9."""
    return _word_lengths(t).select("conv_id", "turn", F.size(S.ids_until(F.col("ids"), 9)).cast("long").alias("n"))


@query("encode_batch", f"WITH {_IDS}, m AS (SELECT conv_id, max(len(ids)) AS most FROM ids GROUP BY conv_id) SELECT conv_id, turn, CAST(len(ids) AS BIGINT) AS length, CAST(most AS BIGINT) AS width, CAST(coalesce(list_sum(ids), 0) AS BIGINT) AS total FROM ids JOIN m USING (conv_id)")
def encode_batch(t):
    """The turns of a conversation as one padded batch: the length, the width, and the sum of all ids, pads counting nothing."""
    rows = S.encode_batch(_word_lengths(t).drop("role"), "conv_id", "ids", 0)
    total = F.aggregate("ids", F.lit(0), lambda a, x: a + x)
    return rows.select("conv_id", "turn", F.col("length").cast("long").alias("length"), F.size("mask").cast("long").alias("width"), total.cast("long").alias("total"))


@query("response_loss", "WITH r AS (SELECT conv_id, turn, role, unnest(list_transform(regexp_extract_all(text, '\\S+'), lambda w: length(w))) AS x FROM conversations) SELECT count_if(role = 'assistant') AS n, round(avg(x / 10.0::DOUBLE) FILTER (role = 'assistant'), 6) AS loss, round(exp(avg(x / 10.0::DOUBLE) FILTER (role = 'assistant')), 6) AS perplexity, round(avg(x / 10.0::DOUBLE) FILTER (role = 'assistant') / ln(2), 6) AS bits FROM r")
def response_loss(t):
    """Loss, perplexity and bits over the response's tokens only; a tenth of a word's length stands for its log loss."""
    rows = _word_lengths(t).select("role", F.explode("ids").alias("x"))
    found = S.loss_and_perplexity(rows, -F.col("x") / 10.0, F.col("role") == "assistant")
    return found.select("n", *(F.round(c, 6).alias(c) for c in ("loss", "perplexity", "bits")))


@query("response_mask", f"WITH {_IDS}, r AS (SELECT conv_id, turn, role FROM conversations) SELECT conv_id, turn, array_to_string(list_transform(ids, lambda x: CASE WHEN role = 'assistant' THEN x ELSE -100 END), ' ') AS labels FROM ids JOIN r USING (conv_id, turn)")
def response_mask(t):
    """Labels of each turn: its ids if the assistant speaks, -100 elsewhere."""
    rows = _word_lengths(t)
    learned = F.transform("ids", lambda _: F.col("role") == "assistant")
    return rows.select("conv_id", "turn", F.array_join(F.transform(S.masked_labels(F.col("ids"), learned), lambda x: x.cast("string")), " ").alias("labels"))


_UV = "list_transform(range(len(k)), lambda p: " + HASH.format("'{}|' || doc_id || '|' || p") + ")"


@query("mask_tokens", f"""WITH k AS (SELECT doc_id, {ALNUM_SQL} AS k FROM documents), z AS (SELECT doc_id, list_transform(k, lambda w: length(w)) AS ids, {_UV.format("u")} AS u, {_UV.format("v")} AS v FROM k),
    c AS (SELECT doc_id, unnest(ids) AS id, unnest(u) AS u, unnest(v) AS v FROM z)
    SELECT doc_id, CAST(sum(CASE WHEN u < 0.12 THEN 1000 WHEN u < 0.135 THEN CAST(floor(v * 500) AS INT) ELSE id END) AS BIGINT) AS inputs, CAST(sum(CASE WHEN u < 0.15 THEN id ELSE -100 END) AS BIGINT) AS labels FROM c GROUP BY doc_id""")
def mask_tokens(t):
    """Corrupted inputs and labels of masked language modelling, as the sums of their ids; 1000 is the mask."""
    rows = t("documents").select("doc_id", X.alnum_tokens(F.col("text")).alias("k")).filter(F.size("k") > 0)
    number = lambda name: F.transform("k", lambda _, p: Q.hash_uniform(F.lit(name), F.col("doc_id"), p))
    rows = rows.select("doc_id", "k", F.transform("k", lambda w: F.length(w)).alias("ids"), number("u").alias("u"))
    # The second number counts only where the first one chose a token.
    second = F.transform("u", lambda u, p: F.when(u < 0.15, Q.hash_uniform(F.lit("v"), F.col("doc_id"), p)).otherwise(0.0))
    rows = rows.select("doc_id", "ids", "u", second.alias("v"))
    x = rows.select("doc_id", S.mask_tokens(F.col("ids"), F.col("u"), F.col("v"), 1000, 500).alias("x"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    return x.select("doc_id", total("x.inputs").alias("inputs"), total("x.labels").alias("labels"))


@query("token_logprobs", f"WITH {UNIT} SELECT vec_id, round(v[label + 1], 6) AS gathered, round(list_sum(v[1:label + 1]), 6) AS total FROM u")
def token_logprobs(t):
    """The entry of each vector at its label, and the sum up to it: a gather by action and a masked sum."""
    rows = t("embeddings").select("vec_id", "label", A.doubles(F.col("embedding")).alias("v"))
    one = S.gathered(F.array("v"), F.array("label"))[0]
    mask = F.transform("v", lambda _, i: (i <= F.col("label")).cast("int"))
    return rows.select("vec_id", F.round(one, 6).alias("gathered"), F.round(S.sequence_logprob(F.col("v"), mask), 6).alias("total"))


@query("exact_objective", f"""WITH {REC}, p AS (SELECT event_type, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM rec GROUP BY event_type)
    SELECT round(sum(a.p * b.p * (CAST(a.event_type = 'click' AS INT) + CAST(b.event_type = 'view' AS INT)) / 2.0), 6) AS objective, count(*) AS responses FROM p a, p b""")
def exact_objective(t):
    """The expected share of matches with (click, view), summed over all responses of two symbols."""
    n = rec(t).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    all_ = n.agg(F.sum("n").alias("s"))
    p = n.join(F.broadcast(all_)).select("event_type", (F.col("n") / F.col("s")).alias("p"))
    both = p.crossJoin(F.broadcast(p.select(F.col("event_type").alias("second"), F.col("p").alias("q"))))
    match = ((F.col("event_type") == "click").cast("int") + (F.col("second") == "view").cast("int")) / 2.0
    return both.agg(F.round(F.sum(F.col("p") * F.col("q") * match), 6).alias("objective"), F.count(F.lit(1)).alias("responses"))


PAIRS_SQL = "pr AS (SELECT conv_id, max(length(text)) / 100.0::DOUBLE AS a, min(length(text)) / 100.0::DOUBLE AS b FROM conversations GROUP BY conv_id)"


@query("label_pairs", f"WITH {PAIRS_SQL} SELECT conv_id, CASE WHEN {HASH.format(chr(39) + 'pair|' + chr(39) + ' || conv_id')} < 1 / (1 + exp(-(a - b) / 0.5)) THEN 'first' ELSE 'second' END AS winner FROM pr")
def label_pairs(t):
    """The winner of each pair, drawn with the probability that its scores give."""
    rows = t("conversations").groupBy("conv_id").agg((F.max(F.length("text")) / 100.0).alias("a"), (F.min(F.length("text")) / 100.0).alias("b"))
    p = 1 / (1 + F.exp(-(F.col("a") - F.col("b")) / 0.5))
    return rows.select("conv_id", F.when(Q.hash_uniform(F.lit("pair"), F.col("conv_id")) < p, "first").otherwise("second").alias("winner"))


@query("evaluate_reward_model", f"""WITH {REC}, p AS (SELECT event_id // 2 AS pair, max(conf) FILTER (event_id % 2 = 0) AS rw, max(conf) FILTER (event_id % 2 = 1) AS rl, max(value) FILTER (event_id % 2 = 0) AS gw, max(value) FILTER (event_id % 2 = 1) AS gl FROM rec GROUP BY 1),
    q AS (SELECT * FROM p WHERE rw IS NOT NULL AND rl IS NOT NULL AND gw IS NOT NULL AND gl IS NOT NULL)
    SELECT round(avg(CAST(rw > rl AS INT)), 6) AS heldout_acc, round(avg(greatest(1 / (1 + exp(-(gw - gl) / 10)), 1 - 1 / (1 + exp(-(gw - gl) / 10)))), 6) AS oracle_acc, round(avg(CAST((rw > rl) = (gw > gl) AS INT)) FILTER (gw <> gl), 6) AS acc_gold_order_untied, count_if(gw <> gl) AS untied,
    (SELECT round(corr(rr, gr), 6) FROM (SELECT rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0::DOUBLE AS rr, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0::DOUBLE AS gr
        FROM (SELECT rw AS r, gw AS g FROM q UNION ALL SELECT rl, gl FROM q))) AS spearman_gold FROM q""")
def evaluate_reward_model(t):
    """Accuracy of a reward on pairs, that of an oracle, the order on pairs whose gold scores differ, and the rank correlation with gold over
    both sides of all pairs."""
    side = lambda c, r: F.max(F.when(F.col("event_id") % 2 == r, F.col(c)))
    p = rec(t).groupBy(F.expr("event_id div 2").alias("pair")).agg(side("conf", 0).alias("rw"), side("conf", 1).alias("rl"), side("value", 0).alias("gw"), side("value", 1).alias("gl")).dropna()
    rw, rl, gw, gl = (F.col(c) for c in ("rw", "rl", "gw", "gl"))
    right = 1 / (1 + F.exp(-(gw - gl) / 10))
    same = F.when(gw != gl, ((rw > rl) == (gw > gl)).cast("int"))
    sides = p.select(F.explode(F.array(F.struct(rw.alias("r"), gw.alias("g")), F.struct(rl.alias("r"), gl.alias("g")))).alias("s")).select("s.r", "s.g")
    ranked = average_rank(average_rank(stored(sides), "r", "rr"), "g", "gr").agg(F.round(F.corr("rr", "gr"), 6).alias("spearman_gold"))
    found = p.agg(F.round(F.avg((rw > rl).cast("int")), 6).alias("heldout_acc"), F.round(F.avg(F.greatest(right, 1 - right)), 6).alias("oracle_acc"), F.round(F.avg(same), 6).alias("acc_gold_order_untied"), F.count_if(gw != gl).alias("untied"))
    return found.join(F.broadcast(ranked))


@query("compute_metrics", f"""WITH {REC}, pr AS (SELECT correct AS actual, CAST(conf >= 0.5 AS INT) AS predicted FROM rec), c AS (SELECT l, count_if(actual = l AND predicted = l) AS tp, count_if(actual = l) AS na, count_if(predicted = l) AS np FROM pr, (SELECT unnest([0, 1]) AS l) GROUP BY l)
    SELECT (SELECT round(avg(CAST(actual = predicted AS INT)), 6) FROM pr) AS accuracy, round(avg(coalesce(2.0 * tp / nullif(na + np, 0), 0)), 6) AS macro_f1 FROM c""")
def compute_metrics(t):
    """Accuracy and the mean F1 of the classes."""
    pairs = rec(t).select(F.col("correct").alias("actual"), (F.col("conf") >= 0.5).cast("int").alias("predicted"))
    accuracy = pairs.agg(F.round(F.avg((F.col("actual") == F.col("predicted")).cast("int")), 6).alias("accuracy"))
    return accuracy.join(F.broadcast(O.confusion_metrics(pairs).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))))


@query("neighbor_hit_rate", f"""WITH {UNIT}, s AS (SELECT a.vec_id AS query, a.label AS want, b.label AS got, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id) AS r FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
    SELECT count(*) AS probes, round(avg(hit), 6) AS rate FROM (SELECT query, max(CAST(got = want AS INT)) AS hit FROM s WHERE r <= 10 GROUP BY query)""")
def neighbor_hit_rate(t):
    """The share of probes, ids divisible by 20, with a row of their own label among the ten nearest."""
    e = t("embeddings").select("vec_id", "embedding", "label")
    near = V.knn(e.filter("vec_id % 20 = 0"), e, 10)
    label = lambda key, name: e.select(F.col("vec_id").alias(key), F.col("label").alias(name))
    hits = near.join(label("vec_id", "got"), "vec_id").join(label("query", "want"), "query").groupBy("query").agg(F.max((F.col("got") == F.col("want")).cast("int")).alias("hit"))
    return hits.agg(F.count(F.lit(1)).alias("probes"), F.round(F.avg("hit"), 6).alias("rate"))


@query("reward_rows", f"WITH {REC} SELECT event_type, round(avg(CASE WHEN correct = 1 THEN conf ELSE 1 - conf END), 6) AS accuracy, round(avg(-((conf - correct) * (conf - correct) + (1 - conf - (1 - correct)) * (1 - conf - (1 - correct)))), 6) AS brier FROM rec GROUP BY event_type")
def reward_rows(t):
    """Rewards of probabilities over two labels by type: that of the true label, and minus the squared error."""
    p = F.array(1 - F.col("conf"), F.col("conf"))
    chosen = F.element_at(p, F.col("correct") + 1)
    error = A.total(F.transform(p, lambda x, i: (x - (i == F.col("correct")).cast("double")) * (x - (i == F.col("correct")).cast("double"))))
    return rec(t).groupBy("event_type").agg(F.round(F.avg(chosen), 6).alias("accuracy"), F.round(F.avg(-error), 6).alias("brier"))


@query("option_probs", f"WITH {UNIT}, o AS (SELECT vec_id, list_transform([v[3], v[7], v[11]], lambda x: exp(x)) AS e FROM u) SELECT vec_id, round(e[1] / list_sum(e), 6) AS a, round(e[2] / list_sum(e), 6) AS b, round(e[3] / list_sum(e), 6) AS c FROM o")
def option_probs(t):
    """The softmax over the logits of three options' first tokens, here places 3, 7 and 11."""
    z = A.doubles(F.col("embedding"))
    rows = t("embeddings").select("vec_id", F.array(*(F.element_at(z, i) for i in (3, 7, 11))).alias("z")).select("vec_id", A.softmax(F.col("z")).alias("p"))
    return rows.select("vec_id", *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate("abc")))


@query("column_price", "SELECT event_type, CASE WHEN starts_with(event_type, 'p') THEN 3.0 WHEN starts_with(event_type, 's') THEN 1.5 ELSE 0.0 END::DOUBLE AS price, round(sum(value) * CASE WHEN starts_with(event_type, 'p') THEN 3.0 WHEN starts_with(event_type, 's') THEN 1.5 ELSE 0.0 END / 1000, 6) AS usd FROM events GROUP BY event_type")
def column_price(t):
    """Prices by the beginning of a label, and the cost of each label's units by the thousand."""
    price = F.when(F.startswith("event_type", F.lit("p")), 3.0).when(F.startswith("event_type", F.lit("s")), 1.5).otherwise(0.0)
    return t("events").groupBy("event_type").agg(F.sum("value").alias("_v")).select("event_type", price.alias("price"), F.round(F.col("_v") * price / 1000, 6).alias("usd"))


@query("allowed_state", "SELECT event_id, to_json(struct_pack(event_type := event_type, value := value)) AS state FROM events")
def allowed_state(t):
    """Records with the allowed fields only; labels and keys stay out."""
    return t("events").select("event_id", F.to_json(F.struct("event_type", "value")).alias("state"))


@query("guard_set", "SELECT event_id, 'attack' AS family, 0 AS allowed FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'plain', 1 FROM events WHERE event_type = 'purchase'")
def guard_set(t):
    """Two families of records with their labels."""
    part = lambda kind, family, allowed: t("events").filter(F.col("event_type") == kind).select("event_id", F.lit(family).alias("family"), F.lit(allowed).alias("allowed"))
    return part("error", "attack", 0).unionByName(part("purchase", "plain", 1))


@query("answerable", "SELECT item_id, count(*) AS pages FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id")
def answerable(t):
    """Items with evidence: the documents that hold their text."""
    from textmill.operators.retrieval import containing

    return containing(t("benchmark"), t("documents"), "item_id", "doc_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("pages"))


@query("user_messages", "SELECT conv_id, count(*) AS messages, string_agg(role, '>' ORDER BY turn) AS roles, sha256(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user')) AS user_sha FROM conversations GROUP BY conv_id")
def user_messages(t):
    """A conversation's messages in order: how many, their roles, and a digest of the user's."""
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    user = F.filter("m", lambda x: x["role"] == "user")
    said = F.when(F.size(user) > 0, F.sha2(F.array_join(F.transform(user, lambda x: x["text"]), "\n"), 256))
    return rows.select("conv_id", F.size("m").cast("long").alias("messages"), F.array_join(F.transform("m", lambda x: x["role"]), ">").alias("roles"), said.alias("user_sha"))


@query("get_event", "SELECT o_orderkey, CASE WHEN c_name IS NULL THEN 'error: no customer ' || key ELSE c_name END AS found FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN -o_custkey ELSE o_custkey END AS key FROM orders) LEFT JOIN customer ON c_custkey = key")
def get_event(t):
    """A keyed lookup with an error text where there is no such key."""
    keys = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("key"))
    joined = keys.join(t("customer"), F.col("c_custkey") == F.col("key"), "left")
    return joined.select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("error: no customer "), F.col("key").cast("string"))).alias("found"))


@query("email_of", "SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '.', 'g')) || '@example.org' AS email FROM customer")
def email_of(t):
    return t("customer").select("c_custkey", F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]+", ".")), F.lit("@example.org")).alias("email"))


@query("search_docs", f"WITH {BM25}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scored), h AS (SELECT query_id, doc_id, rank FROM r JOIN documents USING (doc_id) JOIN benchmark ON item_id = query_id WHERE rank <= 10 AND contains(lower(documents.text), lower(string_split(benchmark.text, ' ')[1]))) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM h QUALIFY place <= 3")
def search_docs(t):
    """The first three of BM25's best ten that hold the query's first word."""
    top = bm25_top(t, 10).select("query_id", "doc_id", "rank")
    word = t("benchmark").select(F.col("item_id").alias("query_id"), F.lower(F.split("text", " ")[0]).alias("w"))
    hits = top.join(t("documents").select("doc_id", "text"), "doc_id").join(word, "query_id").filter(F.contains(F.lower("text"), F.col("w")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return hits.select("query_id", "doc_id", place.alias("place")).filter("place <= 3")


@query("segment_leakage", "WITH s AS (SELECT doc_id % 2 AS part, unnest(string_split(text, '. ')) AS seg FROM documents) SELECT sha256(seg) AS seg_sha, count_if(part = 0) AS train, count_if(part = 1) AS test FROM s WHERE length(seg) >= 20 GROUP BY seg HAVING train > 0 AND test > 0")
def segment_leakage(t):
    """Segments of text that both halves of the documents have."""
    seg = t("documents").select((F.col("doc_id") % 2).alias("part"), F.explode(F.split("text", r"\. ")).alias("seg")).filter(F.length("seg") >= 20)
    n = seg.groupBy("seg").agg(F.count_if(F.col("part") == 0).alias("train"), F.count_if(F.col("part") == 1).alias("test")).filter("train > 0 AND test > 0")
    return n.select(F.sha2("seg", 256).alias("seg_sha"), "train", "test")


@query("run_sheet", f"WITH {REC} SELECT user_id, event_id, CAST(540 + coalesce(sum(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(540 + sum(k) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS stop FROM rec")
def run_sheet(t):
    """Start and stop in minutes of the day of entries that follow each other from nine o'clock."""
    return S.run_sheet(rec(t).select("user_id", "event_id", "k"), "user_id", "event_id", "k", 540).select("user_id", "event_id", "start", "stop")


@query("days_label", "SELECT user_id, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last, strftime(min(ts), '%d') || CASE WHEN CAST(min(ts) AS DATE) < CAST(max(ts) AS DATE) THEN '-' || strftime(max(ts), '%d') ELSE '' END AS label, CAST(sum(CAST(props->>'$.k' AS INT)) AS BIGINT) AS minutes FROM events GROUP BY user_id")
def days_label(t):
    """The range of a group's days as a label, and its minutes."""
    day = F.col("ts").cast("date")
    k = F.get_json_object("props", "$.k").cast("int")
    two = lambda c: F.lpad(F.dayofmonth(c).cast("string"), 2, "0")
    rows = t("events").groupBy("user_id").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.sum(k).alias("minutes"))
    label = F.when(F.col("first") < F.col("last"), F.concat(two("first"), F.lit("-"), two("last"))).otherwise(two("first"))
    return rows.select("user_id", "first", "last", label.alias("label"), "minutes")


@query("gradient_by_distance", "WITH l AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id) SELECT last - event_id AS distance, round(avg(value), 6) AS mean, count(*) AS n FROM events JOIN l USING (user_id) GROUP BY 1")
def gradient_by_distance(t):
    """The mean value by how far an event is from its user's last."""
    return S.by_distance(t("events"), "user_id", "event_id", "value").select("distance", F.round("mean", 6).alias("mean"), "n")


@query("alignment_hits", f"WITH {UNIT}, a AS (SELECT list_position(v, list_max(v)) - 1 AS best, label * 6 AS s FROM u) SELECT count_if(best >= s AND best < s + 7) AS hits, count(*) AS total, round(avg(CAST(best >= s AND best < s + 7 AS INT)), 6) AS rate FROM a")
def alignment_hits(t):
    """How often the largest entry of a vector lies in its label's span of six places, or one behind it."""
    rows = t("embeddings").select(A.doubles(F.col("embedding")).alias("w"), (F.col("label") * 6).alias("start"), (F.col("label") * 6 + 6).alias("stop"))
    return S.alignment_hit_rate(rows, "w", "start", "stop").select("hits", "total", F.round("rate", 6).alias("rate"))


@query("add_k_log_probs", """WITH c AS (SELECT prev AS context, event_type AS symbol, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WHERE prev IS NOT NULL GROUP BY ALL), a AS (SELECT DISTINCT event_type AS symbol FROM events)
    SELECT x.context, a.symbol, round(ln((coalesce(n, 0) + 0.5) / (total + 0.5 * (SELECT count(*) FROM a))), 6) AS log_p FROM (SELECT context, sum(n) AS total FROM c GROUP BY context) x CROSS JOIN a LEFT JOIN c ON c.context = x.context AND c.symbol = a.symbol""")
def add_k_log_probs(t):
    """Smoothed log probabilities of every next type of event after every one that was seen."""
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    counts = t("events").select(prev.alias("context"), F.col("event_type").alias("symbol")).filter("context IS NOT NULL").groupBy("context", "symbol").agg(F.count(F.lit(1)).alias("n"))
    found = S.add_k_log_probs(counts, t("events").select(F.col("event_type").alias("symbol")).distinct(), 0.5)
    return found.withColumn("log_p", F.round("log_p", 6))


@query("synthetic_purchases")
def synthetic_purchases(t):
    """Made-up purchases of 300 customers."""
    from textmill.sources.synthetic import purchases

    return purchases(t("region").sparkSession, 300)


@query("synthetic_announcements")
def synthetic_announcements(t):
    """Made-up announcements of events with the record to extract."""
    from textmill.sources.synthetic import announcements

    return announcements(t("region").sparkSession, 200)
