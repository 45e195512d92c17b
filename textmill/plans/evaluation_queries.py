"""Scores of answers, spans and rankings, and further record queries over the stand-ins of ``record_queries``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions import arrays as A
from textmill.functions import text as X
from textmill.operators import calibration as C
from textmill.operators import retrieval as S
from textmill.operators import vectors as V
from textmill.operators.divergence import drift
from textmill.plans.record_queries import REC, UNIT, pairs, rec
from textmill.plans.registry import query
from textmill.plans.text_queries import ALNUM_SQL, WORD_STOP_SQL


@query("calibration_summary", f"WITH {REC} SELECT event_type, count(*) AS n, count_if(k >= 5) AS n_valid, round(avg(correct * CAST(k >= 5 AS INT)), 6) AS accuracy, round(avg(conf) FILTER (k >= 5), 6) AS mean_conf FROM rec GROUP BY event_type")
def calibration_summary(t):
    """Invalid answers (k below 5) are wrong in accuracy and left out of the mean confidence."""
    valid = F.col("k") >= 5
    return rec(t).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid"), F.round(F.avg(F.col("correct") * valid.cast("int")), 6).alias("accuracy"), F.round(F.avg(F.when(valid, F.col("conf"))), 6).alias("mean_conf"))


@query("apply_thresholds", f"WITH {REC} SELECT event_type, round(avg(CAST(conf >= 0.8 AS INT)), 6) AS act, round(avg(CAST(conf < 0.3 AS INT)), 6) AS escalate, round(avg(CASE WHEN conf >= 0.8 THEN (1 - correct) * 20.0 WHEN conf < 0.3 THEN 3 ELSE 0.5 END), 6) AS cost FROM rec GROUP BY event_type")
def apply_thresholds(t):
    c = F.col("conf")
    cost = F.when(c >= 0.8, (1 - F.col("correct")) * 20.0).when(c < 0.3, 3.0).otherwise(0.5)
    return rec(t).groupBy("event_type").agg(F.round(F.avg((c >= 0.8).cast("int")), 6).alias("act"), F.round(F.avg((c < 0.3).cast("int")), 6).alias("escalate"), F.round(F.avg(cost), 6).alias("cost"))


@query("choose_thresholds", f"""WITH {REC}, g AS (SELECT k, count(*) AS n, sum(1 - correct) AS e FROM rec GROUP BY k), cand AS (SELECT k AS c FROM rec UNION SELECT 0 UNION SELECT max(k) + 1 FROM rec),
    pair AS (SELECT a.c AS esc, b.c AS act FROM cand a JOIN cand b ON a.c <= b.c),
    cost AS (SELECT esc, act, round(sum(CASE WHEN k >= act THEN e * 20.0 WHEN k < esc THEN n * 3.0 ELSE n * 0.5 END) / sum(n), 9) AS cost FROM pair, g GROUP BY esc, act)
    SELECT esc, act, cost FROM cost ORDER BY cost, esc, act LIMIT 1""")
def choose_thresholds(t):
    """The best pair of thresholds among all observed k, 0 and one above the largest."""
    best = C.choose_thresholds(rec(t).select("k", "correct"), "k", wrong=20.0, ask=0.5, miss=0.0, escalate=3.0)
    return best.select("esc", "act", F.round("cost", 9).alias("cost"))


@query("proper_score_curve", "SELECT q, p, round(p * (1 - q) * (1 - q) + (1 - p) * q * q, 6) AS brier FROM (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS q), (SELECT unnest([0.2, 0.7])::DOUBLE AS p)")
def proper_score_curve(t):
    grid = t("region").sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i")).select((F.col("i") / 10.0).alias("q"), F.explode(F.array(F.lit(0.2), F.lit(0.7))).alias("p"))
    q, p = F.col("q"), F.col("p")
    return grid.select("q", "p", F.round(p * (1 - q) * (1 - q) + (1 - p) * q * q, 6).alias("brier"))


@query("by_kind_table", f"WITH {REC} SELECT event_type AS kind, count(*) AS n, round(avg(CAST(conf >= 0.2 AS INT)), 6) AS answered, round(avg(correct) FILTER (conf >= 0.2), 6) AS correct FROM rec GROUP BY event_type")
def by_kind_table(t):
    answered = F.col("conf") >= 0.2
    return rec(t).groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(answered.cast("int")), 6).alias("answered"), F.round(F.avg(F.when(answered, F.col("correct"))), 6).alias("correct"))


@query("verdict_agreement", f"WITH {REC} SELECT user_id, round(avg(CAST((conf >= 0.5) = (correct = 1) AS INT)), 6) AS agreement FROM rec GROUP BY user_id")
def verdict_agreement(t):
    same = ((F.col("conf") >= 0.5) == (F.col("correct") == 1)).cast("int")
    return rec(t).groupBy("user_id").agg(F.round(F.avg(same), 6).alias("agreement"))


@query("prob_shift", f"WITH {REC}, a AS (SELECT user_id, max_by(conf, event_id) AS x FROM rec WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, max_by(conf, event_id) AS y FROM rec WHERE event_type = 'view' GROUP BY 1) SELECT count(*) AS n, round(avg(y - x), 6) AS mean, round(max(abs(y - x)), 6) AS most, count_if((x >= 0.5) <> (y >= 0.5)) AS crossings FROM a JOIN b USING (user_id)")
def prob_shift(t):
    side = lambda kind, name: rec(t).filter(F.col("event_type") == kind).groupBy("user_id").agg(F.max_by("conf", "event_id").alias(name))
    d = F.col("y") - F.col("x")
    return side("click", "x").join(side("view", "y"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(d), 6).alias("mean"), F.round(F.max(F.abs(d)), 6).alias("most"), F.count_if((F.col("x") >= 0.5) != (F.col("y") >= 0.5)).alias("crossings"))


@query("sign_test", f"""WITH {REC}, u AS (SELECT user_id, count_if(correct = 1) AS w, count_if(correct = 0) AS l FROM rec GROUP BY user_id),
    x AS (SELECT user_id, w, l, CAST(w + l AS BIGINT) AS n, CAST(least(w, l) AS BIGINT) AS m FROM u)
    SELECT user_id, w, l, round(least(1.0, 2 * list_sum(list_transform(range(0, m + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 6) AS p FROM x""")
def sign_test(t):
    u = rec(t).groupBy("user_id").agg(F.count_if(F.col("correct") == 1).alias("w"), F.count_if(F.col("correct") == 0).alias("l"))
    return u.select("user_id", "w", "l", F.round(C.sign_test(F.col("w"), F.col("l")), 6).alias("p"))


@query("usage_rollup", f"WITH {REC} SELECT user_id, sum(k) FILTER (event_type = 'click') AS tokens_in, sum(k) FILTER (event_type = 'view') AS tokens_out, count_if(event_type = 'error') AS errors, CASE WHEN bool_and(k > 0) THEN round(sum(value), 4) END AS usd FROM rec GROUP BY user_id")
def usage_rollup(t):
    """usd is null unless every record has a positive k."""
    on = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("k")))
    return rec(t).groupBy("user_id").agg(on("click").alias("tokens_in"), on("view").alias("tokens_out"), F.count_if(F.col("event_type") == "error").alias("errors"), F.when(F.bool_and(F.col("k") > 0), F.round(F.sum("value"), 4)).alias("usd"))


@query("extraction_score", f"WITH {REC} SELECT field, round(avg(ok), 6) AS em FROM (SELECT unnest([{{'field': 'type', 'ok': CAST(event_type IN ('click', 'view') AS INT)}}, {{'field': 'k', 'ok': CAST(k % 2 = 0 AS INT)}}, {{'field': 'record', 'ok': CAST(event_type IN ('click', 'view') AND k % 2 = 0 AS INT)}}], recursive := true) FROM rec) GROUP BY field")
def extraction_score(t):
    a, b = F.col("event_type").isin("click", "view"), F.col("k") % 2 == 0
    flags = rec(t).select(a.cast("int").alias("type"), b.cast("int").alias("k"), (a & b).cast("int").alias("record"))
    return flags.unpivot([], ["type", "k", "record"], "field", "ok").groupBy("field").agg(F.round(F.avg("ok"), 6).alias("em"))


@query("positional_accuracy", "SELECT place, round(avg(CAST(a = b AS INT)), 6) AS acc FROM (SELECT unnest(range(0, 3)) AS place, unnest(string_split(o_orderpriority || '-' || o_orderstatus, '-')[1:3]) AS a, unnest(['5', 'LOW', 'F']) AS b FROM orders) GROUP BY place")
def positional_accuracy(t):
    parts = F.slice(F.split(F.concat_ws("-", "o_orderpriority", "o_orderstatus"), "-"), 1, 3)
    want = F.array(F.lit("5"), F.lit("LOW"), F.lit("F"))
    rows = t("orders").select(F.posexplode(F.zip_with(parts, want, lambda a, b: (a == b).cast("int"))).alias("place", "ok"))
    return rows.groupBy(F.col("place").cast("long").alias("place")).agg(F.round(F.avg("ok"), 6).alias("acc"))


@query("dpo_loss", "WITH pr AS (SELECT conv_id, max(length(text)) / 100.0::DOUBLE AS a, min(length(text)) / 100.0::DOUBLE AS b FROM conversations GROUP BY conv_id) SELECT round(avg(ln(1 + exp(-0.1 * (a - b)))), 6) AS loss, round(avg(0.1 * (a - b)), 6) AS margin FROM pr")
def dpo_loss(t):
    d = 0.1 * (F.col("a") - F.col("b"))
    return pairs(t).agg(F.round(F.avg(F.ln(1 + F.exp(-d))), 6).alias("loss"), F.round(F.avg(d), 6).alias("margin"))


_DRIFT = f"""tk AS (SELECT doc_id // 200 AS w, unnest({ALNUM_SQL}) AS term FROM documents), c AS (SELECT w, term, count(*) AS n FROM tk GROUP BY ALL), s AS (SELECT w, sum(n) AS s FROM c GROUP BY w),
    v AS (SELECT DISTINCT term FROM c), vn AS (SELECT count(*) AS v FROM v), g AS (SELECT a.w, term, a.s AS p, b.s AS q FROM s a JOIN s b ON b.w = a.w - 1, v)"""


@query("vocabulary_drift", f"""WITH {_DRIFT}, d AS (SELECT g.w, (coalesce(x.n, 0) + 1.0::DOUBLE) / (p + v) AS a, (coalesce(y.n, 0) + 1.0::DOUBLE) / (q + v) AS b
        FROM g JOIN vn ON true LEFT JOIN c x ON x.w = g.w AND x.term = g.term LEFT JOIN c y ON y.w = g.w - 1 AND y.term = g.term)
    SELECT w AS "window", round(sum(a * ln(a / b)), 6) AS kl FROM d GROUP BY w""")
def vocabulary_drift(t):
    """How far the words of each two hundred documents lie from those of the two hundred before, over the whole vocabulary."""
    words = t("documents").select(F.expr("doc_id div 200").alias("window"), F.explode(X.alnum_tokens(F.col("text"))).alias("term"))
    counts = words.groupBy("window", "term").agg(F.count(F.lit(1)).alias("n"))
    size = counts.agg(F.countDistinct("term").alias("size"))
    return drift(counts, size).select("window", F.round("kl", 6).alias("kl"))


@query("kl_divergence", """WITH p AS (SELECT lang, count(*) FILTER (doc_id % 2 = 0) + 1.0::DOUBLE AS a, count(*) FILTER (doc_id % 2 = 1) + 1.0::DOUBLE AS b FROM documents GROUP BY lang)
    SELECT round(sum(pa * ln(pa / pb)), 6) AS kl FROM (SELECT a / sum(a) OVER () AS pa, b / sum(b) OVER () AS pb FROM p)""")
def kl_divergence(t):
    n = t("documents").groupBy("lang").agg((F.count_if(F.col("doc_id") % 2 == 0) + 1.0).alias("a"), (F.count_if(F.col("doc_id") % 2 == 1) + 1.0).alias("b"))
    s = n.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    pa, pb = F.col("a") / F.col("sa"), F.col("b") / F.col("sb")
    return n.join(F.broadcast(s)).agg(F.round(F.sum(pa * F.ln(pa / pb)), 6).alias("kl"))


GOOD, BAD = ["the", "die", "les", "los", "and"], ["of", "der", "la", "que"]
GOOD_SQL, BAD_SQL = (", ".join(f"'{w}'" for w in words) for words in (GOOD, BAD))


@query("gold_reward", f"""SELECT conv_id, turn, round(least(len(list_distinct(list_filter(k, lambda w: w IN ({GOOD_SQL})))), 3) - len(list_filter(k, lambda w: w IN ({BAD_SQL})))
    - 10 * greatest(0, len(list_filter(k, lambda w: w IN ({GOOD_SQL}))) / greatest(len(k), 1) - 0.25), 6) AS reward FROM (SELECT conv_id, turn, {ALNUM_SQL} AS k FROM conversations)""")
def gold_reward(t):
    """Distinct good words up to three, minus every bad one, minus ten times the crowding of good ones over a quarter."""
    rows = t("conversations").select("conv_id", "turn", X.alnum_tokens(F.col("text")).alias("k"))
    good, bad = F.filter("k", lambda w: w.isin(GOOD)), F.filter("k", lambda w: w.isin(BAD))
    crowd = F.greatest(F.lit(0.0), F.size(good) / F.greatest(F.size("k"), F.lit(1)) - 0.25)
    return rows.select("conv_id", "turn", F.round(F.least(F.size(F.array_distinct(good)), F.lit(3)) - F.size(bad) - 10 * crowd, 6).alias("reward"))


@query("phase_seconds", "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'browse' WHEN event_type = 'purchase' THEN 'buy' ELSE 'other' END AS phase, round(sum(value), 2) AS seconds FROM events GROUP BY 1")
def phase_seconds(t):
    phase = F.when(F.col("event_type").isin("click", "view"), "browse").when(F.col("event_type") == "purchase", "buy").otherwise("other")
    return t("events").groupBy(phase.alias("phase")).agg(F.round(F.sum("value"), 2).alias("seconds"))


@query("span_cover", "SELECT d.doc_id, b.item_id, (least(b.s + b.n, d.c + 1000) - greatest(b.s, d.c)) * 2 >= b.n AS covered, d.c AS chunk FROM (SELECT doc_id, item_id, instr(d.text, b.text) - 1 AS s, length(b.text) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text)) b JOIN (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 900)) AS c FROM documents) d ON d.doc_id = b.doc_id AND d.c < b.s + b.n AND b.s < d.c + 1000")
def span_cover(t):
    """Which windows of 1,000 characters, 900 apart, hold at least half of a benchmark passage that its document contains."""
    found = S.containing(t("benchmark"), t("documents"), "item_id", "doc_id")
    s = found.select("doc_id", "item_id", (F.expr("instr(text, item)") - 1).alias("s"), F.length("item").alias("n"), F.length("text").alias("size"))
    last = F.least(F.col("s") + F.col("n") - 1, F.col("size") - 1)
    low = F.greatest(F.ceil((F.col("s") - 999) / 900), F.lit(0))
    chunk = s.withColumn("chunk", F.explode(F.transform(F.sequence(low, F.floor(last / 900)), lambda i: i * 900)))
    hold = F.least(F.col("s") + F.col("n"), F.col("chunk") + 1000) - F.greatest("s", "chunk")
    return chunk.select("doc_id", "item_id", (hold * 2 >= F.col("n")).alias("covered"), F.col("chunk").cast("long").alias("chunk"))


@query("broken_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)(?:href|src)="([^"]*)"', 1)) AS link FROM pages), h AS (SELECT DISTINCT '/' || regexp_extract(url, '://[^/]*/([^/?#.]*)', 1) AS path FROM pages)
    SELECT DISTINCT page_id, link FROM l WHERE starts_with(link, '/') AND link NOT IN (SELECT path FROM h)""")
def broken_links(t):
    link = t("pages").select("page_id", F.explode(X.links(F.col("html"))).alias("link")).filter(F.col("link").startswith("/")).distinct()
    known = t("pages").select(F.concat(F.lit("/"), F.regexp_extract("url", r"://[^/]*/([^/?#.]*)", 1)).alias("link")).distinct()
    return link.join(known, "link", "left_anti")


@query("claim_support", f"""WITH c AS (SELECT conv_id, turn, list_filter({ALNUM_SQL}, lambda x: x NOT IN ({WORD_STOP_SQL}) AND length(x) >= 3) AS w FROM conversations WHERE role = 'assistant'),
    s AS (SELECT conv_id, list_distinct(flatten(list(({ALNUM_SQL})))) AS src FROM conversations WHERE role = 'user' GROUP BY conv_id)
    SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 1.0 ELSE round(len(list_filter(w, lambda x: list_contains(coalesce(src, []), x))) / len(w), 6) END AS support FROM c LEFT JOIN s USING (conv_id)""")
def claim_support(t):
    """Share of an answer's content words that the user's turns have; 1 without content words."""
    c = t("conversations").filter("role = 'assistant'").select("conv_id", "turn", X.content_words(F.col("text")).alias("w"))
    words = c.select("conv_id", "turn", F.explode_outer("w").alias("x"))
    sources = t("conversations").filter("role = 'user'").select("conv_id", F.explode(X.alnum_tokens(F.col("text"))).alias("x")).distinct().withColumn("hit", F.lit(1))
    joined = words.join(sources, ["conv_id", "x"], "left").groupBy("conv_id", "turn").agg(F.count("x").alias("n"), F.count("hit").alias("h"))
    return joined.select("conv_id", "turn", F.when(F.col("n") == 0, 1.0).otherwise(F.round(F.col("h") / F.col("n"), 6)).alias("support"))


@query("locate_unique", "SELECT item_id, doc_id, instr(d.text, b.text) AS at, (length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text) = 1 AS once FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def locate_unique(t):
    found = S.containing(t("benchmark"), t("documents"), "item_id", "doc_id")
    return found.select("item_id", "doc_id", F.expr("instr(text, item)").cast("long").alias("at"), F.expr("(length(text) - length(replace(text, item, ''))) div length(item) = 1").alias("once"))


@query("absent_terms", "SELECT w AS term FROM (SELECT unnest(['idiot', 'zebra', 'licensed', 'quasar', 'tion']) AS w) WHERE w NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM documents)")
def absent_terms(t):
    asked = t("region").sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ["idiot", "zebra", "licensed", "quasar", "tion"]))).alias("term"))
    return asked.join(t("documents").select(F.explode(X.alnum_tokens(F.col("text"))).alias("term")), "term", "left_anti")


@query("quota_errors", "SELECT lang, n, quota FROM (SELECT lang, count(*) AS n, CAST(round((SELECT count(*) FROM documents) / 4.0) AS BIGINT) AS quota FROM documents GROUP BY lang) WHERE abs(n - quota) > 1")
def quota_errors(t):
    n = t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.round(F.sum("n") / 4.0).cast("long").alias("quota"))
    return n.join(F.broadcast(total)).filter(F.abs(F.col("n") - F.col("quota")) > 1).select("lang", "n", "quota")


@query("config_diff", "SELECT coalesce(a.c_mktsegment, b.c_mktsegment) AS key, a.n AS left_n, b.n AS right_n FROM (SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1) b ON a.c_mktsegment = b.c_mktsegment WHERE a.n IS DISTINCT FROM b.n")
def config_diff(t):
    side = lambda r, name: t("customer").filter(F.col("c_custkey") % 2 == r).groupBy(F.col("c_mktsegment").alias("key")).agg(F.count(F.lit(1)).alias(name))
    return side(0, "left_n").join(side(1, "right_n"), "key", "full").filter(~F.col("left_n").eqNullSafe(F.col("right_n")))


@query("top_confident_errors", f"WITH {REC} SELECT event_id, conf FROM rec WHERE correct = 0 ORDER BY conf DESC, event_id LIMIT 10")
def top_confident_errors(t):
    return rec(t).filter("correct = 0").orderBy(F.desc("conf"), "event_id").limit(10).select("event_id", "conf")


@query("choose_tau", f"WITH {REC}, c AS (SELECT tau, round(avg(CASE WHEN conf >= tau THEN (1 - correct) * 5.0 ELSE 1 END), 9) AS cost FROM rec, (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS tau) GROUP BY tau) SELECT tau, cost FROM c ORDER BY cost, tau LIMIT 1")
def choose_tau(t):
    taus = [i / 10 for i in range(11)]
    row = rec(t).agg(*(F.round(F.avg(F.when(F.col("conf") >= tau, (1 - F.col("correct")) * 5.0).otherwise(1.0)), 9).alias(f"c{i}") for i, tau in enumerate(taus)))
    best = F.array_min(F.array(*(F.struct(F.col(f"c{i}").alias("cost"), F.lit(tau).alias("tau")) for i, tau in enumerate(taus))))
    return row.select(best.alias("b")).select("b.tau", "b.cost")


@query("window_cover", """WITH n AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+')) AS n FROM conversations), p AS (SELECT conv_id, turn, n, unnest(range(0, n)) AS i FROM n)
    SELECT conv_id, turn, CASE WHEN i < 32 THEN 0 ELSE (i - 32) // 16 + 1 END AS win, min(i) AS first, max(i) AS last, count(*) AS scored FROM p GROUP BY ALL""")
def window_cover(t):
    """Windows of 32 words, 16 apart, over each message: the places that each scores, which are those that no earlier one has."""
    rows = t("conversations").select("conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))).alias("n")).filter("n > 0")
    rows = rows.withColumn("win", F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.col("n") - 32, F.lit(0)) / 16).cast("int"))))
    first = F.when(F.col("win") == 0, 0).otherwise(F.col("win") * 16 + 16)
    last = F.least(F.col("win") * 16 + 31, F.col("n") - 1)
    return rows.select("conv_id", "turn", "win", first.alias("first"), last.alias("last"), (last - first + 1).alias("scored"))


@query("analogy", f"""WITH {UNIT}, q AS (SELECT a.vec_id AS query, list_transform(range(1, 65), lambda i: b.v[i] - a.v[i] + c.v[i]) AS v FROM u a JOIN u b ON b.vec_id = a.vec_id + 1 JOIN u c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 20 = 0)
    SELECT query, vec_id, sim FROM (SELECT query, u.vec_id, round(list_cosine_similarity(q.v, u.v), 6) AS sim FROM q JOIN u ON u.vec_id NOT IN (query, query + 1, query + 2)) QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) = 1""")
def analogy(t):
    """b - a + c for each a whose id is divisible by 20 and the two after it; the nearest row but these three."""
    e = t("embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("embedding"))
    shifted = lambda s, name: e.select((F.col("vec_id") - s).alias("vec_id"), F.col("embedding").alias(name))
    three = e.filter("vec_id % 20 = 0").join(shifted(1, "b"), "vec_id").join(shifted(2, "c"), "vec_id")
    target = F.zip_with(F.zip_with("b", "embedding", lambda x, y: x - y), F.col("c"), lambda x, y: x + y)
    near = V.knn(three.select("vec_id", target.alias("embedding")), e, 3)
    rest = near.filter(~F.col("vec_id").between(F.col("query"), F.col("query") + 2))
    return rest.groupBy("query").agg(F.min(F.struct("rank", "vec_id", "sim")).alias("b")).select("query", "b.vec_id", "b.sim")


@query("pairwise_places", f"WITH {REC} SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY conf DESC) AS place FROM rec")
def pairwise_places(t):
    return rec(t).select("user_id", "event_id", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("conf"))).alias("place"))
