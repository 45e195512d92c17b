"""Calibration, windows, records, preferences and vectors.

``events`` stands in for model outputs: conf is k / 100 from its JSON, correct is value < 50, the episode is the user.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.functions import arrays as A
from textmill.operators import calibration as C
from textmill.operators import vectors as V
from textmill.operators import windows as W
from textmill.operators.quantiles import quantiles
from textmill.plans.registry import query

REC = "rec AS (SELECT event_id, user_id, event_type, ts, value, CAST(props->>'$.k' AS INT) AS k, CAST(props->>'$.k' AS INT) / 100.0::DOUBLE AS conf, CAST(value < 50 AS INT) AS correct FROM events)"


def rec(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t("events").select("event_id", "user_id", "event_type", "ts", "value", k.alias("k"), (k / 100.0).alias("conf"), (F.col("value") < 50).cast("int").alias("correct"))


def rnd(df, *names, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in names})


EDGES = ", ".join(repr(i * (1 / 10)) for i in range(1, 10))
BIN = f"len(list_filter([{EDGES}]::DOUBLE[], lambda e: e < conf))"


@query("reliability_bins", f"WITH {REC} SELECT CAST({BIN} AS INT) AS bin, count(*) AS n, round(avg(conf), 6) AS conf, round(avg(correct), 6) AS acc FROM rec GROUP BY 1")
def reliability_bins(t):
    return rnd(C.reliability(rec(t), C.width_bin(F.col("conf"), 10)), "conf", "acc")


@query("ece", f"WITH {REC}, b AS (SELECT {BIN} AS bin, count(*) AS n, avg(conf) AS c, avg(correct) AS a FROM rec GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b")
def ece(t):
    return rnd(C.ece(C.reliability(rec(t), C.width_bin(F.col("conf"), 10))), "ece")


@query("ece_adaptive", f"WITH {REC}, b AS (SELECT *, ntile(10) OVER (ORDER BY conf, event_id) AS bin FROM rec), g AS (SELECT bin, count(*) AS n, avg(conf) AS c, avg(correct) AS a FROM b GROUP BY bin) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM g")
def ece_adaptive(t):
    return rnd(C.ece(C.reliability(C.mass_bins(rec(t), 10, "event_id"), F.col("bin"))), "ece")


@query("brier_nll", f"WITH {REC}, c AS (SELECT *, least(greatest(conf, 1e-6), 1 - 1e-6) AS p FROM rec) SELECT event_type, round(avg((conf - correct) * (conf - correct)), 6) AS brier, round(2 * avg((conf - correct) * (conf - correct)), 6) AS brier_multi, round(-avg(CASE WHEN correct = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS nll FROM c GROUP BY event_type")
def brier_nll(t):
    d = F.col("conf") - F.col("correct")
    p = F.least(F.greatest(F.col("conf"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return rec(t).groupBy("event_type").agg(F.round(F.avg(d * d), 6).alias("brier"), F.round(2 * F.avg(d * d), 6).alias("brier_multi"), F.round(-F.avg(F.when(F.col("correct") == 1, F.ln(p)).otherwise(F.ln(1 - p))), 6).alias("nll"))


@query("conf_histogram", f"WITH {REC} SELECT round(conf, 3) AS conf, count(*) AS n FROM rec GROUP BY 1")
def conf_histogram(t):
    return rec(t).groupBy(F.round("conf", 3).alias("conf")).agg(F.count(F.lit(1)).alias("n"))


@query("temperature_grid", f"""WITH {REC}, g AS (SELECT tau, avg(ln(1 + exp(-(CASE WHEN correct = 1 THEN z ELSE -z END) / tau))) AS nll
    FROM (SELECT ln((k + 0.5) / (100.5 - k)) AS z, correct FROM rec), (SELECT unnest([0.25, 0.5, 1.0, 2.0, 4.0, 8.0])::DOUBLE AS tau) GROUP BY tau)
    SELECT tau, round(nll, 6) AS nll FROM g""")
def temperature_grid(t):
    """The mean loss of each temperature in one pass."""
    z = F.ln((F.col("k") + 0.5) / (100.5 - F.col("k"))) * F.when(F.col("correct") == 1, 1.0).otherwise(-1.0)
    taus = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]
    row = rec(t).agg(*(F.round(F.avg(F.ln(1 + F.exp(-z / tau))), 6).alias(f"n{i}") for i, tau in enumerate(taus)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(tau).alias("tau"), F.col(f"n{i}").alias("nll")) for i, tau in enumerate(taus)))).alias("g")).select("g.*")


RC = f"{REC}, c AS (SELECT conf, count(*) AS n, sum(1 - correct) AS e FROM rec GROUP BY conf), curve AS (SELECT conf, sum(n) OVER w / CAST((SELECT count(*) FROM rec) AS DOUBLE) AS coverage, sum(e) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS risk FROM c WINDOW w AS (ORDER BY conf DESC ROWS UNBOUNDED PRECEDING))"


@query("risk_coverage", f"WITH {RC} SELECT conf, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM curve")
def risk_coverage(t):
    return rnd(C.risk_coverage(rec(t)).drop("share"), "coverage", "risk")


@query("aurc", f"WITH {RC} SELECT round(sum(a), 6) AS aurc FROM (SELECT (coverage - lag(coverage, 1, 0) OVER (ORDER BY conf DESC)) * risk AS a FROM curve)")
def aurc(t):
    return rnd(C.aurc(C.risk_coverage(rec(t))), "aurc")


@query("choose_threshold", f"WITH {RC}, cand AS (SELECT conf AS threshold, coverage * risk * 5 + (1 - coverage) * 1 AS cost FROM curve UNION ALL SELECT max(conf) + 1e-9, 1.0 FROM rec UNION ALL SELECT 0.0, avg(1 - correct) * 5 FROM rec) SELECT round(threshold, 9) AS threshold, round(cost, 6) AS cost FROM cand ORDER BY round(cost, 12), threshold LIMIT 1")
def choose_threshold(t):
    return C.choose_threshold(rec(t), 5.0, 1.0).select(F.round("threshold", 9).alias("threshold"), F.round("cost", 6).alias("cost"))


@query("action_region", f"WITH {REC} SELECT event_id, CASE WHEN conf >= 0.8 THEN 'act' WHEN conf < 0.3 THEN 'escalate' ELSE 'ask' END AS region FROM rec")
def action_region(t):
    return rec(t).select("event_id", F.when(F.col("conf") >= 0.8, "act").when(F.col("conf") < 0.3, "escalate").otherwise("ask").alias("region"))


@query("threshold_report", f"WITH {REC} SELECT r.tau, round(avg(CAST(conf >= r.tau AS INT)), 6) AS coverage, round(avg(CASE WHEN conf >= r.tau THEN 1 - correct END), 6) AS risk FROM rec, (SELECT unnest([0.2, 0.5, 0.9])::DOUBLE AS tau) r GROUP BY r.tau")
def threshold_report(t):
    taus = [0.2, 0.5, 0.9]
    row = rec(t).agg(*(x for i, tau in enumerate(taus) for x in (F.round(F.avg((F.col("conf") >= tau).cast("int")), 6).alias(f"c{i}"), F.round(F.avg(F.when(F.col("conf") >= tau, 1 - F.col("correct"))), 6).alias(f"r{i}"))))
    return row.select(F.explode(F.array(*(F.struct(F.lit(tau).alias("tau"), F.col(f"c{i}").alias("coverage"), F.col(f"r{i}").alias("risk")) for i, tau in enumerate(taus)))).alias("g")).select("g.*")


def _two_quantiles(rows, by, value):
    """(by, p50, p95)"""
    found = quantiles(rows, by, value, [0.5, 0.95]).groupBy(*by)
    return found.agg(*(F.round(F.max(F.when(F.col("p") == p, F.col("quantile"))), 6).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"))))


@query("decider_table", f"WITH {REC} SELECT event_type, count(*) AS n, round(avg(CAST(conf >= 0.1 AS INT)), 6) AS validity, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM rec GROUP BY event_type")
def decider_table(t):
    sums = rec(t).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("conf") >= 0.1).cast("int")), 6).alias("validity"))
    return sums.join(_two_quantiles(rec(t), ["event_type"], "value"), "event_type")


@query("score_grouping_sets", f"""WITH {REC}, s AS (SELECT event_type, user_id % 3 AS kind, count(*) AS n, avg(correct) AS r, avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.95) AS q FROM rec GROUP BY GROUPING SETS ((), (event_type), (user_id % 3)))
    SELECT coalesce(event_type, 'all') AS source, coalesce(CAST(kind AS VARCHAR), 'all') AS kind, n, round(r, 6) AS rate, round(sqrt(r * (1 - r) / n), 6) AS rate_se, round(m, 6) AS mean, round(sd / sqrt(n), 6) AS mean_se, round(q, 6) AS p95 FROM s""")
def score_grouping_sets(t):
    rows = rec(t).withColumn("kind", F.col("user_id") % 3)
    n = F.count(F.lit(1))
    r = F.avg("correct")
    out = rows.groupingSets([[], ["event_type"], ["kind"]], "event_type", "kind").agg(n.alias("n"), F.round(r, 6).alias("rate"), F.round(F.sqrt(r * (1 - r) / n), 6).alias("rate_se"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value") / F.sqrt(n), 6).alias("mean_se"))
    named = out.withColumns({"source": F.coalesce("event_type", F.lit("all")), "kind": F.coalesce(F.col("kind").cast("string"), F.lit("all"))})
    every, kind = F.lit("all"), F.col("kind").cast("string")
    sets = F.array(*(F.struct(a.alias("source"), b.alias("kind")) for a, b in ((every, every), (F.col("event_type"), every), (every, kind))))
    tail = quantiles(rows.select(F.explode(sets).alias("s"), "value").select("s.*", "value"), ["source", "kind"], "value", [0.95])
    tail = tail.select("source", "kind", F.round("quantile", 6).alias("p95"))
    return named.join(tail, ["source", "kind"], "left").select("source", "kind", "n", "rate", "rate_se", "mean", "mean_se", "p95")


@query("paired_compare", f"WITH {REC}, a AS (SELECT user_id, avg(correct) AS x FROM rec WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, avg(correct) AS y FROM rec WHERE event_type = 'view' GROUP BY 1) SELECT count(*) AS n, count_if(y > x) AS gained, count_if(y < x) AS lost, round(avg(y - x), 6) AS delta FROM a JOIN b USING (user_id)")
def paired_compare(t):
    side = lambda kind, name: rec(t).filter(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("correct").alias(name))
    both = side("click", "x").join(side("view", "y"), "user_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") > F.col("x")).alias("gained"), F.count_if(F.col("y") < F.col("x")).alias("lost"), F.round(F.avg(F.col("y") - F.col("x")), 6).alias("delta"))


@query("cohen_kappa", "WITH n AS (SELECT count(*)::DOUBLE AS n, avg(CAST(quality = toxic AS INT)) AS po, avg(quality) AS q, avg(toxic) AS t FROM labels) SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS agreement, round((po - (q * t + (1 - q) * (1 - t))) / (1 - (q * t + (1 - q) * (1 - t))), 6) AS kappa FROM n")
def cohen_kappa(t):
    row = t("labels").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("po"), F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    pe = F.expr("q * t + (1 - q) * (1 - t)")
    return row.select("n", F.round("po", 6).alias("agreement"), F.round(F.try_divide(F.col("po") - pe, 1 - pe), 6).alias("kappa"))


@query("cost_rollup", f"WITH {REC} SELECT user_id, count(*) AS calls, round(sum(k * 3.0 + value * 15.0) / 1e6, 9) AS usd, round(avg(k), 6) AS mean_in FROM rec GROUP BY user_id")
def cost_rollup(t):
    return rec(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.col("k") * 3.0 + F.col("value") * 15.0) / 1e6, 9).alias("usd"), F.round(F.avg("k"), 6).alias("mean_in"))


@query("failure_crosstab", f"WITH {REC} SELECT event_type, count_if(conf >= 0.5 AND correct = 1) AS covered_right, count_if(conf >= 0.5 AND correct = 0) AS covered_wrong, count_if(conf < 0.5 AND correct = 1) AS missed_right, count_if(conf < 0.5 AND correct = 0) AS missed_wrong FROM rec GROUP BY event_type")
def failure_crosstab(t):
    cov, ok = F.col("conf") >= 0.5, F.col("correct") == 1
    return rec(t).groupBy("event_type").agg(F.count_if(cov & ok).alias("covered_right"), F.count_if(cov & ~ok).alias("covered_wrong"), F.count_if(~cov & ok).alias("missed_right"), F.count_if(~cov & ~ok).alias("missed_wrong"))


@query("agent_metrics", f"WITH {REC} SELECT count_if(event_type = 'click') AS n_route, round(avg(correct) FILTER (event_type = 'click'), 6) AS route_acc, round(avg(correct) FILTER (event_type = 'error' AND conf > 2), 6) AS never, round(sum(value) FILTER (event_type = 'purchase') / nullif(count_if(event_type = 'purchase'), 0), 6) AS cost FROM rec")
def agent_metrics(t):
    on = lambda kind, x: F.when(F.col("event_type") == kind, x)
    return rec(t).agg(F.count_if(F.col("event_type") == "click").alias("n_route"), F.round(F.avg(on("click", F.col("correct"))), 6).alias("route_acc"), F.round(F.avg(F.when((F.col("event_type") == "error") & (F.col("conf") > 2), F.col("correct"))), 6).alias("never"), F.round(F.try_divide(F.sum(on("purchase", F.col("value"))), F.count_if(F.col("event_type") == "purchase")), 6).alias("cost"))


@query("category_share", "SELECT event_type, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def category_share(t):
    counts = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("s")))).select("event_type", F.round(F.col("n") / F.col("s"), 6).alias("share"))


@query("em_by_bucket", f"WITH {REC} SELECT k // 25 AS bucket, count(*) AS n, round(avg(CAST(k % 5 = event_id % 5 AS INT)), 6) AS em FROM rec GROUP BY 1")
def em_by_bucket(t):
    return rec(t).groupBy(F.expr("CAST(k div 25 AS INT)").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("k") % 5 == F.col("event_id") % 5).cast("int")), 6).alias("em"))


# -- windows


@query("returns_to_go", "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS ret FROM events")
def returns_to_go(t):
    return W.returns_to_go(t("events"), "user_id", "event_id", "value").select("event_id", "user_id", F.round("ret", 4).alias("ret"))


@query("loo_baseline", "SELECT event_id, round((sum(value) OVER u - value) / nullif(count(*) OVER u - 1, 0), 9) AS baseline FROM events WINDOW u AS (PARTITION BY user_id)")
def loo_baseline(t):
    return W.leave_one_out(t("events"), "user_id", "value").select("event_id", F.round("baseline", 9).alias("baseline"))


@query("token_rewards", "SELECT event_id, round(-0.1 * value + CASE WHEN event_id = max(event_id) OVER (PARTITION BY user_id) THEN 1.0 ELSE 0 END, 9) AS reward FROM events")
def token_rewards(t):
    last = t("events").groupBy("user_id").agg(F.max("event_id").alias("_last"))
    return t("events").join(last, "user_id").select("event_id", F.round(-0.1 * F.col("value") + F.when(F.col("event_id") == F.col("_last"), 1.0).otherwise(0.0), 6).alias("reward"))


@query("latest_wins", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_wins(t):
    return W.dedupe_last(t("events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("dedupe_last_wins", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def dedupe_last_wins(t):
    return W.dedupe_last(t("events").select("user_id", "event_id", "value"), ["user_id"], [F.col("event_id")])


@query("idempotent_events", "SELECT user_id, event_type, k, min(event_id) AS event_id FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events) GROUP BY ALL")
def idempotent_events(t):
    rows = rec(t).select("user_id", "event_type", "k", "event_id")
    return W.dedupe_first(rows, ["user_id", "event_type", "k"], [F.col("event_id")])


@query("latest_by_class", "SELECT user_id, max(event_id) FILTER (event_type = 'error') AS last_error, max(event_id) FILTER (event_type = 'purchase') AS last_purchase, max(event_id) AS last_any FROM events GROUP BY user_id")
def latest_by_class(t):
    on = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("event_id")))
    return t("events").groupBy("user_id").agg(on("error").alias("last_error"), on("purchase").alias("last_purchase"), F.max("event_id").alias("last_any"))


@query("merge_ranges", """WITH r AS (SELECT o_custkey AS cust, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS lo, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 60 AS hi FROM orders),
    m AS (SELECT *, CAST(lo > coalesce(max(hi) OVER (PARTITION BY cust ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo - 1) AS INT) AS fresh FROM r),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY cust ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT cust, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM i GROUP BY cust, island""")
def merge_ranges(t):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return W.merge_ranges(t("orders").select(F.col("o_custkey").alias("cust"), day.alias("lo"), (day + 60).alias("hi")), "cust", "lo", "hi")


@query("asof_purchase_before_error", "SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_purchase_before_error(t):
    e = t("events").filter("event_type = 'error'").select("event_id", "user_id", "ts")
    p = t("events").filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return W.as_of(e, p, "user_id", "ts", "ts", "purchase_id").select("event_id", "purchase_id")


@query("average_rank", "SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) - 1 + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS place FROM orders")
def average_rank(t):
    return W.average_rank(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "place").select("o_orderkey", F.col("place").cast("double").alias("place"))


@query("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS rho FROM r")
def spearman(t):
    d = W.average_rank(W.average_rank(t("lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "a"), "l_extendedprice", "b")
    return d.agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@query("topk_per_group", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 5")
def topk_per_group(t):
    order = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return t("events").withColumn("rn", F.row_number().over(order)).filter("rn <= 5").select("event_type", "event_id", "value")


@query("nucleus", "WITH p AS (SELECT user_id, event_type, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS p FROM events GROUP BY user_id, event_type), b AS (SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p) SELECT user_id, event_type, round(p, 6) AS p FROM b WHERE round(coalesce(before, 0), 9) < 0.6")
def nucleus(t):
    n = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")).cast("double"), 12)).drop("n")
    return W.nucleus(p, "user_id", "p", "event_type", 0.6 - 1e-9).select("user_id", "event_type", F.round("p", 6).alias("p"))


@query("tail_n", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2")
def tail_n(t):
    order = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return t("events").withColumn("rn", F.row_number().over(order)).filter("rn <= 2").select("user_id", "event_id")


@query("handoff", "SELECT user_id, max(CASE WHEN event_type = 'error' THEN event_id END) AS last_error, arg_max(value, event_id) FILTER (event_type = 'click') AS last_click_value FROM events GROUP BY user_id")
def handoff(t):
    return t("events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("last_error"), F.max_by("value", F.when(F.col("event_type") == "click", F.col("event_id"))).alias("last_click_value"))


@query("interrupts", "SELECT user_id, count_if(event_type = 'error' AND before <> 'error') AS interrupts FROM (SELECT *, lag(event_type, 1, '') OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY user_id")
def interrupts(t):
    before = F.lag("event_type", 1, "").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t("events").withColumn("before", before).groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & (F.col("before") != "error")).alias("interrupts"))


@query("snapshot_before", "SELECT user_id, max(event_id) AS event_id FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events) WHERE next = 'purchase' GROUP BY user_id")
def snapshot_before(t):
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t("events").withColumn("next", after).filter("next = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("compact_context", "SELECT conv_id, turn, CASE WHEN turn = first THEN 'first' WHEN rev <= 2 THEN 'kept' ELSE 'summary' END AS part FROM (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS first, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rev FROM conversations)")
def compact_context(t):
    w = Window.partitionBy("conv_id")
    rows = t("conversations").select("conv_id", "turn", F.min("turn").over(w).alias("first"), F.row_number().over(w.orderBy(F.desc("turn"))).alias("rev"))
    return rows.select("conv_id", "turn", F.when(F.col("turn") == F.col("first"), "first").when(F.col("rev") <= 2, "kept").otherwise("summary").alias("part"))


@query("loop_tokens", "SELECT conv_id, count(*) AS turns, CAST(sum(n * (last - turn + 1)) AS BIGINT) AS resent FROM (SELECT conv_id, turn, length(text) // 4 AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id")
def loop_tokens(t):
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    rows = t("conversations").select("conv_id", "turn", F.expr("length(text) div 4").alias("n"), last.alias("last"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.col("n") * (F.col("last") - F.col("turn") + 1)).alias("resent"))


@query("monotone_check", "SELECT event_type, bool_and(value >= before) AS monotone FROM (SELECT *, lag(value, 1, -1) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events) GROUP BY event_type")
def monotone_check(t):
    before = F.lag("value", 1, -1.0).over(Window.partitionBy("event_type").orderBy("event_id"))
    return t("events").withColumn("before", before).groupBy("event_type").agg(F.bool_and(F.col("value") >= F.col("before")).alias("monotone"))


@query("best_epoch", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY user_id")
def best_epoch(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query("running_interval", "SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS starts, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS ends FROM events")
def running_interval(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t("events").select("event_id", F.round(F.coalesce(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), 4).alias("starts"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("ends"))


# -- preferences


PAIR = "pr AS (SELECT conv_id, max(length(text)) / 100.0::DOUBLE AS a, min(length(text)) / 100.0::DOUBLE AS b FROM conversations GROUP BY conv_id)"


def pairs(t):
    n = F.length("text")
    return t("conversations").groupBy("conv_id").agg((F.max(n) / 100.0).alias("a"), (F.min(n) / 100.0).alias("b"))


@query("bt_prob", f"WITH {PAIR} SELECT conv_id, round(1 / (1 + exp(-(a - b))), 6) AS p, round(ln(1 + exp(-(a - b))), 6) AS loss FROM pr")
def bt_prob(t):
    d = F.col("a") - F.col("b")
    return pairs(t).select("conv_id", F.round(1 / (1 + F.exp(-d)), 6).alias("p"), F.round(F.ln(1 + F.exp(-d)), 6).alias("loss"))


@query("pref_stats", f"WITH {PAIR} SELECT count(*) AS n, round(avg(CAST(a = b AS INT)), 6) AS tie_share, round(avg(CASE WHEN a > b THEN 1.0 WHEN a = b THEN 0.5 ELSE 0 END), 6) AS accuracy, round(avg(greatest(1 / (1 + exp(b - a)), 1 - 1 / (1 + exp(b - a)))), 6) AS oracle_accuracy FROM pr")
def pref_stats(t):
    p = 1 / (1 + F.exp(F.col("b") - F.col("a")))
    return pairs(t).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("tie_share"), F.round(F.avg(F.when(F.col("a") > F.col("b"), 1.0).when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)), 6).alias("accuracy"), F.round(F.avg(F.greatest(p, 1 - p)), 6).alias("oracle_accuracy"))


@query("normalizer", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd FROM orders GROUP BY 1")
def normalizer(t):
    return t("orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("sd"))


@query("standardize_train", "WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders WHERE o_orderkey % 2 = 0) SELECT o_orderkey, round((o_totalprice - m) / (sd + 1e-6), 6) AS z FROM orders, s")
def standardize_train(t):
    s = t("orders").filter("o_orderkey % 2 = 0").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("sd"))
    return t("orders").join(F.broadcast(s)).select("o_orderkey", F.round((F.col("o_totalprice") - F.col("m")) / (F.col("sd") + 1e-6), 6).alias("z"))


@query("entropy", "WITH p AS (SELECT source, count(*) / CAST(sum(count(*)) OVER (PARTITION BY source) AS DOUBLE) AS p FROM documents GROUP BY source, lang) SELECT source, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY source")
def entropy(t):
    n = t("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("source").agg(F.sum("n").alias("s"))
    p = F.col("n") / F.col("s")
    return n.join(total, "source").groupBy("source").agg(F.round(-F.sum(p * F.ln(p)), 6).alias("entropy"))


# -- vectors


UNIT = "u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query("cosine", f"WITH {UNIT} SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM u a JOIN u b ON b.vec_id = a.vec_id + 1")
def cosine(t):
    e = t("embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("v"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(other, "vec_id").select("vec_id", F.round(A.cosine(F.col("v"), F.col("w")), 6).alias("sim"))


@query("knn_cosine", f"""WITH {UNIT} SELECT query, vec_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM
    (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0)) WHERE rank <= 5""")
def knn_cosine(t):
    """The queries are the rows whose id is divisible by 20, against all rows."""
    e = t("embeddings")
    return V.knn(e.filter("vec_id % 20 = 0"), e, 5)


@query("mean_embedding", f"WITH {UNIT}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM u) SELECT label, dim, round(avg(x), 6) AS mean FROM x GROUP BY ALL")
def mean_embedding(t):
    return V.mean_vectors(t("embeddings"), "label").withColumn("mean", F.round("mean", 6))


@query("radius_gyration", f"WITH {UNIT}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM u), d AS (SELECT label, avg(x * x) - avg(x) * avg(x) AS var FROM x GROUP BY label, dim) SELECT label, round(sqrt(sum(var)), 6) AS rg FROM d GROUP BY label")
def radius_gyration(t):
    return V.radius_of_gyration(t("embeddings"), "label").withColumn("rg", F.round("rg", 6))


@query("softmax_outcomes", f"WITH {UNIT}, z AS (SELECT vec_id, list_transform(v, lambda x: exp((x - list_max(v)) / 0.5)) AS e, label FROM u) SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS conf, CAST(list_position(e, list_max(e)) - 1 = label AS INT) AS correct FROM z")
def softmax_outcomes(t):
    z = t("embeddings").select("vec_id", "label", A.doubles(F.col("embedding")).alias("z"))
    p = z.select("vec_id", "label", A.softmax(F.col("z"), 0.5).alias("p"))
    return p.select("vec_id", F.round(F.array_max("p"), 6).alias("conf"), (A.argmax(F.col("p")) == F.col("label")).cast("int").alias("correct"))
