"""Recorded loops of agents, judged claims and delegated topics, over events and conversations as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.functions import udfs as U
from textmill.operators import agents as G
from textmill.plans.record_queries import REC, rec
from textmill.plans.registry import query
from textmill.plans.retrieval_queries import _hybrid
from textmill.plans.table_queries import RRF

_STEPS = f"WITH {REC}, st AS (SELECT user_id // 3 AS loop_id, row_number() OVER (PARTITION BY user_id // 3 ORDER BY event_id) AS k, CASE WHEN k % 17 = 0 THEN 'truncated' WHEN k % 19 = 0 THEN 'refused' ELSE 'ok' END AS stop, k % 5 AS n_calls FROM rec)"


@query("tool_replay", f"""{_STEPS}, e AS (SELECT loop_id, k, n_calls, CASE WHEN stop <> 'ok' THEN 'failed' WHEN n_calls = 0 THEN 'done' END AS fin FROM st WHERE k <= 8), f AS (SELECT loop_id, min(k) FILTER (fin IS NOT NULL) AS last, arg_min(fin, k) FILTER (fin IS NOT NULL) AS ended FROM e GROUP BY loop_id)
    SELECT loop_id, coalesce(ended, 'step limit') AS status, CAST(sum(CASE WHEN last IS NULL OR k < last THEN n_calls ELSE 0 END) AS BIGINT) AS calls FROM e JOIN f USING (loop_id) GROUP BY loop_id, ended""")
def tool_replay(t):
    """How recorded tool loops of at most eight steps end, and the calls made until then."""
    from pyspark.sql.window import Window

    loop = F.expr("user_id div 3")
    rows = rec(t).select(loop.alias("loop_id"), F.col("k").alias("x"), F.row_number().over(Window.partitionBy(loop).orderBy("event_id")).alias("k"))
    stop = F.when(F.col("x") % 17 == 0, "truncated").when(F.col("x") % 19 == 0, "refused").otherwise("ok")
    return G.replay_loops(rows.select("loop_id", "k", stop.alias("stop"), (F.col("x") % 5).alias("n_calls")), 8)


@query("extract_attempts", f"""WITH {REC}, r AS (SELECT event_id // 5 AS item_id, event_id % 5 + 1 AS attempt, k % 13 = 0 AS refused, k FROM rec), e AS (SELECT *, CASE WHEN refused OR k >= 60 THEN attempt END AS fin, CASE WHEN refused THEN -1 ELSE k END AS given FROM r WHERE attempt <= 3)
    SELECT item_id, coalesce(min(fin), max(attempt)) AS attempt, nullif(arg_min(given, fin) FILTER (fin IS NOT NULL), -1) AS value FROM e GROUP BY item_id""")
def extract_attempts(t):
    """The first valid reply of at most three, and the calls made."""
    rows = rec(t).select(F.expr("event_id div 5").alias("item_id"), (F.col("event_id") % 5 + 1).alias("attempt"), F.when(F.col("k") % 13 == 0, "refused").otherwise("end").alias("stop"), F.col("k").alias("value"))
    return G.extract_attempts(rows, F.col("value") >= 60, 2)


@query("coverage_gaps", f"""WITH {REC}, res AS (SELECT user_id AS topic, CASE WHEN count_if(k > 97) > 0 THEN 'failed' ELSE 'done' END AS status, count_if(k < 2) AS failed FROM rec GROUP BY user_id HAVING user_id % 10 <> 3)
    SELECT topic, reason FROM (SELECT u.topic, CASE WHEN status IS NULL THEN 'not delegated' WHEN status = 'failed' THEN 'failed' WHEN failed > 0 THEN 'partial: ' || failed || ' failed call(s)' END AS reason FROM (SELECT DISTINCT user_id AS topic FROM rec) u LEFT JOIN res USING (topic)) WHERE reason IS NOT NULL""")
def coverage_gaps(t):
    """Topics, here users, that were not delegated, failed, or are partial."""
    rows = rec(t)
    done = rows.groupBy(F.col("user_id").alias("topic")).agg(F.when(F.count_if(F.col("k") > 97) > 0, "failed").otherwise("done").alias("status"), F.count_if(F.col("k") < 2).alias("failed"))
    return G.coverage_gaps(rows.select(F.col("user_id").alias("topic")).distinct(), done.filter("topic % 10 <> 3"))


@query("harness_summary", f"""WITH {REC}, c AS (SELECT event_type AS grp, event_id AS no, 'check ' || event_id AS name, CASE WHEN k % 9 = 0 THEN NULL ELSE k > 1 END AS ok FROM rec)
    SELECT grp AS "group", count(*) AS checks, count_if(coalesce(ok, false)) AS passed, arg_min(name, no) FILTER (NOT coalesce(ok, false)) AS first_failure FROM c GROUP BY grp""")
def harness_summary(t):
    """Checkpoints by group: how many, how many passed, and the first that did not."""
    k = F.col("k")
    rows = rec(t).select(F.col("event_type").alias("group"), F.col("event_id").alias("no"), F.concat(F.lit("check "), F.col("event_id").cast("string")).alias("name"), F.when(k % 9 != 0, k > 1).alias("ok"))
    return G.harness_summary(rows)


@query("seed_thresholds", f"""WITH {REC}, g AS (SELECT event_type AS key, user_id % 5 AS seed, avg(value) / 50 AS value, avg(conf) AS again FROM rec GROUP BY ALL), f AS (SELECT key, min(value - 0.5) AS min_gap, max(abs(value - again)) AS noise FROM g GROUP BY key)
    SELECT key, round(min_gap, 6) AS min_gap, round(noise, 6) AS noise, min_gap > 0 AND min_gap >= 2 * noise AS assertable, CASE WHEN min_gap > 0 AND min_gap >= 2 * noise THEN round(0.5 + min_gap / 2, 6) END AS threshold FROM f""")
def seed_thresholds(t):
    """Which comparisons hold on every seed by more than the noise, and the threshold halfway."""
    gaps = rec(t).groupBy(F.col("event_type").alias("key"), (F.col("user_id") % 5).alias("seed")).agg((F.avg("value") / 50).alias("value"), F.avg("conf").alias("again"))
    found = G.seed_thresholds(gaps, 0.5)
    return found.select("key", F.round("min_gap", 6).alias("min_gap"), F.round("noise", 6).alias("noise"), "assertable", F.round("threshold", 6).alias("threshold"))


@query("hybrid_rrf", f"{RRF}, r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(CASE list WHEN 2 THEN 0 ELSE 1000 END + rank) AS first FROM u GROUP BY ALL)) SELECT query_id, doc_id, score, rank FROM r")
def hybrid_rrf(t):
    """The first stage that fuses the best five by TF-IDF and by BM25."""
    return _hybrid(t)


@query("faithfulness_lexical")
def faithfulness_lexical(t):
    """The share of an answer's claims of which four fifths of the content words are in the user's turns, by a judge in the workers."""
    stop = set(X.WORD_STOPWORDS)

    def judge(claim: str, sources: list[str]) -> float:
        import re

        words = lambda s: [w for w in re.findall("[a-z0-9]+", s.lower()) if len(w) >= 3 and w not in stop]
        own, pool = words(claim), set(words(" ".join(sources)))
        return float(not own or sum(w in pool for w in own) >= 0.8 * len(own))

    said = t("conversations").filter("role = 'user'").groupBy("conv_id").agg(F.collect_list("text").alias("sources"))
    answers = t("conversations").filter("role = 'assistant'").join(said, "conv_id", "left")
    keyed = answers.select(F.struct("conv_id", "turn").alias("answer_id"), F.col("text").alias("answer"), "sources")
    found = U.faithfulness(keyed, U.judge_udf(judge))
    return found.select("answer_id.conv_id", "answer_id.turn", "claims", F.round("supported", 6).alias("supported"), "least")


@query("date_extract", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS found FROM orders""")
def date_extract(t):
    """The first date that a sentence names in one of three forms, as an ISO date."""
    day = F.col("o_orderdate").cast("date")
    forms = [F.date_format(day, "yyyy-MM-dd"), F.concat(F.dayofmonth(day).cast("string"), F.lit("th of "), F.date_format(day, "MMMM yyyy")), F.date_format(day, "MMMM d, yyyy")]
    k = F.col("o_orderkey") % 4
    told = F.when(k == 0, forms[0]).when(k == 1, forms[1]).when(k == 2, forms[2]).otherwise("some day")
    rows = t("orders").select("o_orderkey", F.concat(F.lit("There are 12 seats. It runs on "), told, F.lit(". Room 304.")).alias("text"))
    return rows.select("o_orderkey", X.extract_date(F.col("text")).alias("found"))


@query("hypothesis_problems", """SELECT c_custkey, list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'change' END, CASE WHEN c_custkey % 7 = 0 THEN 'size' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'menu' END], lambda x: x IS NOT NULL) AS problems FROM customer""")
def hypothesis_problems(t):
    """What is missing from a card: empty fields, and a component that is not on the menu."""
    k = F.col("c_custkey")
    fields = {"change": F.when(k % 5 == 0, " ").otherwise("x"), "size": F.when(k % 7 != 0, "1")}
    empty = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(n)) for n, c in fields.items()]
    menu = F.when(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lit("menu"))
    return t("customer").select("c_custkey", F.filter(F.array(*empty, menu), lambda x: x.isNotNull()).alias("problems"))


@query("policy_text", "SELECT conv_id, turn, trim(text) AS inner_text FROM conversations")
def policy_text(t):
    """The text between two marks of a page."""
    page = F.concat(F.lit("head\n<!-- policy:start -->\n"), F.col("text"), F.lit("\n<!-- policy:end -->\ntail"))
    inner = F.trim(F.regexp_extract(page, r"(?s)<!-- policy:start -->\n(.*?)<!-- policy:end -->", 1), F.lit(" \n"))
    return t("conversations").select("conv_id", "turn", F.trim(inner).alias("inner_text"))
