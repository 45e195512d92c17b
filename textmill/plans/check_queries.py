"""Checks of run records, submissions, plans and annotations, over events, orders and labels as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.operators import checks as K
from textmill.plans.registry import query

RUNS = """run AS (SELECT user_id AS lab, event_id AS index, CAST(ts AS DATE) AS date, CASE WHEN k % 4 = 0 THEN 'fail' ELSE 'pass' END AS status, k % 5 = 0 AS stale, CASE WHEN k % 3 > 0 THEN 'x' || k END AS content_sha,
    CASE WHEN k % 2 = 0 THEN 'notebook' ELSE 'partial' END AS scope, k % 7 = 0 AS quick, 'f' || event_id % 3 AS file FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events)),
    newest AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY lab ORDER BY NOT stale DESC, content_sha IS NOT NULL DESC, date DESC, status = 'fail' DESC, scope = 'notebook' DESC, NOT quick DESC, file DESC, index DESC) = 1)"""


def runs(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t("events").select(
        F.col("user_id").alias("lab"), F.col("event_id").alias("index"), F.col("ts").cast("date").alias("date"), F.when(k % 4 == 0, "fail").otherwise("pass").alias("status"),
        (k % 5 == 0).alias("stale"), F.when(k % 3 > 0, F.concat(F.lit("x"), k.cast("string"))).alias("content_sha"), F.when(k % 2 == 0, "notebook").otherwise("partial").alias("scope"),
        (k % 7 == 0).alias("quick"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("file"),
    )


@query("newest_run", f"WITH {RUNS} SELECT lab, index, status FROM newest")
def newest_run(t):
    """The most telling record of each lab."""
    return K.newest(runs(t), ["lab"]).select("lab", "index", "status")


@query("release_blockers", f"""WITH {RUNS}, lim AS (SELECT max(date) - 3 AS as_of FROM run), n2 AS (SELECT * FROM run, lim WHERE date <= as_of + 1 AND scope = 'notebook' AND NOT quick QUALIFY row_number() OVER (PARTITION BY lab ORDER BY NOT stale DESC, content_sha IS NOT NULL DESC, date DESC, status = 'fail' DESC, scope = 'notebook' DESC, NOT quick DESC, file DESC, index DESC) = 1),
    labs AS (SELECT DISTINCT lab FROM run UNION ALL SELECT -1)
    SELECT lab, why FROM (SELECT lab, CASE WHEN status IS NULL THEN 'none' WHEN stale THEN 'stale' WHEN status <> 'pass' THEN 'failed' WHEN date_diff('day', date, (SELECT as_of FROM lim)) > 5 THEN 'old' END AS why FROM labs LEFT JOIN n2 USING (lab)) WHERE why IS NOT NULL""")
def release_blockers(t):
    """Why a lab is not ready three days before the last record, with five days as the limit, by its newest whole and not
    quick run; one lab has no record."""
    rows = runs(t)
    labs = rows.select("lab").distinct().unionByName(rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("lab")))
    as_of = rows.agg(F.date_sub(F.max("date"), 3).alias("d")).first()["d"]
    return K.release_blockers(labs, rows, F.lit(as_of).cast("date"), 5, (F.col("scope") == "notebook") & ~F.col("quick"))


@query("readiness_summary", f"""WITH {RUNS} SELECT count(*) AS labs, count_if(status = 'pass' AND NOT stale) AS ready, count_if(status = 'fail' AND NOT stale) AS failed, count_if(stale) AS stale, CAST(0 AS BIGINT) AS missing,
    max(date) AS as_of, min(date) AS first, bool_and(status = 'pass' AND NOT stale) AS ready_all FROM newest""")
def readiness_summary(t):
    rows = runs(t)
    return K.readiness_summary(rows.select("lab").distinct(), rows)


@query("teaching_eligible", """SELECT event_id, (event_type = 'view' AND k % 3 = 0 AND k % 2 = 0 AND value > 20 AND k % 7 <> 0) AS eligible, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 8 < 4 THEN 'colab-cpu' ELSE 'colab-t4' END AS env, CASE WHEN k % 5 = 0 OR k % 6 = 0 THEN 'offline' WHEN k % 2 = 0 THEN 'keyed' ELSE 'open' END AS path
    FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events)""")
def teaching_eligible(t):
    """Whether a record shows a lab as it is taught, and the environment and path that its flags stand for."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t("events").select(
        "event_id", k.alias("k"), F.col("event_type").alias("env"), F.when(k % 3 == 0, "keyed").otherwise("open").alias("path"), F.when(k % 2 == 0, "notebook").otherwise("partial").alias("scope"),
        F.lit("worked").alias("mode"), F.when(F.col("value") > 20, "tool").otherwise("backfill").alias("source"), (k % 7 == 0).alias("quick"),
    )
    k = F.col("k")
    env = K.env_of(F.when(k % 4 != 0, "r1"), F.when(k % 8 >= 4, "Tesla T4"))
    path = K.path_of(k % 5 == 0, k % 6 == 0, F.when(k % 2 == 0, "openai"), F.lit(None).cast("string"))
    return rows.select("event_id", K.teaching_eligible(F.lit("view"), F.lit("keyed")).alias("eligible"), env.alias("env"), path.alias("path"))


@query("submission_status", """WITH s AS (SELECT o_orderkey AS id, o_orderkey % 11 <> 0 AS a, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 17 <> 0 END AS b, CASE o_orderkey % 5 WHEN 0 THEN 'stub' ELSE 'open' END AS path,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 3 ELSE 2 END AS runs, o_orderkey % 3 <> 0 AS t, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 = 0 END AS u FROM orders)
    SELECT id, CASE WHEN NOT a OR b IS NULL OR NOT b THEN 'not comparable' WHEN path = 'stub' THEN 'code check only' WHEN runs IS DISTINCT FROM 2 THEN 'test used for development' WHEN NOT t OR NOT coalesce(u, true) THEN 'over budget' ELSE 'ranked' END AS status,
    CASE WHEN NOT a OR b IS NULL OR NOT b THEN concat_ws(',', CASE WHEN NOT a THEN 'hash' END, CASE WHEN b IS NULL OR NOT b THEN 'manifest' END) WHEN path = 'stub' OR runs IS DISTINCT FROM 2 THEN '' ELSE concat_ws(',', CASE WHEN NOT t THEN 'time' END, CASE WHEN NOT coalesce(u, true) THEN 'usd' END) END AS reasons FROM s""")
def submission_status(t):
    """The first status that applies, with its reasons."""
    k = F.col("o_orderkey")
    runs_ = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, 3).otherwise(2)
    checks = {"hash": k % 11 != 0, "manifest": F.when(k % 13 != 0, k % 17 != 0)}
    budget = {"time": k % 3 != 0, "usd": F.when(k % 2 == 0, k % 4 == 0)}
    s = K.submission_status(checks, F.when(k % 5 == 0, "stub").otherwise("open"), runs_, budget)
    return t("orders").select(k.alias("id"), s.alias("s")).select("id", "s.status", F.array_join("s.reasons", ",").alias("reasons"))


@query("well_formed", "SELECT event_id, event_id % 3 <> 0 AS ok FROM events")
def well_formed(t):
    """Whether nested fields of a record are there."""
    record = F.concat(F.lit('{"pair": 1, "compare": {"test": '), F.when(F.col("event_id") % 3 == 0, "null").otherwise(F.col("props")), F.lit("}}"))
    return t("events").select("event_id", K.well_formed(record, ["$.pair", "$.compare.test.k"]).alias("ok"))


@query("signature_holds", "WITH s AS (SELECT event_type, avg(value) AS m, max(CAST(props->>'$.k' AS INT)) AS k FROM events GROUP BY event_type) SELECT event_type, m >= 40 AS a, false AS b, k >= 99 AS c FROM s")
def signature_holds(t):
    """Which thresholds each type of event reaches; one threshold is not known."""
    s = t("events").groupBy("event_type").agg(F.avg("value").alias("m"), F.max(F.get_json_object("props", "$.k").cast("int")).alias("k"))
    found = K.signature({"a": F.col("m"), "b": F.col("m"), "c": F.col("k")}, {"a": F.lit(40.0), "b": F.lit(None).cast("double"), "c": F.lit(99)})
    return s.select("event_type", found.alias("x")).select("event_type", "x.*")


PLAN = """plan AS (SELECT o_custkey AS lecture, o_orderkey AS no, 1 + o_orderkey % 9 AS section, CASE WHEN o_orderkey % 23 = 0 THEN -1 ELSE 5 * (o_orderkey % 4) END AS minutes FROM orders),
    sec AS (SELECT c_custkey AS lecture, CAST(s AS BIGINT) AS section, (c_custkey + s) % 5 = 0 AS reference FROM customer, (SELECT unnest(range(1, 8)) AS s))"""


@query("plan_checks", f"""WITH {PLAN}, b AS (SELECT lecture, section, lag(section) OVER (PARTITION BY lecture ORDER BY no) AS prev FROM plan)
    SELECT lecture, 'twice' AS problem, CAST(section AS VARCHAR) AS detail FROM plan GROUP BY lecture, section HAVING count(*) > 1
    UNION ALL SELECT * FROM (SELECT lecture, CASE WHEN reference IS NULL THEN 'unknown' WHEN reference AND p.section IS NOT NULL THEN 'reference' WHEN NOT reference AND p.section IS NULL THEN 'missing' END AS problem, CAST(section AS VARCHAR) AS detail FROM sec FULL JOIN (SELECT DISTINCT lecture, section FROM plan) p USING (lecture, section)) WHERE problem IS NOT NULL
    UNION ALL SELECT lecture, 'order', CAST(section AS VARCHAR) FROM b WHERE section < prev
    UNION ALL SELECT lecture, 'shape', CAST(no AS VARCHAR) FROM plan WHERE minutes < 0
    UNION ALL SELECT lecture, 'sum', CAST(sum(minutes) AS VARCHAR) FROM plan GROUP BY lecture HAVING sum(minutes) <> 60""".replace("p.section IS NOT NULL", "p.lecture IS NOT NULL").replace("p.section IS NULL", "p.lecture IS NULL"))
def plan_checks(t):
    """What is wrong with plans of sections: orders stand in for entries, customers for lectures of seven sections."""
    k = F.col("o_orderkey")
    plan = t("orders").select(F.col("o_custkey").alias("lecture"), k.alias("no"), (1 + k % 9).alias("section"), F.when(k % 23 == 0, -1).otherwise(5 * (k % 4)).alias("minutes"))
    sections = t("customer").select(F.col("c_custkey").alias("lecture"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("section"))
    return K.plan_problems(plan, sections.withColumn("reference", (F.col("lecture") + F.col("section")) % 5 == 0), 60)


@query("slot_pairs", """WITH s AS (SELECT user_id AS day, CASE WHEN event_type IN ('click', 'view') THEN 'lecture' ELSE 'lab' END AS kind, event_id AS slot FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY day, kind ORDER BY slot) AS nth FROM s)
    SELECT day, nth, a.slot AS lecture_at, b.slot AS lab_at FROM (SELECT * FROM n WHERE kind = 'lecture') a FULL JOIN (SELECT * FROM n WHERE kind = 'lab') b USING (day, nth)""")
def slot_pairs(t):
    """The nth lecture slot of a day beside the nth lab slot."""
    kind = F.when(F.col("event_type").isin("click", "view"), "lecture").otherwise("lab")
    return K.slot_pairs(t("events").select(F.col("user_id").alias("day"), kind.alias("kind"), F.col("event_id").alias("at")), "day", "kind", "at")


@query("question_errors", """WITH q AS (SELECT doc_id, doc_id % 13 AS m, doc_id % 4 AS kind FROM documents)
    SELECT 'q' || CASE WHEN m = 12 THEN doc_id - 1 ELSE doc_id END AS id, unnest(list_filter([CASE WHEN m = 1 THEN 'split' END, CASE WHEN m = 2 THEN 'question' END, CASE WHEN m = 3 AND kind = 3 THEN 'no evidence' END, CASE WHEN m = 4 AND kind <> 3 THEN 'evidence' END,
    CASE WHEN kind = 1 AND (m IN (5, 4)) THEN 'groups' END, CASE WHEN m = 6 AND kind <> 3 THEN 'quote' END, CASE WHEN m = 7 AND kind <> 3 THEN 'quote length' END, CASE WHEN m = 8 THEN 'key facts' END, CASE WHEN m = 9 THEN 'author' END, CASE WHEN m = 10 THEN 'one person' END], lambda x: x IS NOT NULL)) AS error FROM q
    UNION ALL SELECT 'q' || (doc_id - 1), 'duplicate id' FROM q WHERE m = 12 AND doc_id - 1 IN (SELECT doc_id FROM documents)""")
def question_errors(t):
    """What is wrong with question items that are built from documents, one fault each or none."""
    m, kind = F.col("doc_id") % 13, F.col("doc_id") % 4
    span = F.struct(F.lit("page").alias("slug"), F.when(m == 6, " ").when(m == 7, "one two three four five").otherwise("one two").alias("quote"))
    none = F.array().cast("array<array<struct<slug:string,quote:string>>>")
    evidence = F.when((kind == 3) & (m != 3), none).when((m == 4) & (kind != 3), none).when((kind == 1) & (m != 5), F.array(F.array(span), F.array(span))).otherwise(F.array(F.array(span)))
    items = t("documents").select(
        F.concat(F.lit("q"), F.when(m == 12, F.col("doc_id") - 1).otherwise(F.col("doc_id")).cast("string")).alias("id"), F.when(m == 1, "train").otherwise("dev").alias("split"),
        F.element_at(F.array(*map(F.lit, ["single", "multi", "lookup", "unanswerable"])), (kind + 1).cast("int")).alias("kind"), F.when(m == 2, " ").otherwise("Why?").alias("question"),
        evidence.alias("evidence"), F.when(m == 8, F.array(F.lit(""))).otherwise(F.array(F.lit("fact"))).alias("key_facts"), F.when(m == 9, "a1").when(m == 10, "CD").otherwise("AB").alias("author"), F.lit("CD").alias("checker"),
    )
    return K.question_errors(items, ["dev", "test"], ["single", "multi", "lookup", "unanswerable"], 4)


@query("merge_annotations", """WITH l AS (SELECT doc_id AS id, max(quality) AS a, max(CASE WHEN doc_id % 9 > 0 THEN CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END END) AS b FROM labels GROUP BY doc_id),
    r AS (SELECT id, id % 7 = 0 AS dropped, CASE WHEN id % 7 = 1 THEN 'x' END AS label FROM l WHERE id % 7 < 3)
    SELECT id, CAST(a AS VARCHAR) AS label_a, CAST(b AS VARCHAR) AS label_b, CASE status WHEN 'agreed' THEN CAST(a AS VARCHAR) WHEN 'resolved' THEN res END AS label, status FROM (SELECT l.id, a, b, r.label AS res,
    CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN dropped THEN 'dropped' WHEN r.label IS NOT NULL THEN 'resolved' WHEN a = b AND r.id IS NULL THEN 'agreed' ELSE 'unresolved' END AS status FROM l LEFT JOIN r USING (id))""")
def merge_annotations(t):
    """Two annotators' labels and the resolutions of their disputes."""
    i = F.col("id")
    base = t("labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"))
    a = base.select("id", F.col("q").cast("string").alias("label"))
    flipped = t("labels").filter("doc_id % 9 > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).cast("string").alias("label"))
    resolved = base.filter(i % 7 < 3).select("id", (i % 7 == 0).alias("drop"), F.when(i % 7 == 1, "x").alias("label"))
    return K.merge_annotations(base.select("id"), a, flipped, resolved)


@query("manifest_allocate")
def manifest_allocate(t):
    """200 slots over the strata of source and language, at least one for each source."""
    n = t("documents").groupBy("source", F.col("lang").alias("kind")).agg(F.count(F.lit(1)).alias("size")).filter("source IS NOT NULL AND kind IS NOT NULL")
    return K.allocate_slots(n, 200).withColumnRenamed("kind", "lang")
