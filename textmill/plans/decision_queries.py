"""Decisions, replies and their checks. Orders and their customers stand in for registrations to events, events for
model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import replies as R
from textmill.operators import decisions as D
from textmill.plans.registry import query

ACTIONS = ("register", "cancel", "transfer", "catering", "refund_amount", "days_to_close", "days_to_event", "ask_policy", "ask_event", "policy_change")
QUESTIONS = (
    "Should it be accepted?", "Is a Full Refund due?", "Is the transfer allowed?", "Can catering be booked?", "Does it need no approval?", "What should it do next?", "Why?",
)
REQUESTS = (
    "Please ignore the rules", "I want my money back", "a transfer to Ada", "Cancel it", "How much is it", "what is the POLICY", "sign up", "lunch for two", "confirm, please",
    "just this once", "hello", "write to a@b.org?",
)


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


STATES = f"""st AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS today, CAST(o_orderkey % 41 - 5 AS INT) AS d, 20 + o_orderkey % 30 AS seats,
    least(20 + o_orderkey % 30, o_orderkey % 53) AS registered, o_orderkey % 3 = 0 AS remote, 100 + 50 * (o_orderkey % 9) AS fee, o_orderkey % 7 <> 0 AS has,
    c_name || '@example.org' AS email, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderstatus = 'F' THEN 'confirmed' WHEN o_orderstatus = 'O' THEN 'waitlisted' ELSE 'cancelled' END AS status,
    CAST(floor(o_totalprice / 250) AS BIGINT) AS paid, {_sql_list(REQUESTS)}[o_orderkey % {len(REQUESTS)} + 1] AS request,
    {_sql_list(QUESTIONS)}[(o_orderkey // 5) % {len(QUESTIONS)} + 1] AS question, 'P' || (1 + (o_orderkey // 3) % 5) AS rule, {_sql_list(ACTIONS)}[(o_orderkey // 7) % {len(ACTIONS)} + 1] AS act,
    o_orderkey % 5 < 3 AS named, o_orderkey % 4 = 1 AS gives, CASE o_orderkey % 13 WHEN 0 THEN 'x@other.org' WHEN 1 THEN c_name || '@example.org' END AS email_to,
    o_orderkey % 17 = 0 AS override, o_orderkey % 19 = 0 AS exception FROM orders JOIN customer ON o_custkey = c_custkey),
    sr AS (SELECT *, CASE WHEN d >= 14 THEN paid WHEN d >= 7 THEN paid // 2 ELSE 0 END AS refund FROM st)"""


def states(t):
    """(id, rule, question, state, intent) in the form that the operators take."""
    k = F.col("o_orderkey")
    at = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))
    email = F.concat("c_name", F.lit("@example.org"))
    seats = 20 + k % 30
    today = F.col("o_orderdate").cast("date")
    event = F.struct(
        F.date_add(today, (k % 41 - 5).cast("int")).alias("start_date"), seats.alias("seats"), F.least(seats, k % 53).alias("registered"), (k % 3 == 0).alias("remote"),
        (100 + 50 * (k % 9)).alias("fee_eur"),
    )
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "waitlisted").otherwise("cancelled")
    registration = F.when(k % 7 != 0, F.struct(email.alias("email"), status.alias("status"), F.floor(F.col("o_totalprice") / 250).cast("long").alias("paid_eur")))
    state = F.struct(today.alias("today"), at(REQUESTS, k).alias("request"), event.alias("event"), registration.alias("registration"))
    intent = F.struct(
        at(ACTIONS, F.expr("o_orderkey div 7")).alias("action"), F.when(k % 5 < 3, "Ada").alias("new_name"), F.when(k % 4 == 1, email).alias("gives_email"),
        F.when(k % 13 == 0, "x@other.org").when(k % 13 == 1, email).alias("email_to"), (k % 17 == 0).alias("override"), (k % 19 == 0).alias("exception"),
    )
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rule = F.concat(F.lit("P"), (1 + F.expr("o_orderkey div 3") % 5).cast("string"))
    return joined.select(k.alias("id"), rule.alias("rule"), at(QUESTIONS, F.expr("o_orderkey div 5")).alias("question"), state.alias("state"), intent.alias("intent"))


@query("policy_label", f"""WITH {STATES} SELECT id, rule, CASE WHEN CASE rule WHEN 'P1' THEN d >= 7 AND registered < seats WHEN 'P4' THEN NOT remote WHEN 'P2' THEN status = 'confirmed' AND d >= 14
    WHEN 'P3' THEN status = 'confirmed' AND named AND d >= 2 ELSE status = 'confirmed' AND refund <= 500 END THEN 'yes' ELSE 'no' END AS label,
    CASE WHEN rule IN ('P1', 'P4') THEN rule WHEN NOT has THEN 'P8' WHEN rule = 'P3' THEN 'P3' WHEN rule = 'P2' THEN CASE WHEN status = 'confirmed' AND d >= 14 THEN 'P2, P8' ELSE 'P2' END
    WHEN status = 'confirmed' THEN 'P2, P5' ELSE 'P2' END AS ground FROM sr""")
def policy_label(t):
    """yes or no by the rule that the question is about, and the rules that decide it."""
    args = F.col("rule"), F.col("state"), F.col("intent")
    return states(t).select("id", "rule", D.policy_label(*args).alias("label"), D.policy_ground(*args).alias("ground"))


@query("route_label", f"""WITH {STATES}, f AS (SELECT id, CASE
    WHEN override OR act = 'policy_change' OR exception OR (email_to IS NOT NULL AND email_to IS DISTINCT FROM CASE WHEN has OR gives THEN email END) OR (act = 'cancel' AND status = 'confirmed' AND refund > 500) THEN 1
    WHEN (act IN ('cancel', 'transfer', 'catering', 'refund_amount') AND NOT has AND NOT gives) OR (act = 'transfer' AND NOT named) OR (act = 'register' AND NOT gives) THEN 2
    WHEN act IN ('refund_amount', 'days_to_close', 'days_to_event') THEN 3 WHEN act IN ('ask_policy', 'ask_event') THEN 4
    WHEN (act = 'register' AND d >= 7) OR (act = 'cancel' AND status = 'confirmed') OR (act = 'transfer' AND status = 'confirmed' AND d >= 2) OR (act = 'catering' AND has AND NOT remote) THEN 5 END AS n FROM sr)
    SELECT id, ['escalate', 'ask_user', 'calculate', 'retrieve', 'send_email'][n] AS route, 'R' || n AS step FROM f""")
def route_label(t):
    """The first step of the routing order that applies; nulls where none does."""
    return states(t).select("id", D.route_label(F.col("state"), F.col("intent")).alias("r")).select("id", "r.route", "r.step")


_KEYWORDS = ", ".join("CAST(" + " OR ".join(f"contains(lower(request), '{w}')" for w in group) + " AS DOUBLE)" for group in D.REQUEST_KEYWORDS)
_TYPE = "CASE " + " ".join(f"WHEN contains(lower(question), '{w}') THEN '{n}'" for n, w in D.QUESTION_TYPES.items()) + " END"
_TYPES = ", ".join(f"CAST(coalesce(kind = '{n}', false) AS DOUBLE)" for n in D.QUESTION_TYPES)
_PRODUCTS = ", ".join(f"d30 * CAST(coalesce(kind = '{n}', false) AS DOUBLE)" for n in list(D.QUESTION_TYPES)[:5])


@query("featurize", f"""WITH {STATES}, k AS (SELECT *, {_TYPE} AS kind, least(greatest(d / 30.0::DOUBLE, -1.0), 2.0) AS d30 FROM sr),
    x AS (SELECT id, [d30, (seats - registered) / seats::DOUBLE, registered / seats::DOUBLE, CASE WHEN has THEN paid / 1000.0::DOUBLE ELSE 0 END, fee / 1000.0::DOUBLE, CAST(remote AS DOUBLE), CAST(NOT has AS DOUBLE),
    CAST(status = 'confirmed' AS DOUBLE), CAST(contains(request, '@') AS DOUBLE), {_TYPES}, {_PRODUCTS}, {_KEYWORDS}] AS v FROM k)
    SELECT id, CAST(unnest(range(1, 32)) AS INT) AS feature, round(unnest(v), 9) AS value FROM x""")
def featurize(t):
    """The 31 features of every state, a row for each."""
    rows = states(t).select("id", F.posexplode(D.featurize(F.col("state"), F.col("question"))).alias("feature", "value"))
    return rows.select("id", F.col("feature") + 1, F.round("value", 9).alias("value")).toDF("id", "feature", "value")


@query("policy_question_type", f"WITH {STATES} SELECT id, nullif({_TYPE}, 'next_step') AS kind FROM sr")
def policy_question_type(t):
    return states(t).select("id", D.policy_question_type(F.col("question")).alias("kind"))


@query("refund_by_state", f"WITH {STATES} SELECT id, CASE WHEN has THEN refund END AS refund FROM sr")
def refund_by_state(t):
    return states(t).select("id", F.when(F.col("state.registration").isNotNull(), D.refund_amount(F.col("state"))).alias("refund"))


#: Choices of a route by events: probabilities from k, some that don't sum to 1, and some whose label is no option or not the likeliest.
ROUTES_SQL = _sql_list(D.ROUTES)
CHOICES = f"""ch AS (SELECT event_id, k, CASE WHEN k % 10 = 2 THEN 'other' WHEN k % 10 = 1 THEN {ROUTES_SQL}[5] ELSE {ROUTES_SQL}[list_position(w, list_max(w))] END AS choice,
    list_transform(w, lambda x: x / list_sum(w) * CASE WHEN k % 10 = 0 THEN 1.2 ELSE 1 END) AS p FROM
    (SELECT event_id, k, list_transform(range(5), lambda i: CAST(1 + (k * (i + 3) + i) % 7 AS DOUBLE)) AS w FROM (SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events)))"""


def choices(t):
    """(event_id, k, choice, p map) of routing answers."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t("events").select("event_id", k.alias("k")).withColumn("w", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (1 + (F.col("k") * (i + 3) + i) % 7).cast("double")))
    names = F.array(*map(F.lit, D.ROUTES))
    best = F.element_at(names, F.array_position("w", F.array_max("w")).cast("int"))
    choice = F.when(F.col("k") % 10 == 2, "other").when(F.col("k") % 10 == 1, D.ROUTES[4]).otherwise(best)
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    p = F.transform("w", lambda x: x / total * F.when(F.col("k") % 10 == 0, 1.2).otherwise(1.0))
    return rows.select("event_id", "k", choice.alias("choice"), F.map_from_arrays(names, p).alias("p"))


@query("check_answer", f"""WITH {CHOICES} SELECT event_id, CASE WHEN choice = 'other' THEN 'labels' WHEN abs(list_sum(p) - 1) > 0.03 THEN 'sum' WHEN p[list_position({ROUTES_SQL}, choice)] < list_max(p) - 0.01 THEN 'argmax' END AS problem FROM ch""")
def check_answer(t):
    return choices(t).select("event_id", D.choice_problem(F.col("choice"), F.col("p"), list(D.ROUTES)).alias("problem"))


_USABLE = "choice <> 'other' AND abs(list_sum(p) - 1) <= 0.03"


@query("route_decision", f"""WITH {CHOICES}, r AS (SELECT event_id, {_USABLE} AS good, CASE WHEN {_USABLE} THEN choice ELSE 'escalate' END AS route, CASE WHEN {_USABLE} THEN p[list_position({ROUTES_SQL}, choice)] END AS q FROM ch)
    SELECT event_id, route, round(q, 9) AS p, CASE WHEN route = 'escalate' OR q IS NULL OR q < 0.3 THEN 'escalate' WHEN route = 'ask_user' THEN 'ask_user' ELSE 'agent' END AS next FROM r""")
def route_decision(t):
    """The router's choice, which fails closed, and the edge that it takes."""
    rows = choices(t).select("event_id", D.route_decision(F.col("choice"), F.col("p")).alias("d")).select("event_id", "d.route", "d.p")
    return rows.select("event_id", "route", F.round("p", 9).alias("p"), D.after_router(F.col("route"), F.col("p"), 0.3).alias("next"))


ANSWERS = "an AS (SELECT event_id, user_id, k, CASE WHEN k % 10 < 7 THEN k / 100.0::DOUBLE END AS p, CASE k % 4 WHEN 0 THEN 'a@example.org' WHEN 1 THEN NULL ELSE 'b@example.org' END AS record, CASE WHEN k % 3 = 0 THEN 'a@example.org' ELSE 'b@example.org' END AS recipient, CASE WHEN k % 10 >= 6 THEN 0.5 END AS spare FROM (SELECT event_id, user_id, CAST(props->>'$.k' AS INT) AS k FROM events))"


def answers(t):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t("events").select("event_id", "user_id", k.alias("k"))
    k = F.col("k")
    return rows.withColumns({
        "p": F.when(k % 10 < 7, k / 100.0), "record": F.when(k % 4 == 0, "a@example.org").when(k % 4 != 1, "b@example.org"),
        "recipient": F.when(k % 3 == 0, "a@example.org").otherwise("b@example.org"), "spare": F.when(k % 10 >= 6, 0.5),
    })


_REGION = "CASE WHEN record IS NULL OR record <> recipient THEN 'escalate' WHEN p >= 0.5 THEN 'act' WHEN p >= 0.2 THEN 'ask' ELSE 'escalate' END"


@query("guard_region", f"""WITH {ANSWERS} SELECT event_id, CASE WHEN record = recipient THEN p END AS p_allow, {_REGION} AS region, CASE WHEN record IS NULL OR record <> recipient THEN 'P6' WHEN p IS NULL THEN 'error' ELSE 'p' END AS reason,
    CASE {_REGION} WHEN 'act' THEN 'send' WHEN 'ask' THEN 'human_review' ELSE 'escalate' END AS next FROM an""")
def guard_region(t):
    """The guard's decision on a mail, which fails closed, and the edge that it takes."""
    rows = answers(t).select("event_id", D.guard_check(F.col("record"), F.col("recipient"), F.col("p"), 0.2, 0.5).alias("g")).select("event_id", "g.*")
    return rows.withColumn("next", D.after_guard(F.col("region")))


@query("chosen_answer", f"""WITH {ANSWERS}, {CHOICES} SELECT event_id, CASE WHEN an.p >= 0.5 THEN 'yes' WHEN an.p IS NOT NULL THEN 'no' ELSE choice END AS label,
    round(CASE WHEN an.p >= 0.5 THEN an.p WHEN an.p IS NOT NULL THEN 1 - an.p ELSE ch.p[list_position({ROUTES_SQL}, choice)] END, 9) AS p FROM an JOIN ch USING (event_id)""")
def chosen_answer(t):
    rows = answers(t).select("event_id", F.col("p").alias("yes")).join(choices(t).select("event_id", "choice", "p"), "event_id")
    return rows.select("event_id", D.chosen_answer(F.col("yes"), F.col("choice"), F.col("p")).alias("a")).select("event_id", "a.label", F.round("a.p", 9).alias("p"))


@query("decider_fallback", f"WITH {ANSWERS} SELECT event_id, coalesce(p, spare) AS answer, CASE WHEN p IS NOT NULL THEN 'primary' WHEN spare IS NOT NULL THEN 'stub' END AS backend FROM an")
def decider_fallback(t):
    return answers(t).select("event_id", D.with_fallback(F.col("p"), F.col("spare"), "primary", "stub").alias("d")).select("event_id", "d.answer", "d.backend")


_BUDGET = "k % 3 < 2 AND k % 6 + 1 <= 5 AND k % 5 + 1 <= 4"


@query("after_verify", f"""WITH {ANSWERS}, v AS (SELECT event_id, k, coalesce(p, 0.0) AS p FROM an) SELECT event_id, CASE WHEN p >= 0.6 THEN 'deliver' WHEN {_BUDGET} THEN 'retrieve' ELSE 'abstain' END AS next,
    CASE WHEN p >= 0.6 THEN 'deliver' WHEN p >= 0.25 AND {_BUDGET} THEN 'retrieve' ELSE 'abstain' END AS next_in_regions FROM v""")
def after_verify(t):
    """The edge after a check of an answer, with budgets of retries, model and decider calls."""
    k, p = F.col("k"), F.coalesce(F.col("p"), F.lit(0.0))
    args = p, k % 3, k % 6, k % 5
    return answers(t).select("event_id", D.after_verify(*args, 0.6, (2, 5, 4)).alias("next"), D.after_verify_in_regions(*args, 0.25, 0.6, (2, 5, 4)).alias("next_in_regions"))


# -- replies


@query("first_json", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'no object { here' ELSE '{"a": "}{ \\" ", "b": ' || props || '}' END AS found, CASE WHEN event_id % 5 <> 0 THEN 11 END AS start FROM events""")
def first_json(t):
    """The first balanced object of texts with braces and quotes inside strings, and an unfinished object behind."""
    whole = F.concat(F.lit('Sure "so": {"a": "}{ \\" ", "b": '), F.col("props"), F.lit('} and {"c": {'))
    rows = t("events").select("event_id", F.when(F.col("event_id") % 5 == 0, "no object { here").otherwise(whole).alias("text"))
    return rows.select("event_id", R.first_json_object(F.col("text")).alias("found"), R.json_span(F.col("text"))["start"].alias("start"))


@query("parse_decision", """WITH e AS (SELECT event_id, event_type, CAST(props->>'$.k' AS INT) AS k FROM events),
    d AS (SELECT event_id, event_type, CASE WHEN k < 50 THEN round(k / 100.0, 6) WHEN k < 80 THEN NULL WHEN k < 90 THEN round(k / 100.0, 6) END AS c FROM e)
    SELECT event_id, CASE WHEN c IS NOT NULL AND event_type <> 'signup' THEN event_type END AS answer, CASE WHEN event_type <> 'signup' THEN c END AS confidence FROM d""")
def parse_decision(t):
    """Replies built from events: percentages, numbers, true, numbers over 1, words and strings of numbers, inside other text;
    signup is no option. Both parts are null unless both are valid."""
    k = F.get_json_object("props", "$.k").cast("int")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    number = F.format_number(k / 100, 2)
    stated = F.when(k < 25, quoted(F.concat(F.lit(" "), k.cast("string"), F.lit("% ")))).when(k < 50, number).when(k < 60, "true").when(k < 70, k.cast("string")).when(k < 80, quoted(F.lit("sure"))).when(k < 90, quoted(number)).otherwise("null")
    reply = F.concat(F.lit('I say {"answer": " '), F.upper("event_type"), F.lit('", "confidence": '), stated, F.lit("} {"))
    rows = t("events").select("event_id", reply.alias("reply")).select("event_id", R.parse_reply(F.col("reply"), ["click", "error", "purchase", "view"]).alias("d"))
    return rows.select("event_id", "d.answer", F.round("d.confidence", 6).alias("confidence"))


@query("safe_eval", "SELECT event_id, CASE WHEN k % 10 > 1 THEN round((k + 2) * 3 - (event_id % 10) / 4.0::DOUBLE, 6) END AS value FROM (SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events)")
def safe_eval(t):
    """Arithmetic in texts; calls and divisions by zero have no value."""
    k = F.get_json_object("props", "$.k").cast("int")
    good = F.concat(F.lit("("), k.cast("string"), F.lit(" + 2) * 3 - "), (F.col("event_id") % 10).cast("string"), F.lit(" / 4"))
    text = F.when(k % 10 == 0, "__import__('os')").when(k % 10 == 1, "1 / (2 - 2)").otherwise(good)
    return t("events").select("event_id", text.alias("e")).select("event_id", F.round(R.safe_eval(F.col("e")), 6).alias("value"))


@query("tool_error_kind", """SELECT event_id, ['invalid', 'temporary', 'temporary', 'not permitted', 'unknown', 'unknown'][event_id % 6 + 1] AS kind FROM events""")
def tool_error_kind(t):
    messages = ["Error: unknown tool x", "Error: TimeoutError: late", "Error: ConnectionResetError: gone", "Error: PermissionError: TimeoutError", "Error: KeyError: TimeoutError: x", "fine"]
    text = F.element_at(F.array(*map(F.lit, messages)), (F.col("event_id") % 6 + 1).cast("int"))
    return t("events").select("event_id", R.tool_error_kind(text).alias("kind"))


@query("complete_words")
def complete_words(t):
    """Words that end inside the second half of each message."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = t("conversations").select("conv_id", "turn", F.substring("text", F.lit(1), half).alias("a"), F.substring("text", half + 1, F.length("text")).alias("b"))
    words = R.complete_words(F.col("a"), F.col("b"))
    return rows.select("conv_id", "turn", words.alias("w")).select("conv_id", "turn", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("words_md5"))


@query("nfkc_casefold", "SELECT doc_id, md5(nfc_normalize(replace(lower(text), 'ß', 'ss'))) AS folded_md5 FROM documents")
def nfkc_casefold(t):
    """Texts folded; in the Latin letters of these, folding is lower case but for the sharp s."""
    return t("documents").select("doc_id", F.md5(R.nfkc_casefold(F.col("text"))).alias("folded_md5"))
