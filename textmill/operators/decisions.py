"""Decisions over records of events and registrations: the policy's rules, the routing order, the features of a small
decision model, checks of typed answers, and the edges of an agent's graph. All are Column expressions.

A state is a struct: today date, request string, event struct (start_date date, seats, registered, remote boolean,
fee_eur), registration struct (email, status, paid_eur) or null. An intent is a struct: action, new_name, gives_email,
email_to strings, override and exception booleans. Nulls in an intent count as not given.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days and amounts of the policy.
CLOSE_DAYS, FULL_REFUND_DAYS, HALF_REFUND_DAYS, TRANSFER_DAYS, APPROVAL_EUR = 7, 14, 7, 2, 500
#: Question types by keyword in the question, in this order.
QUESTION_TYPES = {
    "accepted": "accepted", "full_refund": "full refund", "transfer": "transfer", "catering": "catering", "approval": "approval", "next_step": "do next",
}
#: Keywords looked for in the lower-cased request, one feature for each group.
REQUEST_KEYWORDS = [
    ("ignore", "override", "disregard"), ("refund", "money back"), ("transfer",), ("cancel",), ("how much", "how many"), ("policy", "rule"),
    ("register", "sign up", "seat"), ("catering", "parking", "room", "lunch"), ("confirm",), ("exception", "manager", "just this once"), ("?",),
]
#: The options of a routing question.
ROUTES = ("retrieve", "calculate", "send_email", "ask_user", "escalate")


def days_before(state: Column) -> Column:
    return F.datediff(state["event"]["start_date"], state["today"])


def refund_amount(state: Column) -> Column:
    """What a cancellation refunds: all, half rounded down, or nothing, by the days that are left."""
    paid, d = state["registration"]["paid_eur"], days_before(state)
    return F.when(d >= FULL_REFUND_DAYS, paid).when(d >= HALF_REFUND_DAYS, F.floor(paid / 2)).otherwise(F.lit(0)).cast("long")


def _given(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def _true(flag: Column) -> Column:
    return F.coalesce(flag.cast("boolean"), F.lit(False))


def _confirmed(state: Column) -> Column:
    return F.coalesce(state["registration"]["status"] == "confirmed", F.lit(False))


def policy_label(rule: Column, state: Column, intent: Column) -> Column:
    """yes or no to the question that a rule answers; null for an unknown rule.

    P1: open and not full. P4: not remote. The others need a registration: P2 a full refund, P3 a transfer to a named
    person in time, P5 a refund small enough to need no approval."""
    d, event = days_before(state), state["event"]
    yes = lambda x: F.when(F.coalesce(x, F.lit(False)), "yes").otherwise("no")
    held = state["registration"].isNotNull() & _confirmed(state)
    return (
        F.when(rule == "P1", yes((d >= CLOSE_DAYS) & (event["registered"] < event["seats"])))
        .when(rule == "P4", yes(~event["remote"]))
        .when(rule == "P2", yes(held & (d >= FULL_REFUND_DAYS)))
        .when(rule == "P3", yes(held & _given(intent["new_name"]) & (d >= TRANSFER_DAYS)))
        .when(rule == "P5", yes(held & (refund_amount(state) <= APPROVAL_EUR)))
    )


def policy_ground(rule: Column, state: Column, intent: Column) -> Column:
    """Which rules decide policy_label, as a text such as ``P2, P8``."""
    missing, open_ = state["registration"].isNull(), _confirmed(state)
    full = days_before(state) >= FULL_REFUND_DAYS
    return (
        F.when(rule.isin("P1", "P4"), rule)
        .when(rule.isin("P2", "P3", "P5") & missing, "P8")
        .when(rule == "P3", "P3")
        .when((rule == "P2") & open_ & full, "P2, P8")
        .when((rule == "P5") & open_, "P2, P5")
        .when(rule.isin("P2", "P5"), "P2")
    )


def route_label(state: Column, intent: Column) -> Column:
    """Struct (route, step): the first step of the routing order that applies; nulls where none does."""
    event, act, d = state["event"], intent["action"], days_before(state)
    has = state["registration"].isNotNull()
    own = F.when(has, state["registration"]["email"]).otherwise(intent["gives_email"])
    mail, gives, named = _given(intent["email_to"]), _given(intent["gives_email"]), _given(intent["new_name"])
    confirmed = has & _confirmed(state)
    exceptional = (
        _true(intent["override"]) | (act == "policy_change") | _true(intent["exception"])
        | (mail & ~intent["email_to"].eqNullSafe(own))
        | ((act == "cancel") & confirmed & (refund_amount(state) > APPROVAL_EUR))
    )
    unclear = (
        (act.isin("cancel", "transfer", "catering", "refund_amount") & ~has & ~gives)
        | ((act == "transfer") & ~named)
        | ((act == "register") & ~gives)
    )
    done = (
        ((act == "register") & (d >= CLOSE_DAYS)) | ((act == "cancel") & confirmed)
        | ((act == "transfer") & confirmed & (d >= TRANSFER_DAYS)) | ((act == "catering") & has & ~event["remote"])
    )
    steps = [
        ("escalate", "R1", exceptional), ("ask_user", "R2", unclear), ("calculate", "R3", act.isin("refund_amount", "days_to_close", "days_to_event")),
        ("retrieve", "R4", act.isin("ask_policy", "ask_event")), ("send_email", "R5", done),
    ]
    first = F.lit(None).cast("struct<route:string,step:string>")
    for route, step, applies in reversed(steps):
        first = F.when(F.coalesce(applies, F.lit(False)), F.struct(F.lit(route).alias("route"), F.lit(step).alias("step"))).otherwise(first)
    return first


def question_type(question: Column, kinds: dict[str, str] = QUESTION_TYPES) -> Column:
    """The first type whose keyword the question has, or null."""
    found = F.lit(None).cast("string")
    for name, keyword in reversed(kinds.items()):
        found = F.when(F.contains(F.lower(question), F.lit(keyword)), name).otherwise(found)
    return found


def policy_question_type(question: Column) -> Column:
    """The type of a yes/no question about the policy, or null."""
    return question_type(question, {k: v for k, v in QUESTION_TYPES.items() if k != "next_step"})


def featurize(state: Column, question: Column) -> Column:
    """31 features as an array of doubles: five numbers, four flags, six question types, five products of the days
    with a type, and a flag for each group of keywords. The request and the records are read, nothing else."""
    event, reg = state["event"], state["registration"]
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    text = F.lower(F.coalesce(state["request"], F.lit("")))
    d30 = F.least(F.greatest(days_before(state) / 30, F.lit(-1.0)), F.lit(2.0))
    kind = question_type(F.coalesce(question, F.lit("")))
    types = {k: number(kind == k) for k in QUESTION_TYPES}
    numbers = [d30, (event["seats"] - event["registered"]) / event["seats"], event["registered"] / event["seats"], number(reg["paid_eur"] / 1000), event["fee_eur"] / 1000]
    flags = [number(event["remote"]), number(reg.isNull()), number(_confirmed(state)), number(F.contains(text, F.lit("@")))]
    products = [d30 * types[k] for k in list(QUESTION_TYPES)[:5]]
    words = []
    for group in REQUEST_KEYWORDS:
        any_of = F.lit(False)
        for word in group:
            any_of = any_of | F.contains(text, F.lit(word))
        words.append(number(any_of))
    return F.array(*(x.cast("double") for x in [*numbers, *flags, *types.values(), *products, *words]))


# -- typed answers


def chosen_answer(p_yes: Column, choice: Column, probabilities: Column) -> Column:
    """Struct (label, p) of a yes/no answer, yes from 0.5, or else of a choice."""
    return F.when(p_yes >= 0.5, F.struct(F.lit("yes").alias("label"), p_yes.alias("p"))).when(
        p_yes.isNotNull(), F.struct(F.lit("no").alias("label"), (1 - p_yes).alias("p"))
    ).when(choice.isNotNull(), F.struct(choice.alias("label"), F.element_at(probabilities, choice).alias("p")))


def choice_problem(choice: Column, probabilities: Column, options: list[str], slack: float = 0.03, near: float = 0.01) -> Column:
    """Why a choice can't be used: labels, sum or argmax; null if it can."""
    want = F.array(*map(F.lit, sorted(options)))
    total = F.aggregate(F.map_values(probabilities), F.lit(0.0), lambda a, x: a + x)
    return (
        F.when(choice.isNull() | probabilities.isNull(), "answer")
        .when(~choice.isin(options) | (F.array_sort(F.map_keys(probabilities)) != want), "labels")
        .when(F.abs(total - 1) > slack, "sum")
        .when(F.element_at(probabilities, choice) < F.array_max(F.map_values(probabilities)) - near, "argmax")
    )


def yes_problem(p: Column) -> Column:
    """Why a yes/no probability can't be used, or null."""
    return F.when(p.isNull(), "answer").when((p < 0) | (p > 1) | F.isnan(p), "range")


def with_fallback(primary: Column, fallback: Column, label: str, other: str) -> Column:
    """Struct (answer, backend): the fallback's answer where the primary has none."""
    return F.struct(F.coalesce(primary, fallback).alias("answer"), F.when(primary.isNotNull(), label).when(fallback.isNotNull(), other).alias("backend"))


def region(p: Column, escalate: Column | float, act: Column | float) -> Column:
    """act, ask or escalate; a null probability escalates."""
    return F.when(p >= act, "act").when(p >= escalate, "ask").otherwise("escalate")


def route_decision(choice: Column, probabilities: Column, options: tuple[str, ...] = ROUTES) -> Column:
    """Struct (route, p, problem): what can't be used escalates."""
    problem = choice_problem(choice, probabilities, list(options), near=2.0)
    return F.struct(
        F.when(problem.isNull(), choice).otherwise("escalate").alias("route"),
        F.when(problem.isNull(), F.element_at(probabilities, choice)).alias("p"),
        problem.alias("problem"),
    )


def guard_check(record_email: Column, to: Column, p: Column, escalate: float, act: float) -> Column:
    """Struct (p_allow, region, reason): mail to an address other than the record's escalates before p is looked at."""
    own = F.coalesce(record_email == to, F.lit(False))
    return F.struct(
        F.when(own, p).alias("p_allow"), F.when(own, region(p, escalate, act)).otherwise("escalate").alias("region"),
        F.when(~own, "P6").when(p.isNull(), "error").otherwise("p").alias("reason"),
    )


def after_router(route: Column, p: Column, threshold: float) -> Column:
    sure = F.coalesce(p >= threshold, F.lit(False)) & F.coalesce(route != "escalate", F.lit(False))
    return F.when(~sure, "escalate").when(route == "ask_user", "ask_user").otherwise("agent")


def after_guard(region_: Column) -> Column:
    return F.when(region_ == "act", "send").when(region_ == "ask", "human_review").otherwise("escalate")


def after_answer(has_tool_calls: Column) -> Column:
    return F.when(_true(has_tool_calls), "tools").otherwise("done")


def _budget_left(retries: Column, models: Column, deciders: Column, most: tuple[int, int, int]) -> Column:
    return (retries < most[0]) & (models + 1 <= most[1]) & (deciders + 1 <= most[2])


def after_verify(p: Column, retries: Column, models: Column, deciders: Column, threshold: float, most: tuple[int, int, int]) -> Column:
    """deliver, retrieve or abstain: one more round while the budgets (retries, model and decider calls) allow it."""
    return F.when(p >= threshold, "deliver").when(_budget_left(retries, models, deciders, most), "retrieve").otherwise("abstain")


def after_verify_in_regions(p: Column, retries: Column, models: Column, deciders: Column, escalate: float, act: float, most: tuple[int, int, int]) -> Column:
    """As after_verify, with a retry only between the two thresholds."""
    again = (p >= escalate) & _budget_left(retries, models, deciders, most)
    return F.when(p >= act, "deliver").when(again, "retrieve").otherwise("abstain")
