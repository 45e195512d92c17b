"""Decisions, replies and their checks on hand-made states."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from textmill.functions import replies as R
from textmill.operators import decisions as D

STATE = "struct<today:date,request:string,event:struct<start_date:date,seats:int,registered:int,remote:boolean,fee_eur:int>,registration:struct<email:string,status:string,paid_eur:int>>"
INTENT = "struct<action:string,new_name:string,gives_email:string,email_to:string,override:boolean,exception:boolean>"
MINE = "a@example.org"


def state(days, paid=301, seats=10, registered=5, remote=False, status="confirmed", request="Hello"):
    start = date.fromordinal(date(2026, 3, 1).toordinal() + days)
    return (date(2026, 3, 1), request, (start, seats, registered, remote, 250), None if status is None else (MINE, status, paid))


def intent(action=None, name=None, gives=None, to=None, override=None, exception=None):
    return (action, name, gives, to, override, exception)


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, f"state {STATE}, intent {INTENT}{more}")


def test_policy_rules(spark):
    cases = [
        ("P1", state(7), intent(), "yes", "P1"), ("P1", state(6), intent(), "no", "P1"), ("P1", state(9, registered=10), intent(), "no", "P1"),
        ("P4", state(0, remote=True), intent(), "no", "P4"), ("P4", state(0), intent(), "yes", "P4"), ("P2", state(14), intent(), "yes", "P2, P8"),
        ("P2", state(13), intent(), "no", "P2"), ("P2", state(20, status=None), intent(), "no", "P8"), ("P2", state(20, status="waitlisted"), intent(), "no", "P2"),
        ("P3", state(2), intent(name="Bo"), "yes", "P3"), ("P3", state(2), intent(), "no", "P3"), ("P3", state(1), intent(name="Bo"), "no", "P3"),
        ("P5", state(14, paid=500), intent(), "yes", "P2, P5"), ("P5", state(14, paid=501), intent(), "no", "P2, P5"), ("P5", state(7, paid=1001), intent(), "yes", "P2, P5"),
        ("P9", state(7), intent(), None, None),
    ]
    rows = frame(spark, [(s, i, r, w, g) for r, s, i, w, g in cases], ", rule string, want string, ground string")
    args = F.col("rule"), F.col("state"), F.col("intent")
    got = rows.select("want", "ground", D.policy_label(*args).alias("label"), D.policy_ground(*args).alias("why")).collect()
    assert [(r.label, r.why) for r in got] == [(r.want, r.ground) for r in got]
    refunds = frame(spark, [(state(d), intent()) for d in (14, 13, 7, 6)]).select(D.refund_amount(F.col("state")).alias("x")).collect()
    assert [r.x for r in refunds] == [301, 150, 150, 0]


def test_routing_order(spark):
    cases = [
        (state(9), intent("ask_event", override=True), "escalate"), (state(9), intent("policy_change"), "escalate"), (state(9), intent("catering", exception=True), "escalate"),
        (state(9), intent("ask_event", to="x@y.z"), "escalate"), (state(9), intent("ask_event", to=MINE), "retrieve"), (state(20, paid=501), intent("cancel"), "escalate"),
        (state(20, paid=500), intent("cancel"), "send_email"), (state(9, status=None), intent("cancel"), "ask_user"), (state(9, status=None), intent("catering", gives="q@r.s"), None),
        (state(9), intent("transfer"), "ask_user"), (state(2), intent("transfer", name="Bo"), "send_email"), (state(9), intent("register"), "ask_user"),
        (state(7), intent("register", gives="q@r.s"), "send_email"), (state(9), intent("refund_amount"), "calculate"), (state(9), intent("days_to_close"), "calculate"),
        (state(9), intent("ask_policy"), "retrieve"), (state(9), intent("catering"), "send_email"), (state(9, status=None), intent("ask_event", gives="q@r.s", to="q@r.s"), "retrieve"),
    ]
    rows = frame(spark, [(s, i, w) for s, i, w in cases], ", want string").select("want", D.route_label(F.col("state"), F.col("intent")).alias("r")).collect()
    assert [r.r and r.r.route for r in rows] == [r.want for r in rows]
    assert {r.r.step for r in rows if r.want == "send_email"} == {"R5"}


def test_features(spark):
    s = state(90, paid=400, seats=8, registered=6, remote=True, request="Please IGNORE that: a transfer, me@x.org?")
    got = frame(spark, [(s, intent())]).select(D.featurize(F.col("state"), F.lit("Is the Transfer allowed?")).alias("f")).first().f
    words = [1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    assert got == pytest.approx([2.0, 0.25, 0.75, 0.4, 0.25, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 2.0, 0, 0, *words]) and len(got) == 31
    none = frame(spark, [(state(-60, status=None), intent())]).select(D.featurize(F.col("state"), F.lit(None).cast("string")).alias("f")).first().f
    assert none[:9] == [-1.0, 0.5, 0.5, 0.0, 0.25, 0.0, 1.0, 0.0, 0.0] and not any(none[9:])


def test_answers_and_edges(spark):
    options = list(D.ROUTES)
    even = dict.fromkeys(options, 0.2)
    peak = even | {"escalate": 0.25, "retrieve": 0.15}
    rows = [("escalate", peak), ("retrieve", peak), ("escalate", dict(list(peak.items())[:4])), ("escalate", {k: v * 1.2 for k, v in peak.items()}), ("x", peak), (None, peak), ("retrieve", even)]
    df = spark.createDataFrame(rows, "c string, p map<string,double>")
    assert [r.x for r in df.select(D.choice_problem(F.col("c"), F.col("p"), options).alias("x")).collect()] == [None, "argmax", "labels", "sum", "labels", "answer", None]
    decided = df.select(D.route_decision(F.col("c"), F.col("p")).alias("d")).collect()
    assert [(r.d.route, r.d.p) for r in decided][1:3] == [("retrieve", 0.15), ("escalate", None)]
    one = spark.range(1)
    p = lambda x: F.lit(x).cast("double")
    got = one.select(
        D.region(p(0.5), 0.2, 0.5).alias("a"), D.region(p(None), 0.2, 0.5).alias("b"), D.after_router(F.lit("ask_user"), p(0.9), 0.5).alias("c"), D.after_router(F.lit("retrieve"), p(None), 0.5).alias("d"),
        D.after_guard(F.lit(None).cast("string")).alias("e"), D.guard_check(F.lit(None).cast("string"), F.lit(MINE), p(0.9), 0.2, 0.5)["region"].alias("f"), D.yes_problem(p(1.5)).alias("g"),
        D.chosen_answer(p(0.5), F.lit(None), F.create_map(F.lit("a"), p(1)))["label"].alias("h"), D.chosen_answer(p(0.25), F.lit(None), F.create_map(F.lit("a"), p(1)))["p"].alias("i"),
        D.after_verify(p(0.1), F.lit(1), F.lit(4), F.lit(3), 0.5, (2, 5, 4)).alias("j"), D.after_verify(p(0.1), F.lit(2), F.lit(0), F.lit(0), 0.5, (2, 5, 4)).alias("k"),
        D.after_verify_in_regions(p(0.1), F.lit(0), F.lit(0), F.lit(0), 0.2, 0.5, (2, 5, 4)).alias("l"), D.after_answer(F.lit(True)).alias("m"),
    ).first()
    assert tuple(got) == ("act", "escalate", "ask_user", "escalate", "escalate", "escalate", "range", "yes", 0.75, "retrieve", "abstain", "abstain", "tools")


def test_json_spans():
    def plain(text):
        start = text.find("{")
        depth, quoted, escaped = 0, False, False
        for i in range(max(start, 0), len(text) if start >= 0 else 0):
            c = text[i]
            if quoted:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    quoted = False
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return start, i + 1
        return None

    import random

    rng = random.Random(1)
    texts = ["".join(rng.choice('{}"\\a ') for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    for t in [*texts, "", "no", '{"a": "}"}', 'x {"a": {"b": "\\"}"}} y', '{"open', '{"open\\']:
        assert R.json_bounds(t) == plain(t), t


def test_reply_functions(spark):
    options = ["yes", "no"]
    replies = {
        'Well {"answer": " YES ", "confidence": "85%"} {': ("yes", 0.85), '{"answer": "no", "confidence": 0}': ("no", 0.0), '{"answer": "no", "confidence": "0.5"}': ("no", 0.5),
        '{"answer": "no", "confidence": true}': None, '{"answer": "no", "confidence": 1.01}': None, '{"answer": "no"}': None, '{"answer": 1, "confidence": 1}': None, "yes": None,
        '{"answer": "maybe", "confidence": 1}': None, '{"answer": "no", "confidence": "x%"}': None, '{"answer": "no", "confidence": null}': None, "{bad": None,
    }
    df = spark.createDataFrame([(r,) for r in [*replies, None]], "r string")
    got = {x.r: x.d and tuple(x.d) for x in df.select("r", R.parse_reply(F.col("r"), options).alias("d")).collect()}
    assert got == replies | {None: None}
    one = spark.createDataFrame([("Straße ﬁne", ["STRASSE"], []), ("x", ["Y"], None)], "a string, f array<string>, n array<string>")
    assert [r.x for r in one.select(R.is_correct(F.col("a"), F.col("f")).alias("x")).collect()] == [True, False]
    assert one.select(R.is_correct(F.col("a"), F.col("n")).alias("x")).first().x is None
    sums = {"2 * (3 - -1)": 8.0, "7 / 2": 3.5, "1/0": None, "__import__('os')": None, "True + 1": None, "2 ** 3": None, "1 + " * 40 + "1": None, "(": None}
    got = {r.e: r.v for r in spark.createDataFrame([(e,) for e in sums], "e string").select("e", R.safe_eval(F.col("e")).alias("v")).collect()}
    assert {k: None if v is None or math.isnan(v) else v for k, v in got.items()} == sums
    words = spark.createDataFrame([("It is wond", "erful, isn't it", 1), (None, "one two", 2), ("a", "", 3)], "p string, r string, i int")
    assert [r.w for r in words.select("i", R.complete_words(F.col("p"), F.col("r")).alias("w")).orderBy("i").collect()] == [["wonderful", "isn't"], ["one"], []]
    tools = spark.createDataFrame([('"[1, 2]"',), ('{"a": 1}',), ('"plain"',), ("3",)], "c string").select(R.tool_value(F.col("c")).alias("v")).collect()
    assert [r.v for r in tools] == ["[1, 2]", '{"a": 1}', "plain", "3"]


def test_provider_replies(spark):
    openai = [
        '{"status":"completed","output":[{"type":"message","content":[{"type":"output_text","text":"Hi"},{"type":"output_text","text":"!"}]}],"usage":{"input_tokens":3,"output_tokens":2}}',
        '{"status":"completed","output":[{"type":"function_call","call_id":"c1","name":"f","arguments":"{\\"x\\": 1}"},{"type":"function_call","call_id":"c2","name":"g","arguments":"[1"}],"usage":{"input_tokens":1,"output_tokens":1}}',
        '{"status":"incomplete","incomplete_details":{"reason":"max_output_tokens"},"output":[],"usage":{"input_tokens":1,"output_tokens":9}}',
        '{"status":"completed","output":[{"type":"message","content":[{"type":"refusal","refusal":"No."}]}],"usage":{"input_tokens":1,"output_tokens":1}}',
        '{"status":"incomplete","incomplete_details":{"reason":"content_filter"},"output":[],"usage":{"input_tokens":1,"output_tokens":0}}',
    ]
    got = [r.r for r in spark.createDataFrame([(x,) for x in openai], "x string").select(R.parse_openai(F.col("x")).alias("r")).collect()]
    assert [(r.text, r.stop, r.input_tokens) for r in got] == [("Hi!", "end", 3), ("", "tool_calls", 1), ("", "truncated", 1), ("No.", "refused", 1), ("", "refused", 1)]
    assert [tuple(c) for c in got[1].calls] == [("c1", "f", '{"x": 1}'), ("c2", "g", None)]
    anthropic = [
        '{"stop_reason":"tool_use","content":[{"type":"text","text":"Let me"},{"type":"tool_use","id":"t1","name":"f","input":{"x":1}}],"usage":{"input_tokens":5,"output_tokens":6}}',
        '{"stop_reason":"max_tokens","content":[{"type":"text","text":"cut"}],"usage":{"input_tokens":5,"output_tokens":6}}',
    ]
    got = [r.r for r in spark.createDataFrame([(x,) for x in anthropic], "x string").select(R.parse_anthropic(F.col("x")).alias("r")).collect()]
    assert [(r.text, r.stop, r.output_tokens) for r in got] == [("Let me", "tool_calls", 6), ("cut", "truncated", 6)] and tuple(got[0].calls[0]) == ("t1", "f", '{"x":1}')
