"""Generators of synthetic records: each row depends on the seed and its number alone, so they run on any number of tasks."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators.ordering import running

#: Kinds of customers: share, invoices a month, lines, quantities, chance to leave, mean days until then.
KINDS = {
    "regular": (0.35, 1.2, (2, 8), (1, 6), 0.2, 400), "big": (0.10, 2.5, (5, 15), (4, 24), 0.1, 600), "rare": (0.30, 0.3, (1, 4), (1, 3), 0.3, 300),
    "new": (0.10, 1.0, (1, 5), (1, 4), 0.1, 200), "lapsed": (0.15, 0.9, (1, 6), (1, 5), 1.0, 120),
}
DAYS, FIRST = 730, date(2024, 1, 1)
TOPICS = ("Language", "Language models", "Text mining", "Retrieval", "Speech")
CITIES = ("Bern", "Lyon", "Porto", "Graz", "Ghent")
REMOTE = {True: ("You can also join online.", "A video link is provided."), False: ("On site only.", "There is no stream.")}
FORMATS = ("%Y-%m-%d", "%d %B %Y", "%B %d, %Y", "%d.%m.%Y", "%a %d %b %Y", "%Y/%m/%d")


def _rng(seed: int, kind: int, number: int) -> np.random.Generator:
    return np.random.default_rng([seed, kind, number])


def _rows(spark: SparkSession, n: int, make, schema: str) -> DataFrame:
    """make(i) -> rows, for i from 0 to n - 1."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([r for i in frame["id"] for r in make(int(i))], columns=names)

    return spark.range(n).mapInPandas(run, schema)


def purchases(spark: SparkSession, customers: int, products: int = 200, seed: int = 1) -> DataFrame:
    """(invoice_id, invoice_date, customer_id, country, stock_code, quantity, unit_price): Poisson arrivals by kind of customer;
    invoices are numbered by date, customer and place."""
    prices = np.round(np.clip(_rng(seed, 0, 0).lognormal(1.1, 0.8, products), 0.29, 60), 2)

    def make(i):
        rng = _rng(seed, 1, i)
        kind = rng.choice(list(KINDS), p=[k[0] for k in KINDS.values()])
        _, rate, lines, qty, churn, life = KINDS[kind]
        begin = DAYS - 1 - rng.integers(90) if kind == "new" else rng.integers(DAYS // 2 if kind == "lapsed" else DAYS - 30)
        last = min(DAYS - 1, begin + int(rng.exponential(life))) if rng.random() < churn else DAYS - 1
        country = str(rng.choice(["CH", "FR", "DE", "PT"], p=[0.6, 0.2, 0.15, 0.05]))
        favourites, daily = rng.choice(products, min(25, products), replace=False), rate / 30 * rng.lognormal(0, 0.5)
        day, no = float(begin), 0
        while day <= last:
            for _ in range(rng.integers(lines[0], lines[1] + 1)):
                p = int(rng.choice(favourites))
                yield FIRST + timedelta(days=int(day)), i, no, country, f"P{p + 1:04d}", int(rng.integers(qty[0], qty[1] + 1)), float(prices[p])
            day, no = day + rng.exponential(1 / daily), no + 1

    schema = "invoice_date date, customer_id long, no int, country string, stock_code string, quantity int, unit_price double"
    rows = _rows(spark, customers, make, schema)
    # Numbers follow the days: each day's invoices are ranked by themselves and begin after all earlier days'.
    invoices = rows.select("invoice_date", "customer_id", "no").distinct()
    days = invoices.groupBy("invoice_date").agg(F.count(F.lit(1)).alias("_c"))
    days = running(days, [F.col("invoice_date")], {"_before": F.col("_c")}, before=True)
    numbered = invoices.withColumn("_r", F.row_number().over(Window.partitionBy("invoice_date").orderBy("customer_id", "no")))
    numbered = numbered.join(days.select("invoice_date", "_before"), "invoice_date")
    ids = numbered.select("invoice_date", "customer_id", "no", (F.col("_before") + F.col("_r")).alias("invoice_id"))
    return rows.join(ids, ["invoice_date", "customer_id", "no"]).select("invoice_id", "invoice_date", "customer_id", "country", "stock_code", "quantity", "unit_price")


def announcements(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(id, text, topic, city, event_date, seats, remote): announcements of events with the record to extract."""

    def make(i):
        rng = _rng(seed, 2, i)
        topic, city, remote = str(rng.choice(TOPICS)), str(rng.choice(CITIES)), bool(rng.random() < 0.5)
        day, seats = date(2026, 11, 1) + timedelta(days=int(rng.integers(420))), int(rng.integers(12, 200))
        shown = topic if rng.random() < 0.5 else topic.lower()
        told = day.strftime(str(rng.choice(FORMATS[:3])))
        parts = [
            str(rng.choice([f"The {shown} workshop takes place in {city}.", f"{city} hosts the {shown} workshop."])), str(rng.choice([f"It runs on {told}.", f"Date: {told}."])),
            str(rng.choice([f"There are {seats} seats.", f"Capacity: {seats} attendees."])), str(rng.choice(REMOTE[remote])), f"Meet in room {rng.integers(100, 499)}.",
        ]
        yield i, " ".join(parts[k] for k in rng.permutation(len(parts))), topic, city, day.isoformat(), seats, remote

    return _rows(spark, n, make, "id long, text string, topic string, city string, event_date string, seats int, remote boolean")


def date_examples(spark: SparkSession, n: int, seed: int = 1, exclude: DataFrame | None = None) -> DataFrame:
    """(k, src, tgt, spans): sources with one to four dates in several forms, their ISO forms, and where each stands; distinct
    sources, none of those in exclude (src)."""

    def make(i):
        rng = _rng(seed, 3, i)
        k = 1 + i % 4
        days = [date.fromordinal(int(rng.integers(date(1950, 1, 1).toordinal(), date(2050, 1, 1).toordinal()))) for _ in range(k)]
        texts = [d.strftime(str(rng.choice(FORMATS))) for d in days]
        joint = "; " if rng.random() < 0.5 else ", "
        starts = np.cumsum([0, *(len(t) + len(joint) for t in texts)])
        spans = [[int(a), int(a) + len(t)] for a, t in zip(starts, texts, strict=False)]
        yield k, joint.join(texts), " ".join(d.isoformat() for d in days), spans

    rows = _rows(spark, n, make, "k int, src string, tgt string, spans array<array<int>>").dropDuplicates(["src"])
    return rows if exclude is None else rows.join(exclude.select("src").distinct(), "src", "left_anti").select("k", "src", "tgt", "spans")


def instructions(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(id, instruction, context, response, category) rows of made-up tasks."""

    def make(i):
        rng = _rng(seed, 4, i)
        a, b = (int(x) for x in rng.integers(2, 99, 2))
        category = ("sum", "closed_qa", "list")[i % 3]
        city = str(rng.choice(CITIES))
        task = {"sum": (f"What is {a} plus {b}?", "", f"{a + b}."), "closed_qa": ("Where does it take place?", f"The course is held in {city}.", f"In {city}."), "list": (f"Name {2 + i % 3} cities.", "", ", ".join(CITIES[: 2 + i % 3]) + ".")}
        yield i, *task[category], category

    return _rows(spark, n, make, "id long, instruction string, context string, response string, category string")
