"""URL filters by a temporal list join.

A filter list is a log of dated entries: a host rule is blocked, allowed, or removed on a day. Each rule's entries become
validity intervals, and an as-of join finds for every capture the entry that was in force for its host, or for
a parent domain of it, when it was fetched. Of several rules in force the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.llm.common import join_groups, key_bitmap, materialize, rows_that_may_hold

ACTIONS = ("block", "allow", "remove")


#: Scheme, user (up to the last @ before the path) and host; a backslash counts as a slash, as it does in browsers.
HOST = r"^[a-z][a-z0-9+.-]*:[/\\]{2}(?:[^/\\?#]*@)?(\[[^\]/\\?#]*\]|[^/\\?#:]*)"
#: Hosts that are an address have no parent domain.
ADDRESS = r"^(\[.*|[0-9]+([.][0-9]+){3})$"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and trailing dot, percent signs decoded; null where there
    is none. An IPv6 address keeps its brackets."""
    rest = F.regexp_extract(F.lower(F.trim(url)), HOST, 1)
    rest = F.when(F.contains(rest, F.lit("%")), F.lower(F.coalesce(F.try_url_decode(rest), rest))).otherwise(rest)
    host = F.regexp_replace(rest, r"\.+$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(rule, action, since, until) from entries (rule, action, listed_at): from an entry to the rule's next one.

    Of entries of one rule at the same time ``allow`` comes after ``block`` and ``remove`` last. Entries with a null, or
    with another action, are left out; repeated entries do no harm. until is null while an entry is the rule's last."""
    order = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    rows = entries.select(F.lower("rule").alias("rule"), "action", "listed_at").dropna().filter(order > 0).distinct()
    last = rows.groupBy("rule", "listed_at").agg(F.max_by("action", order).alias("action"))
    until = F.lead("listed_at").over(Window.partitionBy("rule").orderBy("listed_at"))
    return last.select("rule", "action", F.col("listed_at").alias("since"), until.alias("until")).filter("action <> 'remove'")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures with host, verdict (block, allow or none), rule and rule_since.

    captures: url, fetched_at and any other columns; columns named like the new ones are replaced. Hosts and times are
    evaluated once each, however many captures share them, and the result is joined back. A null or malformed url has no
    host, a null fetched_at no time: the verdict is none. An empty table, or list, is no special case."""
    new = ["host", "verdict", "rule", "rule_since"]
    names = [c for c in captures.columns if c not in new]
    rows = captures.select(
        F.struct(*(captures[c] for c in names)).alias("_row"), host_of(F.col("url").cast("string")).alias("_host"), F.col("fetched_at").alias("_at")
    )
    # A large list may not be broadcast, and suffixes such as com are asked for by most hosts: those that no rule has go
    # before anything is joined.
    listed = materialize(intervals(entries), "intervals").withColumn("_key", F.xxhash64("rule"))
    labels = F.split("_host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixes = F.when(F.rlike("_host", F.lit(ADDRESS)), F.array("_host")).otherwise(parents)
    times = materialize(rows.select("_host", "_at").dropna().groupBy("_host", "_at").agg(F.count(F.lit(1)).alias("_n")), "times")
    asked = times.withColumn("rule", F.explode(suffixes)).withColumn("_key", F.xxhash64("rule"))
    asked = rows_that_may_hold(asked, "_key", materialize(key_bitmap(listed, "_key"), "rules"))
    uses = asked.groupBy("rule").agg(F.count(F.lit(1)).alias("_uses"))
    sizes = times.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
    rules = listed.join(uses, "rule").drop("_key")
    active = join_groups(asked.drop("_key"), rules, ["rule"], "_uses", sizes["n"])
    active = active.filter((F.col("since") <= F.col("_at")) & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    best = active.groupBy("_host", "_at").agg(F.max_by(F.struct("rule", "action", "since"), F.length("rule")).alias("_b"), F.max("_n").alias("_n"))
    joined = join_groups(rows, best, ["_host", "_at"], "_n", sizes["rows"], "left")
    return joined.select(
        "_row.*", F.col("_host").alias("host"), F.coalesce("_b.action", F.lit("none")).alias("verdict"),
        F.col("_b.rule").alias("rule"), F.col("_b.since").alias("rule_since"),
    )
