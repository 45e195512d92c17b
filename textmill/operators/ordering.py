"""One order over all rows without a task that sees them all: rows are dealt by range, each part is ordered by itself,
and what stands before a part comes from the totals of the earlier ones.

A window without a partition puts every row into one task. Here a part's rows go to a task of their own; the driver holds
one row of totals for each part, whatever the number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators.lineage import stored


def running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, mins: dict[str, Column] | None = None, before: bool = False, parts: int | None = None) -> DataFrame:
    """df with a running sum, or minimum, of a column under each name, along an order that tells all rows apart.

    A total includes the row itself, or with before only those in front of it: then the first row has 0, or a null minimum.
    parts: ranges that the rows are dealt over, by default as many as there are shuffle partitions."""
    sums, mins = sums or {}, mins or {}
    values = {f"_v_{name}": c for name, c in (sums | mins).items()}
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.withColumns(values).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    total = {n: F.sum(f"_v_{n}") for n in sums} | {n: F.min(f"_v_{n}") for n in mins}
    found = dealt.groupBy("_part").agg(*(c.alias(n) for n, c in total.items()))
    kind = found.schema
    offsets, sum_so_far, least = [], dict.fromkeys(sums), dict.fromkeys(mins)
    for row in sorted(found.collect(), key=lambda r: r["_part"]):
        offsets.append((row["_part"], *sum_so_far.values(), *least.values()))
        for n in sums:
            sum_so_far[n] = row[n] if sum_so_far[n] is None else sum_so_far[n] if row[n] is None else sum_so_far[n] + row[n]
        for n in mins:
            known = [x for x in (least[n], row[n]) if x is not None]
            least[n] = min(known) if known else None
    schema = "_part int" + "".join(f", _o_{n} {kind[n].dataType.simpleString()}" for n in [*sums, *mins])
    earlier = F.broadcast(df.sparkSession.createDataFrame(offsets, schema))
    at = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = dealt.withColumns({f"_w_{n}": c.over(at) for n, c in total.items()}) if total else dealt
    # Plain sums of the values' own type: what is added is the part's offset, 0 for the first.
    out = out.join(earlier, "_part")
    both = {n: F.coalesce(f"_o_{n}", F.lit(0)) + F.coalesce(f"_w_{n}", F.lit(0)) for n in sums}
    both |= {n: F.least(f"_o_{n}", f"_w_{n}") for n in mins}
    return out.withColumns(both).select(*df.columns, *both)


def place(df: DataFrame, order: list[Column], name: str, first: int = 1, parts: int | None = None) -> DataFrame:
    """df with each row's place in an order that tells all rows apart."""
    ranked = running(df, order, {name: F.lit(1).cast("long")}, before=True, parts=parts)
    return ranked.withColumn(name, F.col(name) + first)
