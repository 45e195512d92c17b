"""Exact quantiles of groups of any size, by histograms that close in on the wanted places.

The built-in percentile holds the distinct values of a group in one buffer. Here a pass counts a group's values in a fixed
number of buckets between bounds that are known to hold the wanted one, and the next pass looks into the one bucket that
holds it; once few enough values are left they are put in order. Each pass is an aggregation with partial counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators.lineage import stored

BUCKETS = 1024
#: So many values of a group, between the bounds, may be put in order in one task.
FEW = 10_000
_LARGEST = 1.7976931348623157e308


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(by, p, quantile) for each group and probability: the value at p (n - 1), linear between neighbours, as ``percentile``
    gives it. Nulls and NaN are left out, groups without a value too; infinite values count as the largest finite ones. A
    null is a group of its own; without by there is one group."""
    v = F.least(F.greatest(F.col(value).cast("double"), F.lit(-_LARGEST)), F.lit(_LARGEST))
    rows = df.select(F.struct(*by, F.lit(0).alias("_one")).alias("_g"), v.alias("_v")).filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = F.col("p") * (F.col("_n") - 1)
    asked = stored(sizes.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in probabilities)))).withColumn("_at", at))
    ranks = asked.select("_g", "_n", "_lo", "_hi", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank")).distinct()
    # _before values of the group are smaller than _lo, and _n are between _lo and _hi, of which one is the wanted one.
    state = stored(ranks.withColumn("_before", F.lit(0).cast("long")))
    wide = (F.col("_n") > few) & (F.col("_lo") < F.col("_hi"))
    while not state.filter(wide).isEmpty():
        inside = rows.join(state.filter(wide), "_g").filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1))
        counts = inside.groupBy("_g", "_rank", "_before", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy("_g", "_rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("_before", F.col("_before") + F.coalesce(upto, F.lit(0)))
        found = counts.filter((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n"))).drop("_b")
        state = stored(state.filter(~wide).unionByName(found))
    same = state.filter("_lo = _hi").select("_g", "_rank", F.col("_lo").alias("_x"))
    open_ = state.filter("_lo < _hi").withColumnsRenamed({"_lo": "_from", "_hi": "_to"})
    left = rows.join(open_, "_g").filter((F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to")))
    lists = left.groupBy("_g", "_rank", "_before").agg(F.array_sort(F.collect_list("_v")).alias("_vs"))
    sorted_ = lists.select("_g", "_rank", F.element_at("_vs", (F.col("_rank") - F.col("_before") + 1).cast("int")).alias("_x"))
    known = stored(same.unionByName(sorted_))
    low = known.select("_g", F.col("_rank").alias("_low"), F.col("_x").alias("_a"))
    high = known.select("_g", F.col("_rank").alias("_high"), F.col("_x").alias("_z"))
    joined = asked.withColumns({"_low": F.floor("_at"), "_high": F.ceil("_at")}).join(low, ["_g", "_low"]).join(high, ["_g", "_high"])
    between = (F.col("_high") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.col("_low")) * F.col("_z")
    return joined.select(*(F.col("_g")[c].alias(c) for c in by), "p", F.when(F.col("_low") == F.col("_high"), F.col("_a")).otherwise(between).alias("quantile"))
