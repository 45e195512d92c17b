"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Time is counted in slots of one block. Block i (from 1) of a source of weight w is released at slot
floor((i - 1) / w) and due by slot ceil(i / w); of the released blocks the one that is due first runs. As the weights
sum to 1, no deadline is missed, and after every slot each source has had its weight's share to within less than one
block. Weights are whole quanta of a cycle, so the schedule repeats: it is worked out for one cycle of QUANTA slots,
whatever the number of rows, and the slot of any block follows by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.llm.common import materialize

#: Slots of a cycle: weights are multiples of 1 / QUANTA. Cycles are longer where there are more sources than fit.
QUANTA = 1000
#: Default weights are the sources' sizes to this power: small sources weigh more than their size, large ones less.
ALPHA = 0.7
BLOCK_ROWS = 8
#: Rows of a source are ranked in so many buckets, so that no task ranks a whole source.
BUCKETS = 1024
NO_SOURCE = ""


def target_weights(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, quanta: int = QUANTA) -> DataFrame:
    """(source, n_rows, quanta, cycle) of each source in docs: weights, or sizes to the power alpha, as whole quanta.

    Quanta are apportioned by largest remainder after one for each source; a source without a weight in ``weights``
    gets the least. One row per source: sources are counted by partial aggregation."""
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        sizes = sizes.withColumn("_w", F.pow(F.col("n_rows").cast("double"), F.lit(alpha)))
    else:
        given = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else F.create_map().cast("map<string,double>")
        sizes = sizes.withColumn("_w", F.coalesce(F.element_at(given, F.col("source")).cast("double"), F.lit(0.0)))
    every = Window.partitionBy()
    sizes = sizes.withColumn("cycle", F.greatest(F.lit(quanta), F.lit(2) * F.count(F.lit(1)).over(every)).cast("long"))
    spare = F.col("cycle") - F.count(F.lit(1)).over(every)
    total = F.sum("_w").over(every)
    sizes = sizes.withColumn("_share", F.when(total > 0, spare * F.col("_w") / total).otherwise(spare / F.count(F.lit(1)).over(every)))
    sizes = sizes.withColumn("_floor", F.floor("_share"))
    left = spare - F.sum("_floor").over(every)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_share") - F.col("_floor"), 9)), "source"))
    return sizes.withColumn("_left", left).withColumn("_rank", rank).select(
        "source", "n_rows", (1 + F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("quanta"), "cycle"
    )


def schedule(weights: DataFrame) -> DataFrame:
    """(source, nth, slot): the slot in the cycle, from 0, of each source's nth block, from 0.

    One row of arrays over the sources is folded over the slots: earliest deadline first among released blocks, ties
    to the source that comes first by name. Its size is that of the cycle and the number of sources."""
    sources = weights.agg(
        F.sort_array(F.collect_list(F.struct("source", "quanta"))).alias("s"), F.max("cycle").alias("cycle")
    ).filter("cycle IS NOT NULL")

    def due(entry: Column, done: Column) -> Column:  # ceil((done + 1) * cycle / quanta)
        return F.floor(((done + 1) * F.col("cycle") + entry["quanta"] - 1) / entry["quanta"])

    def released(entry: Column, done: Column) -> Column:
        return F.floor(done * F.col("cycle") / entry["quanta"])

    def step(state: Column, slot: Column) -> Column:
        done = state["done"]
        ready = F.zip_with(
            F.col("s"), done, lambda e, d: F.when(released(e, d) <= slot, due(e, d)).otherwise(F.lit(1 << 60))
        )
        pick = F.array_position(ready, F.array_min(ready)).cast("int")
        return F.struct(
            F.transform(done, lambda d, i: d + (i + 1 == pick).cast("long")).alias("done"),
            F.concat(state["picks"], F.array(pick)).alias("picks"),
        )

    start = F.struct(F.transform("s", lambda e: F.lit(0).cast("long")).alias("done"), F.expr("CAST(array() AS array<int>)").alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("cycle") - 1), start, step, lambda state: state["picks"])
    slots = sources.select("s", F.posexplode(picks).alias("slot", "pick")).select(F.expr("s[pick - 1].source").alias("source"), F.col("slot").cast("long").alias("slot"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return slots.withColumn("nth", nth.cast("long"))


def _cycle(weighted: DataFrame, block_rows: int) -> DataFrame:
    """The schedule with each source's n_rows, quanta and cycle, and with end: the first slot of all whose block does not exist."""
    blocks = F.ceil(F.col("n_rows") / block_rows).cast("long")
    missing = F.when(F.col("nth") == blocks % F.col("quanta"), F.floor(blocks / F.col("quanta")) * F.col("cycle") + F.col("slot"))
    return schedule(weighted).join(weighted, "source").withColumn("end", F.min(missing).over(Window.partitionBy()))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, quanta: int = QUANTA,
    block_rows: int = BLOCK_ROWS, buckets: int = BUCKETS,
) -> DataFrame:
    """docs with mix_slot, mix_place and in_mix: where the mix has each row.

    docs: doc_id, source and any other columns; columns named like these three are replaced. A null source is the source with the empty name. Rows
    of a source are taken in the order of buckets of an MD5 of doc_id and of the MD5 in each (repeats of a doc_id in any order), a block
    holds block_rows of them, and mix_place is a row's place in its block. In the order of (mix_slot, mix_place)
    every prefix up to the first missing block has each source's weight to within one block; these rows have in_mix.
    After that slot, sources that still have blocks keep the slots of their own weights. No row is left out or
    repeated. An empty table gives an empty result.
    """
    weighted = materialize(target_weights(docs, weights, alpha, quanta), "weights")
    cycle = _cycle(weighted, block_rows)
    by_source = materialize(
        cycle.groupBy(F.col("source").alias("_mix_source")).agg(
            F.max("quanta").alias("_mix_quanta"), F.max("cycle").alias("_mix_cycle"), F.max("end").alias("_mix_end"),
            F.transform(F.sort_array(F.collect_list(F.struct("nth", "slot"))), lambda x: x["slot"]).alias("_mix_slots"),
        ),
        "schedule",
    )

    names = [c for c in docs.columns if c not in ("mix_slot", "mix_place", "in_mix")]
    keyed = docs.select(
        F.struct(*(docs[c] for c in names)).alias("_mix_row"),
        F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("_mix_source"),
        F.col("doc_id").alias("_mix_id"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_mix_hash"),
    ).withColumn("_mix_bucket", F.conv(F.substring("_mix_hash", 1, 4), 16, 10).cast("int") % buckets)
    counts = keyed.groupBy("_mix_source", "_mix_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_mix_source", "_mix_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_mix_before"))
    rank = F.row_number().over(Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_hash", "_mix_id")) - 1
    ranked = keyed.withColumn("_mix_rank", rank).join(offsets, ["_mix_source", "_mix_bucket"])
    ranked = ranked.withColumn("_mix_rank", F.col("_mix_rank") + F.col("_mix_before")).join(by_source, "_mix_source")
    block = F.floor(F.col("_mix_rank") / block_rows)
    slot = F.floor(block / F.col("_mix_quanta")) * F.col("_mix_cycle") + F.element_at("_mix_slots", (block % F.col("_mix_quanta") + 1).cast("int"))
    placed = ranked.select("_mix_row", "_mix_end", slot.alias("mix_slot"), (F.col("_mix_rank") % block_rows).alias("mix_place"))
    return placed.select("_mix_row.*", "mix_slot", "mix_place", (F.col("mix_slot") < F.col("_mix_end")).alias("in_mix"))


def mixed_order(docs: DataFrame, parts: int | None = None, **options) -> DataFrame:
    """The rows of docs in the order of the mix: partition after partition, and sorted in each. All rows stay."""
    placed = mix(docs, **options)
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place")
    return ordered.drop("mix_slot", "mix_place", "in_mix")


def with_positions(ordered: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, quanta: int = QUANTA, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """ordered with mix_position, from 0 without gaps, and in_mix as in mix: what the order of the files says.

    ordered: a frame read from the Parquet files that mixed_order's rows were written to, with the options of that call.
    Splits are read in any order, so a row's place is taken from its file and its index there, and files are
    counted in the order of their part numbers. The rows in the mix are the first ones, as many as the blocks of
    all slots before the first missing block have.
    """
    part = F.regexp_extract("_mix_file", r"part-(\d+)", 1).cast("int")
    rows = ordered.select("*", F.col("_metadata.file_name").alias("_mix_file"), F.col("_metadata.row_index").alias("_mix_index"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(part, "_mix_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = rows.groupBy("_mix_file").agg(F.count(F.lit(1)).alias("_n")).select("_mix_file", before.alias("_mix_before"))
    end = F.col("end")
    slots = F.floor(end / F.col("cycle")) + (F.col("slot") < end % F.col("cycle")).cast("long")
    weighted = materialize(target_weights(ordered, weights, alpha, quanta), "weights")
    held = _cycle(weighted, block_rows).groupBy("source").agg(F.least(F.max("n_rows"), F.sum(slots) * block_rows).alias("_n"))
    stretch = held.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_mix_stretch"))
    placed = rows.join(F.broadcast(files), "_mix_file").crossJoin(F.broadcast(stretch))
    position = F.col("_mix_before") + F.col("_mix_index")
    return placed.select(*ordered.columns, position.alias("mix_position"), (position < F.col("_mix_stretch")).alias("in_mix"))
