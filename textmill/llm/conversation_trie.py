"""The prefix trie of conversations: which beginnings are shared, by how many, and how much text is saved by storing them once.

A node is a distinct sequence of turns with which conversations begin. Each turn of a conversation gives an occurrence of
a node, keyed by 128 bits: the exclusive or of two 64-bit hashes over (place, role, text) of all turns up to it, which is
a running window. A node belongs to its smallest member, and whoever owns a node owns all below it on its own path, so a
conversation owns a suffix of its path. Sums over subtrees need no walk then: the tokens of all occurrences below a node are
the tokens behind it on its members' paths, and every node below it is counted once on its owner's path. One group-by of
the prefix sums the members' remaining tokens minus those that they own, and a flag for those whose last node is a leaf
that they own.

A window over the members of a node would gather a common beginning in one task: the smallest member is a minimum with
partial sums, joined to its conversation, of which each owned node is one. Windows run along the turns of a conversation,
and over pieces of it where one conversation is long: turns are dealt by range, and a window over the few pieces puts
them together.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.llm.common import join_groups, materialize

#: Conversations in a family, of which the first lends its beginning to the others; most turns that it lends, and one.
FAMILY, LENT = 5, 9
#: Ids of conversations that end in one node which are put together in a string.
IDS = 10_000


def lent(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % LENT).cast("long")


def _prefix(rows: DataFrame, xors: dict[str, str], sums: dict[str, str]) -> DataFrame:
    """rows (conv_id, piece, pos, ...) with running exclusive ors and sums along pos, over all pieces of a conversation in
    their order. The totals within a piece come from a window over it; what stands before a piece, from a window over the
    pieces."""
    totals = {k: F.bit_xor(c) for k, c in xors.items()} | {k: F.sum(c) for k, c in sums.items()}
    pieces = rows.groupBy("conv_id", "piece").agg(*(c.alias(f"_{k}") for k, c in totals.items()))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = {k: F.bit_xor(f"_{k}") for k in xors} | {k: F.sum(f"_{k}") for k in sums}
    pieces = pieces.select("conv_id", "piece", *(F.coalesce(c.over(before), F.lit(0)).alias(f"_{k}") for k, c in earlier.items()))
    at = Window.partitionBy("conv_id", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({k: c.over(at) for k, c in totals.items()}).join(pieces, ["conv_id", "piece"])
    both = {k: F.col(k).bitwiseXOR(F.col(f"_{k}")) for k in xors} | {k: F.col(k) + F.col(f"_{k}") for k in sums}
    return run.withColumns(both).drop(*(f"_{k}" for k in totals))


def ordered_turns(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, piece, pos, digest, tokens): the turns of every conversation in their order, pos from 1; tokens are the
    UTF-8 bytes of the text. A piece is a part of the range of turns, so a long conversation has several."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    # A digest stands for role and text from here on.
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(both, 256).alias("digest"), F.octet_length(text).cast("long").alias("tokens")
    )
    turns = materialize(turns.withColumn("_n", F.monotonically_increasing_id()), "turns")
    parts = parts or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("_n")]
    dealt = materialize(turns.repartitionByRange(parts, *order).withColumn("piece", F.spark_partition_id()), "dealt")
    at = Window.partitionBy("conv_id", "piece").orderBy(*order[1:])
    ranked = dealt.withColumn("pos", F.row_number().over(at)).drop("turn", "_n")
    pieces = dealt.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("conv_id", "piece", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = ranked.join(pieces, ["conv_id", "piece"])
    return materialize(placed.select("conv_id", "piece", (F.col("pos") + F.col("_before")).alias("pos"), "digest", "tokens"), "ordered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, rows): conversations (conv_id, len), and their turns (conv_id, piece, pos, digest, tokens), rebuilt.

    Each takes its first turns from the first of its family, as many as ``lent`` says or all there are, and goes on with its
    own behind as many."""
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("_own"))
    family = own.select("conv_id", "_own", lent(F.col("conv_id")).alias("_h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("_first"))
    first = own.select(F.col("conv_id").alias("_first"), F.col("_own").alias("_there"))
    convs = family.join(first, "_first", "left").withColumn("_head", F.least("_h", F.coalesce("_there", F.lit(0))))
    convs = materialize(convs.withColumn("len", F.col("_head") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))), "convs")
    heads = turns.filter((F.col("pos") < LENT) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "_first")
    heads = heads.join(convs.select("conv_id", "_first", "_head"), "_first").filter(F.col("pos") <= F.col("_head"))
    tails = turns.filter(F.col("pos") > lent(F.col("conv_id")))
    tails = join_groups(tails, convs.select("conv_id", "_h", "_head", "_own"), ["conv_id"], "_own", turns.count())
    tails = tails.select("conv_id", "piece", (F.col("pos") - F.col("_h") + F.col("_head")).alias("pos"), "digest", "tokens")
    heads = heads.select("conv_id", F.lit(-1).alias("piece"), "pos", "digest", "tokens")
    return convs.select("conv_id", "len"), heads.unionByName(tails)


def occurrences(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, len, depth, x, y, tokens, rest): the nodes on every conversation's path, the root included; (depth, x, y)
    names a node, tokens are those of its last turn, and rest those from it to the path's end."""
    hashed = rows.withColumns({"hash_x": F.xxhash64("pos", "digest"), "hash_y": F.xxhash64("digest", "pos", F.lit(1))})
    run = _prefix(hashed, {"x": "hash_x", "y": "hash_y"}, {"sum": "tokens"})
    run = run.withColumn("depth", F.col("pos").cast("long"))
    totals = rows.groupBy("conv_id").agg(F.sum("tokens").alias("_total"))
    ends = materialize(convs.join(totals, "conv_id", "left").withColumn("_total", F.coalesce("_total", F.lit(0))), "ends")
    below = join_groups(run, ends, ["conv_id"], "len", rows.count())
    below = below.select("conv_id", "len", "depth", "x", "y", "tokens", (F.col("_total") - F.col("sum") + F.col("tokens")).alias("rest"))
    zero = F.lit(0).cast("long")
    roots = ends.select("conv_id", "len", zero.alias("depth"), zero.alias("x"), zero.alias("y"), zero.alias("tokens"), F.col("_total").alias("rest"))
    return materialize(below.unionByName(roots), "occurrences")


NODE = ["depth", "x", "y"]


def _ends(marked: DataFrame, parts: int) -> DataFrame:
    """(depth, x, y, ends_sha256) of the nodes in which conversations end: SHA-256 of their ids in order, joined by commas.

    Ids are dealt by range, so that those of a common conversation are put together in many tasks; one task then passes the
    strings of a node on to its digest, in order and a string at a time."""
    ids = marked.filter(F.col("depth") == F.col("len")).select(*NODE, "conv_id")
    ids = ids.repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")

    def join(batches):
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            numbers, at = batch.column(3).to_pylist(), 0
            out = []
            while at < len(keys):
                stop = at
                while stop < len(keys) and stop - at < IDS and keys[stop] == keys[at]:
                    stop += 1
                out.append((*keys[at], numbers[at], ",".join(map(str, numbers[at:stop]))))
                at = stop
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:4]), pa.array([o[4] for o in out])], [*NODE, "first", "ids"])

    strings = ids.mapInArrow(join, "depth long, x long, y long, first long, ids string")
    strings = strings.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first")

    def digest(batches):
        now, state, out = None, None, []

        def sent():
            return pa.RecordBatch.from_arrays([*(pa.array([o[0][k] for o in out], pa.int64()) for k in range(3)), pa.array([o[1] for o in out], pa.string())], [*NODE, "ends_sha256"])

        for batch in batches:
            for *key, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if state:
                        out.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            if out:
                yield sent()
                out = []
        if state:
            out.append((now, state.hexdigest()))
            yield sent()

    return strings.mapInArrow(digest, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id (an integer), turn, role, text; other columns are ignored. Turns are ordered by turn, null first;
    those of equal turn by the digest of role and text, and repeated rows are as many turns. A null role or text is empty.
    Rows without conv_id belong to no conversation. A conversation c is rebuilt from the first turns of conversation c - c % 5
    (the remainder has c's sign) and its own later ones. The root is there if there is any conversation; an empty table gives
    an empty result. parts: partitions of the turns."""
    parts = parts or int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    convs, rows = rebuilt(ordered_turns(conversations, parts))
    seen = occurrences(convs, materialize(rows, "rebuilt"))
    nodes = seen.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.max("len").alias("_deepest"), F.max("tokens").alias("tokens"))
    # What each conversation owns: the path from depth _own on, its tokens, and whether it ends in a leaf of its own.
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("_own"), F.sum("tokens").alias("_owned"), F.max((F.col("depth") == F.col("_deepest")).cast("int")).alias("_leaf")
    )
    paths = convs.join(owners, "conv_id", "left").select("conv_id", F.col("len").alias("_len"), "_own", F.coalesce("_owned", F.lit(0)).alias("_owned"), F.coalesce("_leaf", F.lit(0)).alias("_leaf"))
    marked = materialize(join_groups(seen, materialize(paths, "paths"), ["conv_id"], "_len", seen.count()), "marked")
    owned = F.coalesce(F.col("depth") >= F.col("_own"), F.lit(False))
    child = F.coalesce((F.col("_own") <= F.col("depth") + 1) & (F.col("len") > F.col("depth")), F.lit(False))
    found = marked.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum(F.col("_leaf").cast("long")).alias("n_leaves"),
        F.sum(F.when(owned, 0).otherwise(F.col("rest") - F.col("_owned"))).alias("saved_tokens"),
    )
    found = materialize(found, "nodes")
    # The first node that a conversation owns hangs on one of another's; the others hang on its own.
    hangs = marked.filter(F.col("depth") == F.col("_own") - 1).select(*NODE, F.col("conv_id").alias("_child"))
    hangs = join_groups(hangs, found.select(*NODE, "conv_id", "n_children"), NODE, "n_children", convs.count())
    hangs = hangs.select(F.col("_child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_parent"))
    whole = found.join(hangs, ["conv_id", "depth"], "left").join(_ends(marked, parts), NODE, "left")
    return whole.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("_parent", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
