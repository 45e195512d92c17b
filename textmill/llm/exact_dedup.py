"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so, each chunk gets a 64-bit fingerprint, and the ordered list of
fingerprints is the text's recipe. A bitmap of the recipes that several texts share, of bounded size, is sent to all
tasks: other texts need no further work and don't move. Of the rest, each distinct chunk is sent once per task, and
every fingerprint is checked: chunks of equal fingerprint and different content get different numbers, so that
(fingerprint, number) is a verified identifier. Equal ordered lists of verified identifiers are equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textmill.llm.common import join_groups, key_bitmap, materialize, rows_that_may_hold, rows_without, text_or_empty

#: A chunk ends at the first line end or full stop after MIN_CHARS characters, and after MAX_CHARS at the latest.
MIN_CHARS, MAX_CHARS = 512, 8192


def chunks(text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """The text as an array of chunks; joined they are the text again. An empty text has none."""
    pattern = f"(?s).{{{min_chars - 1},{max_chars - 1}}}?[.\\n]|.{{1,{max_chars}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _fingerprint(chunk: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits) if bits < 64 else F.xxhash64(chunk)


def exact_groups(docs: DataFrame, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, text_sha256, keep_id, group_size, kept.

    docs: doc_id and text; other columns are ignored, whatever their names. A null text counts as empty; empty
    texts are equal to each other. Of equal texts the one with the largest doc_id stays. A row repeated with
    the same doc_id counts once more in group_size and gets the same keep_id; exactly one of the repeats is
    kept where their doc_id is the largest. A null doc_id sorts below every other. An empty table gives an
    empty result. bits: width of the fingerprints; fewer bits only mean more collisions to resolve.
    """
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    cut = chunks(F.col("text"), min_chars, max_chars)
    recipes = materialize(
        rows.select(
            "doc_id",
            F.sha2("text", 256).alias("text_sha256"),
            F.transform(cut, lambda c: _fingerprint(c, bits)).alias("recipe"),
        ).withColumn("recipe_key", F.xxhash64("recipe")),
        "recipes",
    )
    shared = recipes.groupBy("recipe_key").count().filter("count > 1").select("recipe_key")
    bitmap = materialize(key_bitmap(shared, "recipe_key"), "bitmap")
    # Only the content of texts with a shared recipe moves, each distinct chunk once per map task.
    contents = (
        rows_that_may_hold(_keyed(rows, cut, bits), "recipe_key", bitmap)
        .select(F.explode("chunk_list").alias("chunk"))
        .select(_fingerprint(F.col("chunk"), bits).alias("fp"), "chunk")
        .distinct()
    )
    # Fingerprints with more than one content: none, but for a collision.
    clashing = contents.groupBy("fp").count().filter("count > 1").select("fp")
    clashing = materialize(clashing, "clashing")
    if clashing.isEmpty():
        verified = recipes.withColumn("ids", F.transform("recipe", lambda f: F.struct(f.alias("fp"), F.lit(0).alias("no"))))
    else:
        verified = materialize(_resolved(rows, recipes, contents, clashing, cut, bits, bitmap), "verified")
    groups = verified.groupBy("ids").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = join_groups(verified, groups, ["ids"], "group_size", recipes.count())
    return found.select("doc_id", "text_sha256", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def _keyed(rows: DataFrame, cut: Column, bits: int) -> DataFrame:
    """rows with their chunk_list and the recipe_key of it."""
    cut_rows = rows.withColumn("chunk_list", cut)
    return cut_rows.withColumn("recipe_key", F.xxhash64(F.transform("chunk_list", lambda c: _fingerprint(c, bits))))


def _resolved(rows: DataFrame, recipes: DataFrame, contents: DataFrame, clashing: DataFrame, cut: Column, bits: int, bitmap: DataFrame) -> DataFrame:
    """Verified identifiers where fingerprints collide: the colliding contents are numbered, and the chunks of the
    texts that hold one are looked up by content."""
    numbered = contents.join(clashing, "fp", "left_semi").withColumn(
        "no", F.dense_rank().over(Window.partitionBy("fp").orderBy("chunk"))
    )
    numbered = materialize(numbered, "numbered")
    # Rows are told apart by digest: rows of one digest have equal texts and share their identifiers.
    positions = (
        rows_that_may_hold(_keyed(rows, cut, bits), "recipe_key", bitmap)
        .withColumn("text_sha256", F.sha2("text", 256))
        .select("text_sha256", "chunk_list")
        .distinct()
        .select("text_sha256", F.posexplode("chunk_list").alias("pos", "chunk"))
        .withColumn("fp", _fingerprint(F.col("chunk"), bits))
    )
    numbers = (
        positions.join(numbered, ["fp", "chunk"])
        .groupBy("text_sha256")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "no"))).alias("numbers"))
    )
    none = F.create_map().cast(T.MapType(T.IntegerType(), T.IntegerType()))
    return recipes.join(numbers, "text_sha256", "left").withColumn(
        "ids",
        F.transform(
            "recipe",
            lambda f, i: F.struct(f.alias("fp"), F.coalesce(F.element_at(F.coalesce("numbers", none), i), F.lit(0)).alias("no")),
        ),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the one with the largest doc_id.

    Rows repeated with equal doc_id and text are one document: one of them stays. A null text is equal to an empty one, and
    a null doc_id sorts below all others. An empty table gives an empty result. Only rows whose doc_id may be that of a
    dropped or repeated one are joined, told by a bitmap of bounded size; all others stay where they are."""
    found = materialize(exact_groups(docs), "groups")
    dropped = found.filter("not kept").select(F.col("doc_id").alias("_textmill_id"), F.col("text_sha256").alias("_textmill_sha")).distinct()
    repeats = found.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1")
    repeats = materialize(repeats.select(F.col("doc_id").alias("_textmill_id"), F.col("text_sha256").alias("_textmill_sha")), "repeats")
    same = F.col("doc_id").eqNullSafe(F.col("_textmill_id")) & (F.sha2(text_or_empty(), 256) == F.col("_textmill_sha"))
    keys = dropped.select(F.xxhash64("_textmill_id").alias("_textmill_key")).unionByName(repeats.select(F.xxhash64("_textmill_id").alias("_textmill_key")))
    bitmap = materialize(key_bitmap(keys, "_textmill_key"), "touched")
    keyed = docs.withColumn("_textmill_key", F.xxhash64("doc_id"))
    others = rows_without(keyed, "_textmill_key", bitmap).drop("_textmill_key")
    touched = rows_that_may_hold(keyed, "_textmill_key", bitmap).drop("_textmill_key")
    kept = touched.join(dropped, same, "left_anti")
    if not repeats.isEmpty():
        kept = kept.join(repeats, same, "left_anti").unionByName(kept.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return others.unionByName(kept)
