"""What the operators share: input tables, the shared folder, input that may lack columns or hold nulls."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.plans.registry import read_table

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts in fewer splits than there are cores is dealt over all of them."""
    return read_table(spark, sf_dir, name)


#: Rows of a batch that a Python worker gets at once.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Have this session send BATCH_ROWS rows to a Python worker at once: of long texts, the usual 10,000 rows take much of an
    executor's memory on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset and all is on one machine, a temporary one."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='textmill-')}"
        root = _OWN[context.applicationId]
    return f"{root.rstrip('/')}/textmill-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives the loss of any executor.

    The shuffle files of the job go when it has ended, as nothing can read them any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{tag}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/textmill-" in path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out() -> Column:
    """crc32(doc_id as text) mod 5 is 0: rows that no model learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(texts: list[str], limit: int = 4_000_000):
    """(start, stop) of runs of texts with about ``limit`` characters each; one longer text is a run of its own.

    Every text is whole; this only bounds what is held in memory at once."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


#: Log2 of the rows of a bitmap of keys: 64 bits each, 1,048,576 rows at most, whatever the number of keys.
BITMAP_ROWS = 20
#: Groups with more than this share of all rows are hot; there are fewer than its inverse.
HOT_SHARE = 0.001


def key_bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(_word, _bits): a bitmap of the long column key, small enough to broadcast. If it fills up, rows_that_may_hold
    keeps more rows than it need, never fewer."""
    word = F.shiftrightunsigned(key, 64 - BITMAP_ROWS).alias("_word")
    return keys.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{key}` & 63 AS int))")).alias("_bits"))


def sent_bitmap(keys: DataFrame, key: str):
    """The key_bitmap as a broadcast array of 64-bit words (8 MB) for in_bitmap in Python tasks."""
    found = key_bitmap(keys, key).toArrow()
    bitmap = np.zeros(1 << BITMAP_ROWS, np.uint64)
    bitmap[found["_word"].to_numpy()] = found["_bits"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of keys (uint64) may be in the bitmap."""
    bits = bitmap[(keys >> np.uint64(64 - BITMAP_ROWS)).astype(np.int64)]
    return (bits >> (keys & np.uint64(63)) & np.uint64(1)).astype(bool)


def _marked(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    word = F.shiftrightunsigned(key, 64 - BITMAP_ROWS)
    hit = F.col("_bits").bitwiseAND(F.expr(f"shiftleft(1L, cast(`{key}` & 63 AS int))")) != 0
    return rows.withColumn("_word", word).join(F.broadcast(bitmap), "_word", "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))


def rows_that_may_hold(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """The rows whose key may be in the bitmap; nothing is shuffled."""
    return _marked(rows, key, bitmap).filter("_hit").drop("_word", "_bits", "_hit")


def rows_without(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """The rows whose key is not in the bitmap."""
    return _marked(rows, key, bitmap).filter("NOT _hit").drop("_word", "_bits", "_hit")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with one row of groups for each value of keys, where size is the number of rows of a group.

    Groups with more than HOT_SHARE of the total rows are fewer than 1 / HOT_SHARE: they are broadcast, so no task
    gathers their rows. how: inner or left."""
    limit = HOT_SHARE * total
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(groups.filter(F.col(size) <= limit), keys, how)
    return rows.join(hot, keys).unionByName(rest)
