"""Intermediate tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and all is on one machine, a temporary one."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="textmill-"))


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to a folder of its own and read back."""
    path = f"{shared_folder(df.sparkSession)}/textmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored frame that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/textmill-" in path:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so once its driver has collected the garbage that refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
