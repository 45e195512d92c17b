"""Queries by name, with the SQL that each is checked against.

A module of ``textmill.plans`` registers its queries with ``@query(name, sql)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Tables of long texts, of which one row group may be minutes of work.
TEXTS = ("documents", "pages", "conversations")


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one of texts with fewer splits than there are cores, as a single row group gives, is dealt over all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if table in TEXTS and rows.rdd.getNumPartitions() < cores else rows


def query(name: str, sql: str | None = None):
    """Register ``fn(t) -> DataFrame``; ``t("documents")`` reads a table."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: read_table(spark, sf_dir, table))

        run.__doc__, run.__name__ = fn.__doc__, name
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add
