"""Queries on small tables with odd rows, against their SQL."""

import collections
import datetime

import duckdb
from pyspark.sql import SparkSession

from textmill.plans import catalogue as registry


def same_as_sql(spark: SparkSession, folder: str, name: str, **tables) -> list:
    """Writes the tables (rows, schema), runs the query over them and its SQL, and returns the query's rows."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    rows = [tuple(r[c] for c in names) for r in registry.QUERIES[name](spark, folder).collect()]
    assert collections.Counter(rows) == collections.Counter(found.fetchall())
    return rows


def test_number_in_text(spark, tmp_path):
    texts = ["2", "a 02.", "002", "2" * 45, "9" * 45 + " 2", "12 22", "", None, "no number"]
    rows = same_as_sql(spark, str(tmp_path), "number_in_text", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(i for i, two in rows if two) == [0, 1, 4]


def test_merge_ranges_without_ends(spark, tmp_path):
    day = lambda n: datetime.datetime(1995, 1, 1) + datetime.timedelta(n) if n is not None else None
    rows = [(1, day(0)), (1, day(10)), (1, day(10)), (1, day(200)), (1, None), (2, None), (None, day(5))]
    found = same_as_sql(spark, str(tmp_path), "merge_ranges", orders=(rows, "o_custkey long, o_orderdate timestamp"))
    assert sorted(n for cust, _, _, n in found if cust == 1) == [2, 3]


def test_each_pair_of_words_is_moved_once(spark, tmp_path):
    texts = ["a b a a c", "a", "", None, "B a b, c! a", "a a a", "x y"]
    table = (list(enumerate(texts)), "doc_id long, text string")
    rows = same_as_sql(spark, str(tmp_path / "pmi"), "pmi", documents=table)
    assert {(a, b): n for a, b, n, _ in rows}[("a", "a")] == 10
    same_as_sql(spark, str(tmp_path / "pairs"), "cooccurrence_pairs", documents=table)
    plan = registry.QUERIES["cooccurrence_pairs"](spark, str(tmp_path / "pairs"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
