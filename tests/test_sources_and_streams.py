import gzip
import hashlib
import json
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import functions as F

from textmill.functions import chunk
from textmill.sources import readers, sinks
from textmill.streaming import events as E
from textmill.streaming import threads


def test_hash_verified_scan_takes_the_first_match(spark, tmp_path):
    for folder, text in (("a", b"wrong"), ("b", b"right"), ("c", b"right")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.bin").write_bytes(text)
    paths = [str(tmp_path / f) for f in "abc"]
    row = readers.scan_hash_verified(spark, paths, {"x.bin": hashlib.sha256(b"right").hexdigest()}).collect()
    assert len(row) == 1 and row[0].path.endswith("/b/x.bin")


def test_batches_inherit_their_header(spark, tmp_path):
    batch = {"date": "2024-01-01", "mode": "full", "runs": [{"notebook": "n1"}, {"notebook": "n2", "mode": "quick"}]}
    (tmp_path / "r.json").write_text(json.dumps(batch, indent=1))
    schema = "date string, mode string, runs array<struct<notebook: string, mode: string>>"
    rows = readers.read_batches(spark, str(tmp_path / "r.json"), ["date", "mode"], "runs", schema).orderBy("index").collect()
    assert [(r.file, r["index"], r.mode, r.notebook) for r in rows] == [("r.json", 0, "full", "n1"), ("r.json", 1, "quick", "n2")]


def test_jsonl_csv_and_fixed_width(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\nno json\n')
    good, bad = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, b string")
    assert [tuple(r) for r in good.collect()] == [(1, "x")] and [r.line for r in bad.collect()] == ["no json"]
    (tmp_path / "x.csv").write_text('a,b\n1,"two\nlines ""q"""\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "x.csv"), "a int, b string").collect()] == [(1, 'two\nlines "q"')]
    lines = spark.createDataFrame([("ATOM   12 CA  ",), ("ATOM      ",)], "value string")
    got = readers.parse_fixed_width(lines, {"no": (5, 9, "int"), "name": (11, 12, "string")}).collect()
    assert [tuple(r) for r in got] == [(12, "CA"), (None, None)]
    (tmp_path / "v.txt").write_text("a 1 2\nb 3 4\n")
    words = spark.createDataFrame([("b",), ("b",)], "word string")
    assert [(r.word, r.vector) for r in readers.read_vectors(spark, str(tmp_path / "v.txt"), words).collect()] == [("b", [3.0, 4.0])]


def test_sinks_do_not_depend_on_row_order(spark, tmp_path):
    df = spark.createDataFrame([(3, None), (1, 'q"'), (2, "y")], "k int, a string")
    for i, frame in enumerate((df, df.orderBy(F.desc("k")).repartition(3))):
        sinks.write_jsonl(frame, str(tmp_path / f"j{i}"), "k")
        sinks.write_csv(frame, str(tmp_path / f"c{i}"), ["k", "a"], "k")
    read = lambda name: b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path, name).glob("part-*")))
    assert read("j0") == read("j1") == b'{"a":"q\\"","k":1}\n{"a":"y","k":2}\n{"a":null,"k":3}\n'
    assert read("c0") == read("c1")
    assert sinks.manifest(df).first() == sinks.manifest(df.repartition(2)).first() != sinks.manifest(df.filter("k > 1")).first()


def test_chunk_table_function(spark):
    chunk.register(spark)
    rows = spark.sql("SELECT no, start, stop, chunk FROM chunk('a b  c d e', 3, 1)").orderBy("no").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 6, "a b  c"), (1, 5, 10, "c d e")]


def test_streams_equal_batches(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = E.newest(E.with_event_time(stream, "60 days")).writeStream.format("memory").queryName("newest_test").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    want = {tuple(r) for r in E.newest(source).collect()}
    assert {tuple(r) for r in spark.table("newest_test").collect()} == want


def streamed(query, name):
    run = query.writeStream.format("memory").queryName(name).outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    return query.sparkSession.table(name).collect()


def test_thread_state_equals_the_batch_form(spark, tmp_path):
    threads.use_rocksdb(spark)
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("user_id < 12").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("event_type", F.when(F.col("event_id") % 3 == 0, "error").otherwise(F.col("event_type")))
    order = [r.ts for r in rows.select("ts").orderBy("ts").collect()]
    for k in range(3):  # files in the order of time
        part = rows.filter((F.col("ts") >= order[len(order) * k // 3]) & (F.col("ts") < order[len(order) * (k + 1) // 3] if k < 2 else F.lit(True)))
        part.coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        for f in (tmp_path / f"p{k}").glob("part-*"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{k}.parquet")
    read = lambda: E.with_event_time(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "1 day")
    want = sorted(tuple(r) for r in threads.thread_log_batch(rows, 2).collect())
    for name in ("log_a", "log_b"):  # a replay gives the same
        assert sorted(tuple(r) for r in streamed(threads.thread_log(read(), "4000 days", 2), name)) == want
    budget = streamed(E.retry_budget(read(), 2, "4000 days"), "budget_test")
    assert sorted((r.user_id, r.errors, r.exhausted) for r in budget) == sorted((u, e, x) for u, _, _, e, x, _ in want)


def test_idle_threads_are_closed_and_old_runs_go_stale(spark, tmp_path):
    threads.use_rocksdb(spark)
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    batches = [[(1, 1, "error", day(0)), (2, 1, "view", day(1)), (3, 2, "view", day(1))], [(4, 2, "error", day(20))], [(5, 1, "view", day(40)), (6, 2, "view", day(41))], [(7, 9, "view", day(80))], [(8, 9, "view", day(81))]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "event_id long, user_id long, event_type string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"p{k}").glob("part-*"):
            f.rename(tmp_path / "in" / f"{k}.parquet")
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    read = lambda: E.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "1 day")
    got = sorted((r.user_id, r.event_id, r.n_entries, r.errors, r.closed) for r in streamed(threads.thread_log(read(), "30 days", 1), "idle_test"))
    opened = [(1, 1, 1, 1, False), (1, 2, 2, 1, False), (1, 5, 1, 0, False), (2, 3, 1, 0, False), (2, 4, 2, 1, False), (2, 6, 3, 1, False), (9, 7, 1, 0, False), (9, 8, 2, 0, False)]
    # User 1 was idle from day 1 to 40, so it is closed once the watermark is behind day 31, and its third event begins anew or
    # goes on, as the batch that brings the event also moves the watermark.
    told = [r for r in got if not r[4]]
    assert [r for r in told if r[0] != 1] == [r for r in opened if r[0] != 1] and told[:2] == opened[:2] and told[2][1] == 5
    closed = {(r[0], r[1]): r[2] for r in got if r[4]}
    assert closed[2, 6] == 3 and (1, 5) in closed and not any(u == 9 for u, _ in closed)
    runs = read().select(F.concat(F.lit("nb"), F.col("user_id")).alias("name"), "ts", F.col("event_type").alias("status"))
    fresh = streamed(threads.run_freshness(runs, "30 days"), "fresh_test")
    stale = {(r.name, r.ms) for r in fresh if r.stale}
    ms = lambda d: int(day(d).replace(tzinfo=timezone.utc).timestamp() * 1000)
    assert {("nb1", ms(40)), ("nb2", ms(41))} <= stale and not any(n == "nb9" for n, _ in stale)
    assert {(r.name, r.ms) for r in fresh if not r.stale} >= {("nb1", ms(1)), ("nb1", ms(40)), ("nb2", ms(20)), ("nb2", ms(41)), ("nb9", ms(81))}


def test_windows_and_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00", 7, "click", 1.0), (2, "2024-01-01 00:20:00", 7, "click", 2.0), (3, "2024-01-01 02:00:00", 7, "view", 4.0), (1, "2024-01-01 00:00:00", 7, "click", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    once = E.idempotent(df, ["event_id"])
    assert sorted((r.event_type, r.n, r.value) for r in E.usage(once).collect()) == [("click", 2, 3.0), ("view", 1, 4.0)]
    assert sorted(r.n for r in E.sessions(once).collect()) == [1, 2]
