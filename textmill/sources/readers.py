"""Readers of records, batches and fixed-width text, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_hash_verified(spark: SparkSession, paths: list[str], digests: dict[str, str]) -> DataFrame:
    """(name, path, content) of the files whose SHA-256 is the one that digests has for their name.

    paths are in order of preference: of several files of one name the first that matches is taken."""
    order = F.create_map(*(F.lit(x) for i, p in enumerate(paths) for x in (p.rstrip("/"), i)))
    wanted = F.create_map(*(F.lit(x) for pair in digests.items() for x in pair))
    files = spark.read.format("binaryFile").load(paths).select("path", "content", F.element_at(F.split("path", "/"), -1).alias("name"))
    good = files.filter(F.sha2("content", 256) == F.try_element_at(wanted, F.col("name")))
    place = F.array_min(F.transform(F.map_keys(order), lambda p: F.when(F.contains("path", p), F.element_at(order, p)).otherwise(len(paths))))
    return good.groupBy("name").agg(F.min_by(F.struct("path", "content"), F.struct(place, "path")).alias("f")).select("name", "f.path", "f.content")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The records, and (file, line) of lines that are no JSON of the schema."""
    bad = "_corrupt_record"
    full = T._parse_datatype_string(schema).add(bad, T.StringType())
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file")).filter(F.trim("value") != "")
    rows = lines.select("_file", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("_r"))
    names = [f"_r.{c}" for c in full.names if c != bad]
    broken = F.col(f"_r.{bad}")
    return rows.filter(broken.isNull()).select(*names), rows.filter(broken.isNotNull()).select(F.col("_file").alias("file"), broken.alias("line"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes, and values over several lines; gzip by file name."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST")


def read_batches(spark: SparkSession, path: str, header: list[str], entries: str, schema: str) -> DataFrame:
    """A row for each entry of each JSON batch: an entry's own value of a header field wins over the batch's.

    Adds file and index, the entry's place in its batch."""
    batches = spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    rows = batches.select("file", *header, F.posexplode(entries).alias("index", "_e"))
    own = rows.schema["_e"].dataType.names
    inherited = [F.coalesce(F.col(f"_e.{h}"), F.col(h)).alias(h) if h in own else F.col(h) for h in header]
    return rows.select("file", "index", *inherited, *(F.col(f"_e.{c}").alias(c) for c in own if c not in header))


def parse_fixed_width(lines: DataFrame, columns: dict[str, tuple[int, int, str]], text: str = "value") -> DataFrame:
    """Columns by 1-based first and last place and type; blank fields are null."""
    field = lambda a, b, kind: F.nullif(F.trim(F.substring(text, a, b - a + 1)), F.lit("")).try_cast(kind)
    return lines.select(*(field(a, b, kind).alias(name) for name, (a, b, kind) in columns.items()))


def read_vectors(spark: SparkSession, path: str, words: DataFrame) -> DataFrame:
    """(word, vector) of the wanted words from lines of a word and numbers between spaces."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("p"))
    rows = parts.select(F.col("p")[0].alias("word"), F.slice("p", F.lit(2), F.size("p")).cast("array<float>").alias("vector"))
    return rows.join(words.select("word").distinct(), "word", "left_semi")


#: Columns of an atom record.
ATOM = {
    "name": (13, 16, "string"), "alt": (17, 17, "string"), "res_name": (18, 20, "string"), "chain": (22, 22, "string"), "res_seq": (23, 26, "int"),
    "x": (31, 38, "double"), "y": (39, 46, "double"), "z": (47, 54, "double"), "b": (61, 66, "double"), "element": (77, 78, "string"),
}


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, and the fields of ATOM) of the atoms of each file's first model, of alternate places only the first.

    A file is one row until its lines are split, so their order is that of the file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", r"\r?\n").alias("_l"))
    last = F.array_position(F.transform("_l", lambda x: F.startswith(x, F.lit("ENDMDL"))), True)
    first = files.select("file", F.posexplode(F.when(last > 0, F.slice("_l", F.lit(1), last.cast("int"))).otherwise(F.col("_l"))).alias("line", "value"))
    rows = first.filter(F.startswith("value", F.lit("ATOM")))
    fields = parse_fixed_width(rows, ATOM).columns
    parts = {name: F.nullif(F.trim(F.substring("value", a, b - a + 1)), F.lit("")).try_cast(kind) for name, (a, b, kind) in ATOM.items()}
    parts["element"] = F.coalesce(parts["element"], F.trim(F.substring("value", 13, 2)))
    return rows.select("file", "line", *(parts[c].alias(c) for c in fields)).filter(F.col("alt").isNull() | (F.col("alt") == "A"))


def read_submissions(spark: SparkSession, path: str, schema: str, pattern: str = "capstone_*.json") -> DataFrame:
    """One JSON document a file, with the file's name."""
    return spark.read.schema(schema).option("pathGlobFilter", pattern).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))


def read_exports(spark: SparkSession, path: str, schema: str, required: list[str], pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """Records of the good files, and (file, why) of those refused: a required field that no record has, or a stub as provider."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_name").alias("file"), "value").filter(F.trim("value") != "")
    keys = lines.select("file", F.explode(F.json_object_keys("value")).alias("k")).groupBy("file").agg(F.collect_set("k").alias("keys"))
    missing = F.size(F.array_except(F.array(*map(F.lit, required)), "keys")) > 0
    rows = lines.select("file", F.from_json("value", schema).alias("r"))
    stubs = rows.groupBy("file").agg(F.bool_or(F.contains("r.provider", F.lit("stub"))).alias("stub"))
    why = keys.join(stubs, "file", "full").select("file", F.when(F.coalesce(missing, F.lit(True)), "fields").when(F.coalesce("stub", F.lit(False)), "stub").alias("why"))
    bad = why.filter("why IS NOT NULL")
    return rows.join(bad, "file", "left_anti").select("file", "r.*"), bad


def located_questions(items: DataFrame, pages: DataFrame, key: str, page_key: str) -> DataFrame:
    """items (key, page_key, quote) with start and stop: 0-based places of a quote that its page holds exactly once, else nulls."""
    joined = items.join(pages.select(page_key, F.col("text").alias("_t")), page_key, "left")
    once = (F.length("quote") > 0) & (F.instr("_t", F.col("quote")) > 0) & (F.expr("locate(quote, _t, instr(_t, quote) + 1)") == 0)
    at = F.when(once, F.instr("_t", F.col("quote")) - 1)
    return joined.select(*items.columns, at.alias("start"), (at + F.length("quote")).alias("stop"))


def recorded(records: DataFrame, key: str, value, field: str):
    """The field of the record with this key, or None."""
    row = records.filter(F.col(key) == value).select(field).first()
    return row[0] if row else None
