"""Sinks whose content depends on the rows alone."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_jsonl(df: DataFrame, path: str, key: str, files: int = 1, compression: str = "gzip") -> None:
    """JSON lines with sorted field names, in the order of key: range by range in numbered files; compression may be none."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")
    df.repartitionByRange(files, key).sortWithinPartitions(key).select(line).write.text(path, compression=compression)


def write_csv(df: DataFrame, path: str, columns: list[str], key: str, files: int = 1) -> None:
    """gzip CSV of the columns in order, with a header, in the order of key."""
    df.repartitionByRange(files, key).sortWithinPartitions(key).select(columns).write.csv(path, header=True, compression="gzip", escape='"', lineSep="\n")


def manifest(df: DataFrame) -> DataFrame:
    """(rows, sha256): a digest of all rows that does not depend on their order.

    Row digests are added up, so it takes one partial aggregation."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(",", *parts), 256).alias("sha256"))


def card(metrics: DataFrame, groups: dict[str, list[str]], places: int = 6) -> Column:
    """One row of metrics as a nested JSON text: a group of rounded numbers for each name, with sorted keys."""
    numbers = {f.name for f in metrics.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))}
    value = lambda c: F.round(F.col(c), places).alias(c) if c in numbers else F.col(c)
    return F.to_json(F.struct(*(F.struct(*(value(c) for c in sorted(cs))).alias(g) for g, cs in sorted(groups.items()))), {"ignoreNullFields": "false"})


def document(head: DataFrame, parts: dict[str, tuple[DataFrame, str]], most: int = 100_000) -> str:
    """One JSON document: the fields of head, one row, and for each part the rows of a frame in the order of a column.

    For reports: a part of more than ``most`` rows is refused rather than cut."""
    whole = head.first().asDict(recursive=True)
    for name, (rows, order) in parts.items():
        found = rows.orderBy(order).limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{name} has more than {most} rows: write it as a table")
        whole[name] = [r.asDict(recursive=True) for r in found]
    return json.dumps(whole, sort_keys=True, default=str, ensure_ascii=False)


def markdown_table(rows: DataFrame, order: str, most: int = 1000) -> str:
    """An aligned Markdown table of a short frame; one of more than ``most`` rows is refused rather than cut."""
    names = rows.columns
    found = rows.orderBy(order).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"the table has more than {most} rows: write it as files")
    cells = [names, *([("" if v is None else str(v)) for v in r] for r in found)]
    width = [max(3, *(len(r[i]) for r in cells)) for i in range(len(names))]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)) + " |"
    return "\n".join([line(cells[0]), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, cells[1:])])


def canonical(value: dict) -> tuple[str, str]:
    """Canonical JSON of a manifest (sorted keys, no spaces) and its SHA-256."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return text, hashlib.sha256(text.encode()).hexdigest()
