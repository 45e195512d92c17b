"""Product codes of vectors: k-means codebooks for each part of the vector, fitted by a tree of integer sums.

Vectors become blocks of whole numbers, one row of the blocks for each dimension, written to the shared folder. An RDD
over these blocks is aggregated by treeAggregate: a task takes the distances of a block's parts to all codebook entries
dimension by dimension, and adds the parts to int64 tensors of sums and counts with np.add.at. The tensors, of fixed
size whatever the number of vectors, merge through a tree of reductions, and all of it is exact in whole numbers, so the
order of merging does not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import join_groups, materialize

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Whole numbers for each unit of a component.
SCALE = 256
#: Components must stay below this, so that errors and sums are exact in 64 bits.
MOST = 1 << 17
#: Vectors in a block.
BLOCK = 4096


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q): the vectors with finite components only, in whole numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", bad))
    whole = F.transform("_v", lambda x: F.when(F.abs(x) < MOST, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit(f"a component is {MOST} or more"))))
    return rows.select("vec_id", "label", whole.cast("array<int>").alias("q"))


def first_entries(rows: DataFrame, entries: int, parts: int) -> np.ndarray:
    """The codebooks at the start, (part, entry, position): the parts of the vectors with the smallest ids. Nulls come
    last, and equal ids by their vectors."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q", "label").limit(entries).select("q").collect()
    width = len(first[0].q) if first else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    kept = [r.q for r in first if len(r.q) == width]
    return np.array(kept, np.int64).reshape(len(kept), parts, width // parts).transpose(1, 0, 2).copy() if kept else np.zeros((parts, 0, 0), np.int64)


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """(vec_ids, labels, q) of up to BLOCK vectors; q holds int32 numbers, a row of the block for each dimension."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                numbers = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                one = lambda column: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), column)  # noqa: B023, E731
                data = np.ascontiguousarray(numbers.T, np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([one(part.column(0)), one(part.column(1)), pa.array([data], pa.binary())], ["vec_ids", "labels", "q"])

    same = rows.filter(F.size("q") == width).select("vec_id", "label", "q")
    return materialize(same.mapInArrow(run, f"vec_ids array<{kind['vec_id']}>, labels array<{kind['label']}>, q binary"), "blocks")


def nearest(q: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each vector's part and its squared distance; ties go to the lower index.

    q: (position, vector) numbers of a part; codebook: (entry, position)."""
    distance = np.zeros((len(codebook), q.shape[1]), np.int64)
    for position in range(len(q)):
        step = q[position][None, :] - codebook[:, position][:, None]
        distance += step * step
    found = distance.argmin(0)
    return found, distance[found, np.arange(q.shape[1])]


def _refined(table: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry is the floored mean of its parts; unused entries stay."""
    parts, entries, positions = codebooks.shape
    shared = table.sparkSession.sparkContext.broadcast(codebooks)

    def add(sums: np.ndarray, row) -> np.ndarray:
        q = np.frombuffer(row.q, np.int32).reshape(parts, positions, -1).astype(np.int64)
        for part in range(parts):
            at, _ = nearest(q[part], shared.value[part])
            for position in range(positions):
                np.add.at(sums[part, :, position], at, q[part, position])
            np.add.at(sums[part, :, positions], at, 1)
        return sums

    # The last position holds the counts.
    zero = np.zeros((parts, entries, positions + 1), np.int64)
    total = table.select("q").rdd.treeAggregate(zero, add, lambda a, b: a + b)
    shared.unpersist()
    sums, counts = total[:, :, :positions], total[:, :, positions:]
    return np.where(counts > 0, np.floor_divide(sums, np.maximum(counts, 1)), codebooks)


def fit(table: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds over a table of blocks."""
    for _ in range(rounds):
        codebooks = _refined(table, codebooks)
    return codebooks


def encode(table: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector of a table of blocks."""
    parts, _, positions = codebooks.shape
    kind = {f.name: f.dataType.elementType.simpleString() for f in table.schema if f.name != "q"}
    shared = table.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                q = np.frombuffer(batch.column(2)[k].as_buffer(), np.int32).reshape(parts, positions, -1).astype(np.int64)
                codes, error = np.zeros((q.shape[2], parts), np.uint8), np.zeros(q.shape[2], np.int64)
                for part in range(parts):
                    at, far = nearest(q[part], shared.value[part])
                    codes[:, part] = at
                    error += far
                text = codes.tobytes().hex()
                texts = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, batch.column(1)[k].values, pa.array(texts, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return table.select("vec_ids", "labels", "q").mapInArrow(run, f"vec_id {kind['vec_ids']}, label {kind['labels']}, code string, error long")


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of vectors that is kept: vec_id, label, code, error, label_error, codebooks_sha256.

    vectors: vec_id, label, embedding (an array of numbers); other columns are ignored. A row goes whose vector is null
    or empty, holds a null or a component that is not finite, or differs in length from the kept vector with the smallest
    vec_id. That length must be a multiple of parts, and components must be below 131,072: else an error says so.
    Codebooks start with the vectors of the smallest vec_ids, fewer if there are fewer; a null vec_id comes last, and
    repeated vec_ids are ordered by their vectors and count as often as they occur. code: for each part the index of
    the nearest entry, two hex digits each (so at most 256 entries); error: the squared distances summed; label_error:
    errors summed over rows of equal label, null labels together. An empty table gives an empty result."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: from 1 to 256 entries")
    rows = quantized(vectors)
    codebooks = first_entries(rows, entries, parts)
    table = blocks(rows, parts * codebooks.shape[2])
    codebooks = fit(table, codebooks, rounds)
    codes = materialize(encode(table, codebooks), "codes").withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = codes.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    found = join_groups(codes, sums, ["_none", "_label"], "_n", codes.count())
    return found.select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
