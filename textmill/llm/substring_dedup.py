"""Removal of long passages that documents share, by Rabin-Karp hashes of every window of WINDOW words.

A window that also starts in a document with a smaller doc_id is repeated: its words go. Repeated windows that overlap
or touch merge into maximal intervals.

Windows are hashed by prefix sums over a whole block of texts. Most of them occur in one document only, and a cheap
count finds out which: of each window's grams of GRAM words the least hash is its anchor, which equal windows have in
common and neighbours mostly share, so that there are some fifteen times fewer anchors than windows. Anchors that
several documents have go into a bitmap of bounded size; windows with another anchor can't be repeated and stay where
they are. All others are counted in Spark by 128-bit hashes: the smallest doc_id of each is joined back. If the bitmap
fills up, more windows are counted than need be, never fewer.

Equal word sequences are one class: its documents but that with the smallest doc_id lose all words if they have a
window, so only that document sends its windows. It is told by a second bitmap, of all such documents; where this fills
up, copies send theirs too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import discard, in_bitmap, join_groups, key_bitmap, materialize, rows_that_may_hold, sent_bitmap
from textmill.llm.shingles import _BASE, _mixed, _slices, rolled, text_bytes, word_hashes

#: Words of a window.
WINDOW = 50
#: Words of the grams of which the least hash is a window's anchor.
GRAM = 20
#: Anchors put together in a task before they are sent.
TOGETHER = 4_000_000
#: Bytes of text worked on at once.
BLOCK = 1 << 20

#: Two sets of numbers that stand for bytes, for two independent hashes; letters count as they are.
_CODES = [_mixed((np.arange(256, dtype=np.uint64) + np.uint64(k)) * np.uint64(_BASE)) for k in (1, 1 << 20)]
_EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of words the least hash of its grams, from the hashes of the words."""
    least, width, want = rolled(h, gram), 1, window - gram + 1
    while 2 * width <= want:  # the least of twice as many grams
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = want - width
    return np.minimum(least[:-rest], least[rest:]) if rest and len(least) > rest else least[: max(0, len(h) - window + 1)]


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text; bytes.split has the same separators, U+0009 to U+000D and space."""
    return raw.split()


def kept_words(raw: bytes, hashes: np.ndarray, window: int = WINDOW) -> tuple[int, list[tuple[int, int]], str]:
    """(number of words removed, intervals of these, digest of the words kept) of a text, from the hashes of its repeated
    windows; an interval is (first word, word behind the last)."""
    words = words_of(raw)
    data = np.frombuffer(raw, np.uint8)
    h, _ = word_hashes(data, np.array([0, len(data)]), code=_CODES[0])
    start = np.flatnonzero(np.isin(rolled(h, window), hashes))
    first = start[np.concatenate([[True], np.diff(start) > window])] if len(start) else start
    last = start[np.concatenate([np.diff(start) > window, [True]])] + window if len(start) else start
    kept, at = [], 0
    for a, z in zip(first.tolist(), last.tolist(), strict=True):
        kept += words[at:a]
        at = z
    kept += words[at:]
    return len(words) - len(kept), list(zip(first.tolist(), last.tolist(), strict=True)), hashlib.sha256(b" ".join(kept)).hexdigest()


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _blocks(batch: pa.RecordBatch, both: bool, window: int, gram: int):
    """For runs of texts: (first row, data, bounds, words before each text, hash of each window, second hash, anchors, the
    starts of windows that lie in one text, and the row of each)."""
    data, bounds = text_bytes(batch.column(1))
    for start, stop in _slices(bounds, BLOCK):
        cuts = bounds[start : stop + 1]
        part, inner = data[cuts[0] : cuts[-1]], cuts - cuts[0]
        h, at = word_hashes(part, inner, BLOCK, _CODES[0])
        count = np.maximum(np.diff(at) - window + 1, 0)
        row = np.repeat(np.arange(len(count)), count)
        begin = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + at[row]
        second = rolled(word_hashes(part, inner, BLOCK, _CODES[1])[0], window)[begin] if both else None
        first = rolled(h, window)[begin] if both else None
        yield start, part, inner, at, first, second, anchors(h, window, gram)[begin], row


def _describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, text_sha256) of every row, the digest of its words joined by one space."""
    names = ["doc_id", "n_words", "text_sha256"]

    def run(batches):
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            n, digests = [], []
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                words = words_of(data[a:z].tobytes())
                n.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string())], names)

    return materialize(docs.mapInArrow(run, "doc_id long, n_words long, text_sha256 string"), "described")


def _member(doc: int, node: int) -> int:
    """A hash of a document and its class."""
    return int(_mixed(np.array([doc, node], np.int64).view(np.uint64) * np.uint64(_BASE)).sum(dtype=np.uint64).view(np.int64))


def _firsts(rows: DataFrame, window: int) -> DataFrame:
    """(member): _member of the first document of each class of equal word sequences."""
    least = rows.filter(f"n_words >= {window} AND doc_id IS NOT NULL").groupBy("text_sha256").agg(F.min("doc_id").alias("doc_id"))

    def run(batches):
        for batch in batches:
            nodes = [_node(bytes.fromhex(d)) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_member(d, n) for d, n in zip(batch.column(0).to_pylist(), nodes, strict=True)], pa.int64())], ["member"])

    return least.select("doc_id", "text_sha256").mapInArrow(run, "member long")


def _chosen(batch: pa.RecordBatch, firsts, both: bool, window: int, gram: int, wanted=None):
    """(doc_ids, row, first, second, anchors) of the windows of documents that are the first of their class, run of texts by
    run of texts; wanted: a bitmap that one of a document's anchors must be in."""
    unnamed = batch.column(0).is_null().to_numpy(zero_copy_only=False)
    ids = batch.column(0).fill_null(0).to_numpy()
    for start, data, bounds, _, first, second, anchor, row in _blocks(batch, both, window, gram):
        hit = ~unnamed[start + row]
        if wanted is not None:
            hit &= in_bitmap(wanted.value, anchor)
        sent = np.zeros(len(bounds) - 1, bool)
        for k in np.unique(row[hit]).tolist():
            words = words_of(data[bounds[k] : bounds[k + 1]].tobytes())
            node, doc = _node(hashlib.sha256(b" ".join(words)).digest()), int(ids[start + k])
            sent[k] = in_bitmap(firsts.value, np.array([_member(doc, node)]).view(np.uint64))[0]
        hit &= sent[row]
        yield ids[start + row[hit]], row[hit], first[hit] if both else None, second[hit] if both else None, anchor[hit]


def _anchors(docs: DataFrame, firsts, window: int, gram: int) -> DataFrame:
    """(anchor, low, high): the anchors of windows with the smallest and largest doc_id, put together within a task."""

    def run(batches):
        held, size = [], 0

        def together():
            values, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, values))
            values, ids = values[order], ids[order]
            start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            last = np.append(start[1:], len(values)) - 1
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (values[start].view(np.int64), ids[start], ids[last])], ["anchor", "low", "high"])

        for batch in batches:
            for ids, row, _, _, anchor in _chosen(batch, firsts, False, window, gram):
                new = np.ones(len(row), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                held.append((anchor[new], ids[new]))
                size += int(new.sum())
                if size > TOGETHER:
                    yield together()
                    held, size = [], 0
        if size:
            yield together()

    found = docs.mapInArrow(run, "anchor long, low long, high long")
    return found.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _windows(docs: DataFrame, wanted, firsts, window: int, gram: int) -> DataFrame:
    """(a, b, doc_id): the two hashes of windows whose anchor is in the bitmap, once for each document, and of equal
    documents for the first only."""

    def run(batches):
        for batch in batches:
            for ids, row, a, b, _ in _chosen(batch, firsts, True, window, gram, wanted):
                order = np.lexsort((b, a, row))
                a, b, ids, row = a[order], b[order], ids[order], row[order]
                new = np.ones(len(row), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (row[1:] != row[:-1])
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[new].view(np.int64), b[new].view(np.int64), ids[new])], ["a", "b", "doc_id"])

    return materialize(docs.mapInArrow(run, "a long, b long, doc_id long"), "windows")


def _repeated(windows: DataFrame) -> DataFrame:
    """(doc_id, hashes): the windows of each document that a document with a smaller doc_id has too."""
    first = windows.groupBy("a", "b").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    first = materialize(first.filter("_first < _last").drop("_last"), "first")
    met = join_groups(windows, first, ["a", "b"], "_n", windows.count()).filter(F.col("_first") < F.col("doc_id"))
    found = materialize(met.groupBy("doc_id").agg(F.collect_list("a").alias("hashes")), "repeated")
    discard(first)
    return found


def _kept(docs: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_sha256, n_removed, intervals, kept_sha256) of the documents that lose words. Only their texts move."""
    keyed = lambda rows: rows.withColumn("_key", F.xxhash64("doc_id"))
    wanted = materialize(key_bitmap(keyed(repeated), "_key"), "losers")
    texts = rows_that_may_hold(keyed(docs.filter(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * window - 1))), "_key", wanted)

    def cut(batches):
        for batch in batches:
            found = []
            for text, hashes in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                removed, intervals, digest = kept_words(raw, hashes.values.to_numpy().view(np.uint64), window)
                found.append((hashlib.sha256(b" ".join(words_of(raw))).hexdigest(), removed, [{"start": a, "stop": z} for a, z in intervals], digest))
            sha, removed, intervals, digest = zip(*found, strict=True) if found else ([],) * 4
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            columns = [batch.column(0), pa.array(sha, pa.string()), pa.array(removed, pa.int64()), pa.array(intervals, kind), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_sha256", "n_removed", "intervals", "kept_sha256"])

    joined = texts.select("doc_id", "text").join(repeated, "doc_id").select("doc_id", "text", "hashes")
    schema = "doc_id long, text_sha256 string, n_removed long, intervals array<struct<start: long, stop: long>>, kept_sha256 string"
    # Repeated rows come as often.
    return materialize(joined.mapInArrow(cut, schema), "kept").dropDuplicates(["doc_id", "text_sha256"])


def shared_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, intervals, kept_sha256.

    Words are runs of characters other than space and U+0009 to U+000D, unchanged. Each word goes that is covered by
    ``window`` consecutive words that also start in a document with a smaller doc_id; windows are judged on the input.
    intervals: the maximal runs of words that go, as (start, stop) in words, in order; kept_sha256: SHA-256 of the
    words that stay, joined by one space. A null or empty text, or one of fewer words than a window, loses nothing.
    doc_id is an integer. A row without one is compared with no other and loses nothing. Rows with the same doc_id
    are compared with those of smaller ids, not with each other, so repeated rows give repeated results. Other columns
    are ignored, an empty table gives an empty result, and texts of any length are read whole."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gram = min(gram, window)
    rows = _describe(docs)
    firsts = sent_bitmap(_firsts(rows, window), "member")
    wanted = sent_bitmap(_anchors(docs, firsts, window, gram).filter("low < high"), "anchor")
    windows = _windows(docs, wanted, firsts, window, gram)
    wanted.unpersist()
    firsts.unpersist()
    repeated = _repeated(windows)
    discard(windows)
    kept = _kept(docs, repeated, window)

    # Copies of a document with a smaller doc_id lose all words; what their windows say is not needed.
    whole = rows.filter(f"n_words >= {window} AND doc_id IS NOT NULL")
    copies = whole.groupBy("text_sha256").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    marked = join_groups(whole, copies, ["text_sha256"], "_n", rows.count(), "left")
    copied = F.col("_least") < F.col("doc_id")
    none = F.array().cast("array<struct<start: long, stop: long>>")
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    gone = marked.filter(copied).select("doc_id", "n_words", F.col("n_words").alias("n_removed"), all_words.alias("intervals"), F.lit(_EMPTY).alias("kept_sha256"))
    rest = marked.filter(F.coalesce(~copied, F.lit(True))).drop("_least", "_n").join(kept, ["doc_id", "text_sha256"], "left")
    rest = rest.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("intervals", none).alias("intervals"), F.coalesce("kept_sha256", "text_sha256").alias("kept_sha256"))
    short = rows.filter(f"n_words < {window} OR doc_id IS NULL")
    short = short.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), none.alias("intervals"), F.col("text_sha256").alias("kept_sha256"))
    return short.unionByName(gone).unionByName(rest)
