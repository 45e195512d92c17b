"""WARC archives: writing, normalising monolithic gzip files, reading by offset.

Crawlers often gzip a whole archive as one stream, in which no record can be reached without inflating all before
it. The normaliser inflates such a file once, writes each record as a gzip member of its own, and leaves a sidecar
index beside it: one JSON line per record with offset, length and the record's headers in brief. Archives and
sidecars lie in one folder that driver and executors share. A task writes under a name of its own attempt, and
readers only follow the manifest that Spark committed, so lost executors and repeated attempts leave no wrong data.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm.common import join_groups, key_bitmap, materialize, rows_that_may_hold, rows_without, shared_dir

#: Payloads below this many bytes are always written in full.
MIN_REVISIT_BYTES = 1000
#: An archive is closed at the first record after this many bytes, before compression.
ARCHIVE_BYTES = 64 << 20
#: Date of records whose time of capture is not known.
WARC_DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF + CRLF


class RecordReader:
    """Records of a stream of inflated bytes: (headers, block, raw record)."""

    def __init__(self, chunks):
        self.chunks, self.buffer = iter(chunks), bytearray()

    def _fill(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.buffer += chunk
        return True

    def __iter__(self):
        while True:
            seen = 0
            while (end := self.buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
                seen = len(self.buffer)
                if not self._fill():
                    if self.buffer.strip():
                        raise ValueError("the archive ends inside a record's headers")
                    return
            lines = bytes(self.buffer[:end]).decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(headers["content-length"])
            total = end + 4 + size + 4
            while len(self.buffer) < total:
                if not self._fill():
                    raise ValueError("the archive ends inside a record")
            raw = bytes(self.buffer[:total])
            del self.buffer[:total]
            yield headers, raw[end + 4 : end + 4 + size], raw


def inflate(file, size: int = 1 << 20):
    """The bytes of a gzip file of one or more members, in order, each read once, in pieces of at most ``size`` however much a
    few bytes of the file stand for."""
    inflater, begun = zlib.decompressobj(wbits=31), False
    while data := file.read(size):
        more = True
        while more:
            begun = True
            piece = inflater.decompress(data, size)
            if piece:
                yield piece
            if inflater.eof:
                data = inflater.unused_data
                inflater, begun = zlib.decompressobj(wbits=31), False
                more = bool(data)
            else:  # a full piece may have more behind it that is read already
                data = inflater.unconsumed_tail
                more = bool(data) or len(piece) == size
    if begun:  # neither the end of the stream nor its check sum was seen
        raise ValueError("the archive ends inside a gzip member")


def normalise_file(source: str, target: str) -> list[dict]:
    """Rewrite one gzip archive with a member for each record, and write its sidecar ``target + '.idx'``.

    Returns the index: offset and length of each member, and type, id, digest and refers_to of its record."""
    store, path = _store(source)
    out_store, out_path = _store(target)
    index, offset = [], 0
    with store.open_input_stream(path, compression=None) as file, out_store.open_output_stream(out_path, compression=None) as out:
        for headers, _, raw in RecordReader(inflate(file)):
            member = gzip.compress(raw, compresslevel=4, mtime=0)
            out.write(member)
            index.append({
                "offset": offset, "length": len(member), "type": headers.get("warc-type"), "id": headers.get("warc-record-id"),
                "digest": headers.get("warc-payload-digest"), "refers_to": headers.get("warc-refers-to"),
            })
            offset += len(member)
    with out_store.open_output_stream(f"{out_path}.idx", compression=None) as out:
        out.write("".join(json.dumps(x) + "\n" for x in index).encode())
    return index


def read_record(file, offset: int, length: int) -> tuple[dict, bytes]:
    """Headers and block of the record in the member at offset; nothing else is read."""
    file.seek(offset)
    headers, block, _ = next(iter(RecordReader([gzip.decompress(file.read(length))])))
    return headers, block


def _urn(key) -> str:
    return f"<urn:textmill:page:{key}>"


def _key(urn: str | None) -> int | None:
    number = urn.rsplit(":", 1)[1].rstrip(">") if urn else "None"
    return None if number == "None" else int(number)


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest and, for revisits, refers_to.

    Of pages with equal payloads of at least min_bytes bytes the one with the largest page_id is written in full and
    the others refer to it. Equal means equal length, SHA-1 and SHA-256. The groups are counted without their
    payloads."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "digest": F.sha1("payload"), "digest2": F.sha2("payload", 256), "size": F.octet_length("payload"),
    }).withColumn("_key", F.when(F.col("size") >= min_bytes, F.xxhash64("digest", "digest2", "size")))
    keys = ["_key", "digest", "digest2", "size"]
    ids = materialize(rows.filter("_key IS NOT NULL").select("page_id", *keys), "digests")
    groups = ids.groupBy(*keys).agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = materialize(groups, "groups")
    bitmap = materialize(key_bitmap(groups, "_key"), "bitmap")
    # A revisit has no payload: only the ids of pages with an equal one are joined, and others stay where they are.
    refers = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    again = rows_that_may_hold(rows, "_key", bitmap)
    last = F.col("page_id").eqNullSafe(F.col("first_id")) | F.col("first_id").isNull()
    narrow = join_groups(again.drop("payload"), groups, keys, "n", ids.count(), "left")
    revisits = narrow.filter(~last).select("page_id", "url", "digest", refers.alias("refers_to"), F.lit(None).cast("binary").alias("payload"))
    row = F.xxhash64("page_id", *keys).alias("_row")
    firsts = narrow.filter(last).select("page_id", *keys, row).distinct().withColumnsRenamed({"page_id": "_id"})
    holds = rows_that_may_hold(again.select("*", row), "_row", key_bitmap(firsts, "_row"))
    same = [holds[k] == firsts[k] for k in ("_row", *keys)] + [holds["page_id"].eqNullSafe(firsts["_id"])]
    full = holds.join(firsts, same, "left_semi").drop("_row")
    plain = rows_without(rows, "_key", bitmap).unionByName(full)
    return plain.select("page_id", "url", "digest", F.lit(None).cast("long").alias("refers_to"), "payload").unionByName(revisits)


def write_monolithic(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = WARC_DATE) -> DataFrame:
    """Write records into archives that are one gzip stream each; a row (archive, records) for each, committed.

    date: the WARC-Date of all records, as pages carry no time of their own."""

    def run(batches):
        file = packer = None
        name, written, count = "", 0, 0
        for batch in batches:
            ids, urls, digests, refers, payloads = (batch.column(i).to_pylist() for i in range(5))
            for key, url, digest, refer, payload in zip(ids, urls, digests, refers, payloads, strict=True):
                if packer is None:
                    name, written, count = f"{folder}/raw-{uuid.uuid4().hex}.warc.gz", 0, 0
                    store, path = _store(name)
                    store.create_dir(path.rsplit("/", 1)[0])
                    file, packer = store.open_output_stream(path, compression=None), zlib.compressobj(1, wbits=31)
                headers = [
                    ("WARC-Type", "response" if refer is None else "revisit"), ("WARC-Record-ID", _urn(key)), ("WARC-Date", date),
                    ("WARC-Target-URI", " ".join((url or "").split())), ("Content-Type", "text/html"), ("WARC-Payload-Digest", f"sha1:{digest}"),
                ]
                if refer is not None:
                    headers += [("WARC-Refers-To", _urn(refer)), ("WARC-Profile", REVISIT_PROFILE)]
                raw = record_bytes(headers, payload if refer is None else b"")
                file.write(packer.compress(raw))
                written, count = written + len(raw), count + 1
                if written >= archive_bytes:
                    file.write(packer.flush())
                    file.close()
                    packer = None
                    yield pa.RecordBatch.from_pydict({"archive": [name], "records": [count]})
        if packer is not None:
            file.write(packer.flush())
            file.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [count]})

    return materialize(records.mapInArrow(run, "archive string, records long"), "archives")


def normalise(archives: DataFrame) -> DataFrame:
    """Normalise every archive of a manifest; the committed index of the new ones, a row for each record:
    archive, offset, length, type, id, digest, refers_to."""
    n = max(1, archives.count())
    schema = "archive string, offset long, length long, type string, id string, digest string, refers_to string"

    def run(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = source.replace("/raw-", "/normal-").replace(".warc.gz", f"-{uuid.uuid4().hex[:8]}.warc.gz")
                index = normalise_file(source, target)
                yield pa.RecordBatch.from_pylist(
                    [{"archive": target} | x for x in index],
                    pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *((k, pa.string()) for k in ("type", "id", "digest", "refers_to"))]),
                )

    return materialize(archives.select("archive").repartition(n).mapInArrow(run, schema), "index")


def read_back(index: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Read every record at its offset: page_id, record_type, refers_to_id, payload_digest, stored_bytes, payload
    (null if not keep_payload).

    A response's digest is computed from its block and must equal the one in its headers."""
    schema = "page_id long, record_type string, refers_to_id long, payload_digest string, stored_bytes long, payload binary"

    def run(batches):
        name, file = None, None
        for batch in batches:
            archives, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            out: dict[str, list] = {k: [] for k in ("page_id", "record_type", "refers_to_id", "payload_digest", "stored_bytes", "payload")}
            held = 0
            for archive, offset, length in zip(archives, offsets, lengths, strict=True):
                if archive != name:
                    if file is not None:
                        file.close()
                    store, path = _store(archive)
                    name, file = archive, store.open_input_file(path)
                headers, block = read_record(file, offset, length)
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                    raise ValueError(f"{archive} at {offset}: the payload doesn't have the digest of its headers")
                values = (_key(headers["warc-record-id"]), kind, _key(headers.get("warc-refers-to")), digest, len(block), block if keep_payload else None)
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
                held += len(block)
                if held > 8_000_000:
                    yield _batch(out)
                    out, held = {k: [] for k in out}, 0
            yield _batch(out)
        if file is not None:
            file.close()

    return index.select("archive", "offset", "length").mapInArrow(run, schema)


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


def archive_pages(
    pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, keep_payload: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Write pages (page_id long, url, html) as WARC, normalise the archives, and return (index, records read back).

    A null html counts as empty, a null url is written empty. A page without page_id gets a record without a number
    that is read back as null; it may refer to another, but nothing refers to it. A row repeated with its page_id is a record of its own. An empty table leaves no archive and
    gives empty results. Long pages are written whole. Other columns are ignored. The files stay in the shared
    folder: their paths are in the index."""
    folder = f"{shared_dir(pages.sparkSession)}-warc"
    index = normalise(write_monolithic(plan_records(pages, min_bytes), folder, archive_bytes))
    return index, read_back(index, keep_payload)


def page_records(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives."""
    _, records = archive_pages(pages, keep_payload=False)
    records = materialize(records.drop("payload"), "records")
    # A revisit's payload is that of the record it refers to, told apart by id and digest.
    revisits = records.filter("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to_id")
    keys = ["refers_to_id", "payload_digest"]
    full = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to_id"), "payload_digest").agg(F.max("stored_bytes").alias("payload_bytes"))
    full = full.join(revisits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    resolved = join_groups(revisits, full, keys, "_n", records.count()).withColumnRenamed("refers_to_id", "refers_to")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    none = F.lit(None).cast(T.LongType()).alias("refers_to")
    whole = records.filter("record_type = 'response'").select("page_id", F.col("stored_bytes").alias("payload_bytes"), "payload_digest", "record_type", none)
    return whole.unionByName(resolved.select(columns))
