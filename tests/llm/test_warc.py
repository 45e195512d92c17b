import gzip
import hashlib
import json
import random
import zlib

import pytest

from textmill.llm import warc as W


def test_normalise_a_monolithic_file(tmp_path):
    rng = random.Random(1)
    blocks = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 5000)] + [b"\r\n\r\nWARC/1.1\r\n" * 50, b"x" * 300_000]
    raw = [W.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", W._urn(i))], b) for i, b in enumerate(blocks)]
    source, target = tmp_path / "a.warc.gz", tmp_path / "b.warc.gz"
    source.write_bytes(gzip.compress(b"".join(raw[:2])) + gzip.compress(b"".join(raw[2:])))
    index = W.normalise_file(str(source), str(target))
    assert gzip.decompress(target.read_bytes()) == b"".join(raw)
    assert [json.loads(x) for x in open(f"{target}.idx")] == index
    with open(target, "rb") as file:
        for i in (3, 0, 4, 2, 1):  # any order
            headers, block = W.read_record(file, index[i]["offset"], index[i]["length"])
            assert (W._key(headers["warc-record-id"]), block) == (i, blocks[i])


def test_a_cut_archive_is_an_error(tmp_path):
    source = tmp_path / "a.warc.gz"
    source.write_bytes(gzip.compress(W.record_bytes([("WARC-Type", "response")], b"abc")[:-6]))
    with pytest.raises(ValueError, match="ends inside"):
        W.normalise_file(str(source), str(tmp_path / "b.warc.gz"))


def test_an_archive_cut_at_the_end_of_a_record_is_an_error(tmp_path):
    raw = [W.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", W._urn(i))], b"abc" * 50) for i in range(3)]
    packer = zlib.compressobj(1, wbits=31)
    data = packer.compress(raw[0] + raw[1]) + packer.flush(zlib.Z_FULL_FLUSH)
    source = tmp_path / "a.warc.gz"
    for whole, rest in ((True, packer.compress(raw[2]) + packer.flush()), (False, b"")):
        source.write_bytes(data + rest)
        if whole:
            assert len(W.normalise_file(str(source), str(tmp_path / "b.warc.gz"))) == 3
        else:
            with pytest.raises(ValueError, match="ends inside a gzip member"):
                W.normalise_file(str(source), str(tmp_path / "b.warc.gz"))


def test_a_page_id_with_two_texts(spark):
    rows = [(1, "a" * 2000), (1, "b" * 3000), (0, "a" * 2000), (0, "b" * 3000), (None, "c" * 1500), (None, "c" * 1500)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in W.page_records(pages).collect()), key=str)
    want = [(0, 2000, "revisit", 1), (0, 3000, "revisit", 1), (1, 2000, "response", None), (1, 3000, "response", None), (None, 1500, "response", None), (None, 1500, "response", None)]
    assert got == sorted(want, key=str)


def test_records_have_the_mandatory_fields(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x")], "page_id long, url string, html string")
    index, _ = W.archive_pages(pages)
    row = index.first()
    store, path = W._store(row.archive)
    with store.open_input_file(path) as file:
        headers, _ = W.read_record(file, row.offset, row.length)
    assert {"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(headers)


def test_pages_round_trip(spark):
    same = "é" * 600
    rows = [(1, "http://a/", same), (5, "http://b/\n x", same), (3, None, same), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (9, "u", "z" * 2_000_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows] + [(None, "u", same, "x"), (4, "u", "short", "x")], "page_id long, url string, html string, digest string")
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.page_records(pages).collect())
    want = []
    for i, _, html in [*rows, (4, "u", "short")]:
        data = (html or "").encode()
        revisit = html == same and i != 5
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    want.append((-1, 1200, hashlib.sha1(same.encode()).hexdigest(), "revisit", 5))
    assert got == sorted(want, key=lambda r: r[:4])
    assert W.page_records(pages.limit(0)).count() == 0


def test_small_archives_keep_every_record(spark):
    pages = spark.range(60).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 400) AS html")
    index, records = W.archive_pages(pages, archive_bytes=2000)
    assert index.select("archive").distinct().count() > 5
    assert {r.page_id: bytes(r.payload).decode() for r in records.collect()} == {i: str(i) * 400 for i in range(60)}


def test_inflate_gives_bounded_pieces():
    import gzip
    import io
    import os
    import zlib

    from textmill.llm.warc import inflate

    for raw in ([b"\0" * 5_000_000], [os.urandom(3000), b"", b"a" * 4096, b"b" * 4097], [b"x" * 4096]):
        data = b"".join(gzip.compress(r) for r in raw)
        pieces = list(inflate(io.BytesIO(data), 4096))
        assert b"".join(pieces) == b"".join(raw) and max(map(len, pieces)) <= 4096
        with pytest.raises((ValueError, zlib.error)):
            list(inflate(io.BytesIO(data[:-1]), 4096))
