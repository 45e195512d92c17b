from datetime import date
from fractions import Fraction

from pyspark.sql import functions as F

from textmill.llm import license_scan, source_mix, url_filter


def test_licence_is_found_whatever_its_dress(spark):
    mit = license_scan.KNOWN["MIT"][2]
    rows = [
        (1, f"Copyright (c) 2020 Somebody\n\n{mit.upper()}"), (2, "* © 1999 X\n" + mit.replace("sublicense", "sub-licence").replace(" ", "\n * ")),
        (3, "Some prose.\nLICENCED under the Apache licence, version 2.0!\nMore."), (4, "All rights reserved"), (5, None), (6, ""),
        (7, mit + " and more"), (8, "x " * 30_000 + "\nReleased under the MIT License."), (8, "prose"),
    ]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, license string")
    got = sorted((r.doc_id, r.license, r.line_licenses, r.n_license_lines) for r in license_scan.scan(docs).collect())
    assert got == [
        (1, "MIT", "MIT", 1), (2, "MIT", "", 0), (3, None, "Apache-2.0", 1), (4, "LicenseRef-all-rights-reserved", "LicenseRef-all-rights-reserved", 1),
        (5, None, "", 0), (6, None, "", 0), (7, None, "", 0), (8, None, "", 0), (8, None, "MIT", 1),
    ]
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_licences_from_files(spark, tmp_path):
    for name, texts in license_scan.KNOWN.items():
        (tmp_path / f"{name}.txt").write_text(f"{name}\n\nCopyright (c) 2021 Somebody\n\n" + texts[-1].replace(". ", ".\n"))
    known = license_scan.known_from_files(spark, str(tmp_path))
    assert known.count() == len(license_scan.KNOWN) >= 20
    docs = known.select(F.xxhash64("license").alias("doc_id"), F.upper("text").alias("text"), F.col("license").alias("name"))
    got = {r.doc_id: r.license for r in license_scan.scan(docs, known).collect()}
    assert got == {r.doc_id: r.name for r in docs.collect()}
    assert all(r.license is None for r in license_scan.scan(docs, known.limit(0)).collect())


def test_spellings_keep_the_first_three_characters():
    assert all(a[:3] == b[:3] for a, b in license_scan.SPELLINGS)


def test_mix_deviates_by_less_than_a_block(spark):
    rows = [(i, "big" if i % 3 else ("mid" if i % 2 else None), f"t{i}") for i in range(3000)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, source string, text string, mix_slot int, _row string")
    block = 4
    mixed = source_mix.mix(docs, weights={"big": 0.5, "mid": 0.3, "": 0.2}, quanta=50, block_rows=block, buckets=7)
    got = mixed.collect()
    assert sorted((r.doc_id, r.source, r.text) for r in got) == sorted(rows)  # whole
    assert len({(r.mix_slot, r.mix_place) for r in got}) == len(rows)
    quanta = {r.source: r.quanta for r in source_mix.target_weights(docs, {"big": 0.5, "mid": 0.3, "": 0.2}, quanta=50).collect()}
    assert sum(quanta.values()) == 50
    inside = [r for r in got if r.in_mix]
    slots = {}
    for r in inside:
        assert slots.setdefault(r.mix_slot, r.source or "") == (r.source or "")
    end = max(slots) + 1
    assert sorted(slots) == list(range(end)) and end > 100
    done = dict.fromkeys(quanta, 0)
    for slot in range(end):
        done[slots[slot]] += 1
        assert all(abs(done[s] - Fraction(q, 50) * (slot + 1)) < 1 for s, q in quanta.items())
    assert not any(r.in_mix and r.mix_slot >= end for r in got) and any(not r.in_mix for r in got)


def test_default_weights_and_order(spark):
    docs = spark.createDataFrame([(i, "a" if i < 900 else f"s{i % 7}", i) for i in range(1000)], "doc_id long, source string, n int")
    q = {r.source: r for r in source_mix.target_weights(docs).collect()}
    assert sum(r.quanta for r in q.values()) == 1000 and q["a"].quanta < 900
    ordered = [r.doc_id for r in source_mix.mixed_order(docs, parts=3, block_rows=2).collect()]
    placed = {r.doc_id: (r.mix_slot, r.mix_place) for r in source_mix.mix(docs, block_rows=2).collect()}
    assert ordered == sorted(placed, key=placed.get)
    assert source_mix.mix(docs.limit(0)).count() == 0


def test_hosts_as_browsers_read_them(spark):
    urls = {
        "http://[2001:DB8::1]:80/x": "[2001:db8::1]", "http://bad.org\\@good.org/": "bad.org", "http:\\\\bad.org": "bad.org", "https://bad%2Eorg/": "bad.org",
        "http://a@b@Bad.org./p@q": "bad.org", "http://1.2.3.4/": "1.2.3.4", "http://": None, "mailto:x@y.z": None, "http://100%25.org": "100%.org", "http://x%zz": "x%zz",
    }
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.host for r in frame.select("url", url_filter.host_of(frame.url).alias("host")).collect()} == urls
    entries = spark.createDataFrame([("4", "block", date(2024, 1, 1)), ("[2001:db8::1]", "block", date(2024, 1, 1))], "rule string, action string, listed_at date")
    pages = spark.createDataFrame([(u, date(2024, 2, 1)) for u in urls], "url string, fetched_at date")
    assert [r.host for r in url_filter.evaluate(pages, entries).filter("verdict = 'block'").collect()] == ["[2001:db8::1]"]


def test_url_filter_as_of(spark):
    d = lambda m, n=1: date(2024, m, n)
    entries = spark.createDataFrame(
        [("bad.org", "block", d(2)), ("bad.org", "remove", d(4)), ("ok.bad.org", "allow", d(3)), ("bad.org", "block", d(6)), ("Net", "block", d(1)),
         ("bad.org", "block", d(6)), ("bad.org", "nonsense", d(1)), (None, "block", d(1)), ("same.org", "block", d(5)), ("same.org", "allow", d(5))],
        "rule string, action string, listed_at date",
    )
    rows = [
        (1, "http://bad.org/x", d(1, 31), "none", None), (2, "https://u@WWW.Bad.org:80/", d(2), "block", "bad.org"), (3, "http://ok.bad.org", d(3, 5), "allow", "ok.bad.org"),
        (4, "http://bad.org", d(4), "none", None), (5, "http://ok.bad.org", d(7), "allow", "ok.bad.org"), (6, "http://x.net./?q", d(2), "block", "net"),
        (7, None, d(2), "none", None), (8, "not a url", d(2), "none", None), (9, "http://bad.org", None, "none", None), (10, "http://notbad.org", d(7), "none", None),
        (11, "http://same.org", d(5), "allow", "same.org"), (4, "http://bad.org", d(4), "none", None),
    ]
    captures = spark.createDataFrame([(i, u, t, "x") for i, u, t, *_ in rows], "page_id long, url string, fetched_at date, rule string")
    got = url_filter.evaluate(captures, entries).collect()
    key = lambda x: (x[0], str(x))
    assert sorted(((r.page_id, r.verdict, r.rule) for r in got), key=key) == sorted(((i, v, rule) for i, _, _, v, rule in rows), key=key)
    assert url_filter.evaluate(captures.limit(0), entries).count() == 0
    assert {r.verdict for r in url_filter.evaluate(captures, entries.limit(0)).collect()} == {"none"}


def test_licence_rows_stand_alone(spark):
    mit, gone = "Released under the MIT License.", "a poem"
    rows = [(None, mit), (None, gone), (None, mit), (5, f"x\n{mit}\n{mit}"), (5, gone), (6, mit), (6, mit), (None, None)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, "MIT", 1), (None, "", 0), (None, "MIT", 1), (5, "MIT", 2), (5, "", 0), (6, "MIT", 1), (6, "MIT", 1), (None, "", 0)]
    assert sorted(((r.doc_id, r.line_licenses, r.n_license_lines) for r in got), key=str) == sorted(want, key=str)
