"""Lecture pages, records of files, documents written, and generators."""

import json

import pytest
from pyspark.sql import functions as F

from textmill.operators import sequences as S
from textmill.sources import lectures as L
from textmill.sources import readers, sinks, synthetic

PAGE = """---
title: "Words"
n: {{< var site.n >}}
---
<!-- a
comment -->
## First {.x}

Text with {{< var site.n >}} and {{< var no.such >}}.

::: {.callout title="Note here"}
Inside.
:::

```python
# not a heading {.y}
## Other
```

## Live plan
- 5 minutes

## Last {.reference}



End.   
::: {#quiz .activity}
Ask.
:::
"""


def test_clean_pages(spark, tmp_path):
    (tmp_path / "01-words.qmd").write_text(PAGE)
    (tmp_path / "other.txt").write_text("x")
    pages = L.read_pages(spark, str(tmp_path), r"^\\d\\d-.*\\.qmd$".replace("\\\\", "\\"), {"site": {"n": "a$1\\b"}})
    row = pages.collect()[0]
    assert (row.slug, row.title) == ("01-words", "Words") and pages.count() == 1
    assert row.text.startswith("## First\n\nText with a$1\\b and {{< var no.such >}}.") and row.text.endswith("End.\nAsk.\n")
    assert "Note here\nInside." in row.text and "# not a heading {.y}\n## Other\n```" in row.text and "5 minutes" not in row.text and ":::" not in row.text and "\n\n\n" not in row.text
    assert pages.select(L.missing_variables(F.col("text")).alias("m")).first().m == ["no.such"]


def test_outline(spark):
    plan = L.outline(spark.createDataFrame([("a", PAGE)], "slug string, text string")).orderBy("section").collect()
    assert [(r.section, r.title, r.reference, r.blocks) for r in plan] == [(1, "First", False, []), (2, "Live plan", False, []), (3, "Last", True, ["quiz"])]


def test_atoms_of_the_first_model(spark, tmp_path):
    line = "ATOM  {:>5} {:<4}{:1}{:<3} {:1}{:>4}    {:8.3f}{:8.3f}{:8.3f}  1.00{:6.2f}          {:>2}"
    atoms = [line.format(1, " CA", "", "MET", "A", 1, 1.5, 2, -3, 9.5, "C"), line.format(2, " CB", "B", "MET", "A", 1, 0, 0, 0, 1, "C"), line.format(3, " N", "A", "GLY", "A", 2, 0, 0, 0, 1, "")]
    (tmp_path / "x.pdb").write_text("\n".join(["HEADER", *atoms, "HETATM", "ENDMDL", atoms[0]]) + "\n")
    rows = readers.read_atoms(spark, str(tmp_path / "x.pdb")).orderBy("line").collect()
    assert [(r.name, r.alt, r.res_name, r.res_seq, r.x, r.z, r.b, r.element) for r in rows] == [("CA", None, "MET", 1, 1.5, -3.0, 9.5, "C"), ("N", "A", "GLY", 2, 0.0, 0.0, 1.0, "N")]


def test_exports_submissions_and_questions(spark, tmp_path):
    good, stub, bad = tmp_path / "good.jsonl", tmp_path / "stub.jsonl", tmp_path / "bad.jsonl"
    good.write_text(json.dumps({"id": 1, "provider": "open"}) + "\n\n")
    stub.write_text(json.dumps({"id": 2, "provider": "a stub"}) + "\n")
    bad.write_text(json.dumps({"id": 3}) + "\n")
    rows, refused = readers.read_exports(spark, str(tmp_path), "id int, provider string", ["id", "provider"])
    assert [(r.file, r.id) for r in rows.collect()] == [("good.jsonl", 1)]
    assert {(r.file, r.why) for r in refused.collect()} == {("stub.jsonl", "stub"), ("bad.jsonl", "fields")}
    (tmp_path / "capstone_a.json").write_text('{"pair":\n 1}')
    assert [tuple(r) for r in readers.read_submissions(spark, str(tmp_path), "pair int").collect()] == [(1, "capstone_a.json")]
    pages = spark.createDataFrame([(1, "aba x"), (2, None)], "page int, text string")
    items = spark.createDataFrame([("a", 1, "x"), ("b", 1, "a"), ("c", 2, "x"), ("d", 9, "x"), ("e", 1, ""), ("f", 1, "ba")], "q string, page int, quote string")
    got = {r.q: (r.start, r.stop) for r in readers.located_questions(items, pages, "q", "page").collect()}
    assert got == {"a": (4, 5), "f": (1, 3), **dict.fromkeys("bcde", (None, None))}
    assert readers.recorded(pages, "page", 1, "text") == "aba x" and readers.recorded(pages, "page", 5, "text") is None


def test_documents_written(spark):
    one = spark.createDataFrame([(0.123456789, 3, "x")], "f1 double, n int, name string")
    assert json.loads(one.select(sinks.card(one, {"metrics": ["n", "f1"], "about": ["name"]}).alias("j")).first().j) == {"about": {"name": "x"}, "metrics": {"f1": 0.123457, "n": 3}}
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    assert json.loads(sinks.document(one, {"rows": (rows, "k")}))["rows"] == [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}]
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.document(one, {"rows": (rows, "k")}, most=1)
    assert sinks.markdown_table(rows, "k") == "| k   | v   |\n|-----|-----|\n| 1   | a   |\n| 2   | b   |"
    assert sinks.canonical({"b": 1, "a": "é"})[0] == '{"a":"é","b":1}'


def test_generators_are_the_same_on_any_partitioning(spark):
    bought = synthetic.purchases(spark, 40)
    rows = bought.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, synthetic.purchases(spark, 40).repartition(3).collect()))
    ids = sorted({(r.invoice_id, r.invoice_date) for r in rows})
    assert [i for i, _ in ids] == list(range(1, len(ids) + 1)) and [d for _, d in ids] == sorted(d for _, d in ids)
    for r in synthetic.announcements(spark, 30).collect():
        assert str(r.seats) in r.text and r.city in r.text and r.topic.lower() in r.text.lower()
    dates = synthetic.date_examples(spark, 60)
    for r in dates.collect():
        assert len(r.tgt.split()) == r.k == len(r.spans) and all(r.src[a:b].strip() for a, b in r.spans)
    assert synthetic.date_examples(spark, 60, exclude=dates).count() == 0 and synthetic.instructions(spark, 9).count() == 9


def test_sequences(spark):
    df = spark.createDataFrame([(1, [5, 9, 3]), (1, [4]), (2, [])], "b int, ids array<int>")
    assert [r.x for r in df.select(S.ids_until(F.col("ids"), 9).alias("x")).collect()] == [[5], [4], []]
    rows = S.encode_batch(df, "b", "ids", 0).collect()
    assert sorted((r.b, r.ids, r["length"], r["mask"]) for r in rows) == [(1, [4, 0, 0], 1, [1, 0, 0]), (1, [5, 9, 3], 3, [1, 1, 1]), (2, [], 0, [])]
    one = spark.createDataFrame([([7, 8, 9, 6], [0.1, 0.13, 0.14, 0.9], [0.0, 0.5, 0.0, 0.0])], "ids array<int>, u array<double>, v array<double>")
    got = one.select(S.mask_tokens(F.col("ids"), F.col("u"), F.col("v"), 1, 100).alias("m")).first().m
    assert (got["inputs"], got["labels"]) == ([1, 50, 9, 6], [7, 8, 9, -100])
    runs = S.run_sheet(spark.createDataFrame([("a", 1, 10), ("a", 2, 5)], "g string, o int, m int"), "g", "o", "m", 540).orderBy("o").collect()
    assert [(r.start, r.stop) for r in runs] == [(540, 550), (550, 555)]
