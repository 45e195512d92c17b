import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["bm25_topk", "build_vocab", "score_grouping_sets", "asof_purchase_before_error", "merge_ranges", "contacts", "rrf", "knn_cosine", "parse_decision", "stats_zero_filled"]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = pd.DataFrame([r.asDict() for r in entry.queries()[name](spark, SF).collect()], columns=sorted(want.columns))
    key = lambda df: sorted(map(repr, df[sorted(want.columns)].astype(object).where(df[sorted(want.columns)].notna(), None).map(lambda x: x if not hasattr(x, "item") else x.item()).map(lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x).itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_import_without_the_llm_parts(tmp_path):
    """The entry module works where the subpackage and the pipeline are deleted."""
    root = Path(entry.__file__).parent
    for path in root.rglob("*.py"):
        part = path.relative_to(root)
        if "llm" in part.parts or part.name == "corpus_pipeline.py" or part.parts[0] == "tests":
            continue
        (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / part).write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op1') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
