"""The registry, with and without the subpackage for training data."""

import os
import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_registry():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and {"p1_found", "p5_found", "lint_summary"} <= set(names)


def test_nothing_else_imports_llm():
    root = os.path.join(os.path.dirname(entry.__file__), "blockloom")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"(import|from)\s[^\n]*\bllm\b", open(os.path.join(folder, f)).read())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["p1_found", "p5_found", "lint_findings", "diff_findings", "anchors", "stamped", "perturb_merge"])
def test_against_sql(spark, name):
    import glob

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    want = con.sql(entry.oracle_sql()[name])
    order = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())
