import os
import re

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = ["p1_found", "p1_terms", "p2_found", "p3_found", "p3_neighbors", "p5_found", "p5_report", "p5_sizes", "p6_checks", "p7_found", "p7_counts", "p7_lifts", "p8_checks", "p9_found"]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_nothing_else_imports_the_subpackage():
    root = os.path.join(os.path.dirname(__file__), "..", "..", "lumisift")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        text = f.read()
                    assert not re.search(r"^\s*(from|import)\s.*\bllm\b", text, re.M), n
