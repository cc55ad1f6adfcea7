import os

import duckdb
import pytest

from lumisift.plans import checks  # noqa: F401
from lumisift.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = ["scan_stats", "path_order", "graph_audit", "backups", "cluster_numbering", "box_normalize", "features_people", "distribution", "tag_conflicts", "caption_join", "dag_reduction", "p4_found", "p4_descendants", "candidate_sources", "event_stats_fold", "review_latest", "audit_view", "stored_denylist",
         "stored_tags", "training_names", "event_sources", "retry_outcomes", "box_answers", "selection_report", "caption_removals", "override_relations", "compiled_rules", "review_merge", "validated_rules", "select_greedy"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    def plain(v):
        return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v

    df = Q.QUERIES[name](spark, SF)
    want = duck.sql(Q.ORACLE[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(repr(plain(tuple(r))) for r in df.collect()) == sorted(repr(tuple(plain(r[k]) for k in at)) for r in want.fetchall())


def test_every_query_of_sql_exists():
    assert set(Q.ORACLE) <= set(Q.QUERIES) and len(Q.QUERIES) > 60
