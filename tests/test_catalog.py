"""Registered queries against their check SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from depfleet.sources.tables import BASE_TABLES
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
# those that need no whole analysis; tools/check.py runs them all
QUICK = ("f01_simple_digraph", "f01_vertices", "f03_degrees", "f04_adjacency", "f05_closure", "h01_node_diff", "h02_edge_diff",
         "h03_file_diff", "a03_validation_issues", "a04_file_table", "b05_b06_names", "b08_category", "b14_common_root",
         "c01_to_c10_imports", "c12_routes", "c14_spring_routes", "c17_compose", "c18_kubernetes", "c27_brace_blocks",
         "e01_merge_nodes", "e02_dedupe_edges", "e06_inventory", "k01_edge_filter", "k02_evidence_list", "k15_edge_accuracy")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


SQL = entry.oracle_sql()


def test_every_check_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cur = db.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["graph_id", "node_id", "blast_radius", "footprint"]
