"""The driver contract on the smallest data, and the independence of the rest from the subpackage of training-data operators."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "title", "similarity", "tier"] and df.count() >= 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p6_found", "period_activity_change", "tag_frequency", "unlinked_captures", "undirected_degree", "cross_topic_edges", "link_merge_upsert"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(D)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    df = entry.queries()[name](spark, D)
    rel = con.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in rel.description].index(c) for c in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    code = (
        "import importlib.util, sys; real = importlib.util.find_spec;"
        "importlib.util.find_spec = lambda n, *a: None if n.startswith('loamgraph.llm') else real(n, *a);"
        "import __spark_entry__ as e; q = e.queries(); assert 'p6_found' in q and 'p1_found' not in q; e.oracle_sql();"
        "assert not [m for m in sys.modules if m.startswith('loamgraph.llm')]"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
