"""Physical plans: what reaches the scan."""

import re

import pytest

import __spark_entry__

D = "/root/testdata/sf0.001"


def _plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "pushed"),
    [
        ("node_search_scoped", r"EqualTo\(scope_id,0000"), ("delta_since_watermark", r"GreaterThanOrEqual\(created_at,"), ("recent_per_scope", r"GreaterThanOrEqual\(created_at,.*LessThan\(created_at,"),
        ("nearest_same_kind", r"IsNotNull\(embedding\)"), ("semantic_search_topk", r"IsNotNull\(embedding\)"), ("missing_embeddings", r"IsNull\(embedding\)"),
    ],
)
def test_filters_reach_the_scan(spark, name, pushed):
    plan = _plan(__spark_entry__.queries()[name](spark, D))
    filters = re.findall(r"PushedFilters: \[([^\n]*?)\], ReadSchema", plan)
    assert filters and any(re.search(pushed, f) for f in filters), filters


@pytest.mark.parametrize(("name", "unread"), [("recent_per_scope", "embedding"), ("unlinked_captures", "content"), ("tag_frequency", "content"), ("undirected_degree", "confidence")])
def test_columns_that_are_not_asked_for_are_not_read(spark, name, unread):
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*)", _plan(__spark_entry__.queries()[name](spark, D)))
    assert schemas and not any(f"{unread}:" in s for s in schemas)
