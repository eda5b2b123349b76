"""Recommendations: the keyword signal against plain Python."""

import datetime
import math
import re

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import retrieval
from loamgraph.plans import recommend

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda " * 6


def words(text):
    han = re.findall("[一-鿿]", text)
    return [x for i, h in enumerate(han) for x in [h, *(["".join(han[i : i + 2])] if i + 1 < len(han) else [])]] + re.findall("[a-z][a-z0-9-]+", text.lower())


def brute(query, docs):
    cut_up = [words(d) for d in docs]
    mean, score = sum(map(len, cut_up)) / len(cut_up), 0.0
    for q in set(words(query)):
        df = sum(q in d for d in cut_up)
        idf = math.log(1 + (len(cut_up) - df + 0.5) / (df + 0.5))
        score += sum(idf * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for d in cut_up if q in d)
    return min(1.0, score / 50)


def test_keyword_signal_counts(spark):
    asof, at = F.lit("2025-01-10 00:00:00").cast("timestamp"), datetime.datetime(2025, 1, 9)
    texts = {
        "u": [("c1", "读书笔记 reading", "知识图谱的构建方法 graph notes", ["图谱"]), ("c2", "图谱 graph theory", LONG + "unique-tail word", ["图谱"]), ("c3", "", "一些别的内容 graph reading notes and more", None)],
        "v": [("d1", "graph", "one long summary about nothing in particular", ["图谱"]), ("d2", "graph reading", "again a long summary on the same thing", ["图谱"])],
    }
    rows = [(g, i, title, summary, f"content of {i} 知识 graph, said at some length", tags, at - datetime.timedelta(hours=k)) for g, cs in texts.items() for k, (i, title, summary, tags) in enumerate(cs)]
    caps = spark.createDataFrame(rows, "scope_id string, id string, title string, summary string, content string, tags array<string>, created_at timestamp")
    nodes = spark.createDataFrame([], "id string, scope_id string, name string, source_captured_ids array<string>")
    got = {(r["grp"], r["id"]): r for r in recommend.recommend(caps, nodes, None, asof, most=99).collect()}
    assert {k for _, k in got} >= {"review-c1", "related-c1-c2", "forming-图谱", "related-d1-d2"}
    sound = {r["id"] for r in recommend.signal_captures(caps).collect()}
    for (g, i), r in got.items():
        docs = [" ".join(x[2:5]) for x in rows if x[0] == g and x[1] in sound]
        of = {c[0]: c for c in texts[g]}
        kind, *parts = i.split("-")
        asked = {"review": lambda: " ".join(of[parts[0]][1:3]), "related": lambda: " ".join(of[p][1] for p in parts), "forming": lambda: parts[0]}[kind]()
        keyword = brute(asked, docs)
        assert (i, r["keyword"]) == (i, pytest.approx(keyword, abs=1e-8))
        assert r["score"] == pytest.approx(0.3 * keyword + 0.3 * r["base"], abs=1e-8)
    assert got["u", "review-c2"]["keyword"] > 0


def _caps(spark, scopes: int, each: int):
    at = datetime.datetime(2025, 1, 9)
    rows = [(f"s{s}", f"s{s}c{k}", f"note {k} graph", f"summary of {s}, said at some length {k}", f"知识 {s} content {k}", ["图谱"], at - datetime.timedelta(hours=k)) for s in range(scopes) for k in range(each)]
    return spark.createDataFrame(rows, "scope_id string, id string, title string, summary string, content string, tags array<string>, created_at timestamp")


def test_terms_are_not_shuffled(spark):
    asof = F.lit("2025-01-10 00:00:00").cast("timestamp")
    nodes = spark.createDataFrame([], "id string, scope_id string, name string, source_captured_ids array<string>")
    plan = recommend.recommend(_caps(spark, 3, 5), nodes, None, asof)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and not any(re.search(r"\bterm#", k) for k in keys), keys


def test_sources_of_nodes_are_not_sent_to_the_driver(spark):
    nodes = spark.createDataFrame([("n1", "s0", "graph", ["S0C1", "", None])], "id string, scope_id string, name string, source_captured_ids array<string>")
    got = recommend.review(recommend.signal_captures(_caps(spark, 1, 3)), nodes)
    assert {r["id"] for r in got.collect()} == {"review-s0c0", "review-s0c2"}
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_scores_of_groups_that_batches_cut(spark):
    docs = [(g, f"{g} graph 知识图谱 " + "word " * k) for g in ("a", "b", "c", "d") for k in range(5)] + [(None, "graph"), ("e", ""), ("f", None)]
    asks = [(g, i, t) for g in ("a", "b", "c", "d", "e", "f", "g", None) for i, t in enumerate(("graph graph 图谱", "word b", "", None, "nothing-here"))]
    d, q = spark.createDataFrame(docs, "grp string, text string"), spark.createDataFrame(asks, "grp string, i int, q_text string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        got = []
        for n in (1, 4, 10_000):
            spark.conf.set(key, n)
            got.append({(r["grp"], r["i"]): r["bm25"] for r in retrieval.bm25_within(d, q).collect()})
    finally:
        spark.conf.set(key, before)
    for g, i, t in asks:
        own = [x or "" for h, x in docs if h == g and g is not None]
        score = 50 * brute(t or "", own) if any(own) else 0.0
        assert [(g, i, x[g, i]) for x in got] == [(g, i, pytest.approx(score, abs=1e-9))] * 3
    assert all(len(x) == len(asks) for x in got)
