"""Scans, merges, references, ranking, backup."""

import random

import pytest
from pyspark.sql import functions as F

from loamgraph import schemas
from loamgraph.operators import extraction, evaluation, layout, ranking, records, references, search, trends
from loamgraph.plans import backup, ingest, summary
from loamgraph.providers import EchoAnswerer, HashEmbedder, embedded


def test_latest_keeps_extra_columns(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "id string, v int, _rn string")
    assert [tuple(r) for r in records.latest(df, "id", F.col("v").desc()).collect()] == [("a", 2, "y")]


def test_merge_snapshot(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    assert sorted(map(tuple, records.merge_snapshot(old, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, records.merge_snapshot(old, new.limit(0)).collect())) == [("a", 1), ("b", 2)]


def test_keyed_changes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    ids = spark.createDataFrame([("b",), ("ghost",)], "id string")
    assert sorted(map(tuple, records.update_where(df, ids, "id", {"v": F.lit(9)}).collect())) == [("a", 1), ("b", 9)]
    assert [tuple(r) for r in records.delete_where(df, ids, "id").collect()] == [("a", 1)]
    rows = spark.createDataFrame([("b", 5), ("c", 6), ("c", 6)], "id string, v int")
    assert [tuple(r) for r in records.insert_ignoring(df, rows, ["id"]).collect()] == [("c", 6)]
    assert sorted(map(tuple, records.replace_by_key(df, rows.distinct(), ["id"]).collect())) == [("a", 1), ("b", 5), ("c", 6)]


def test_references_removed_and_repaired(spark):
    n = spark.createDataFrame([("n1", ["c1", "C2", "c3"]), ("n2", ["c1"]), ("n3", None), ("n4", [])], "id string, source_captured_ids array<string>")
    gone = spark.createDataFrame([("c2",), ("c9",), (None,)], "id string")
    got = {r["id"]: r["source_captured_ids"] for r in records.without_refs(n, "source_captured_ids", gone).collect()}
    assert got == {"n1": ["c1", "c3"], "n2": ["c1"], "n3": None, "n4": []}
    have = spark.createDataFrame([("c1",), ("c2",)], "id string")
    assert [tuple(r) for r in records.existing_refs(n, "source_captured_ids", have).collect()] == [("n1", ["c1", "C2"], 1)]


def test_alias_matches(spark):
    nodes = spark.createDataFrame([("s", "n1", "Deep Work", ["focus"]), ("s", "n2", "Focus", None), ("t", "n3", "Deep work", None)], "scope_id string, id string, name string, aliases array<string>")
    asked = spark.createDataFrame([("s", "k1", "deep, work!", None), ("s", "k2", "focus", []), ("s", "k3", "unknown", ["DEEP WORK"]), ("s", "k4", "none", None), ("s", "k5", "", None)], "scope_id string, key string, name string, aliases array<string>")
    assert {r["key"]: r["node_id"] for r in records.alias_matches(asked, nodes).collect()} == {"k1": "n1", "k2": "n2", "k3": "n1"}


def test_merged_links(spark):
    rows = [("u", "A", "b", None, ["c1", " c1"], 0.5), ("u", "a", "B", "related_to", ["c2", ""], 0.7), ("u", "a", "a", "causes", None, None), (None, "a", "b", "causes", None, None), ("u", None, "b", "causes", None, None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "user_id string, source string, target string, relation_type string, evidence_captured_ids array<string>, confidence double, created_at timestamp, updated_at timestamp")
    got = {(r["scope_id"], r["relation_type"]): (r["evidence"], r["confidence"], r["n_rows"]) for r in records.merged_links(df).collect()}
    assert got == {("u", "related_to"): (["c1", "c2"], 0.7, 2), (records.ZERO_SCOPE, "causes"): ([], None, 1)}


@pytest.mark.parametrize("limits", [{}, {"range_keys": 3, "task_refs": 4}])
def test_orphans_against_brute_force(spark, limits):
    rng = random.Random(5)
    ids = [f"{rng.getrandbits(32):08x}" for _ in range(40)]
    have = [i.upper() if k % 7 == 0 else i for k, i in enumerate(ids[:25])] + [None, ids[0]]
    # one key holds a third of all references
    refs = [("hot" if k % 3 == 0 else rng.choice([*ids, "", None, "Ünï-" + ids[3]])) for k in range(200)]
    child = spark.createDataFrame([(f"r{k % 90}", [x], None) for k, x in enumerate(refs)] + [("e", [], None), ("n", None, None)], "id string, refs array<string>, created_at timestamp")
    parents = spark.createDataFrame([("p", x) for x in have], "parent string, key string")
    got = references.orphan_references(references.references(child, "child.refs", "id", "refs", "created_at", "p"), parents, **limits)
    known = {x.lower() for x in have if x}
    want = {("child.refs", f"r{k % 90}", x) for k, x in enumerate(refs) if x and x.lower() not in known}
    rows = [tuple(r)[:3] for r in got.collect()]
    assert sorted(rows) == sorted(want)
    none = references.orphan_references(references.references(child, "child.refs", "id", "refs", "created_at", "p"), parents.limit(0), **limits)
    assert none.count() == len({(f"r{k % 90}", x) for k, x in enumerate(refs) if x})
    assert references.orphan_references(references.references(child.limit(0), "child.refs", "id", "refs", "created_at", "p"), parents, **limits).isEmpty()
    assert references.orphan_report(got).agg(F.sum("n_orphans")).head()[0] == len(want)


def test_vector_search_and_pairs(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("d", None), ("e", [0.0, 0.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    assert [r["id"] for r in search.vector_search(df, q, 5, 0.3).collect()] == ["a", "b"]
    rows = [("s", "a", ["x"], [1.0, 0.0]), ("s", "b", ["X"], [1.0, 0.01]), ("s", "c", None, [1.0, 0.02]), ("t", "d", None, [1.0, 0.0])]
    p = spark.createDataFrame([(*r[:3], None, r[3]) for r in rows], "s string, id string, tags array<string>, created_at timestamp, embedding array<float>")
    got = {(r["id_a"], r["id_b"]) for r in search.similar_pairs(p, ["s"]).collect()}
    assert got == {("a", "c"), ("b", "c")}
    assert len(search.similar_pairs(p, ["s"], exclude_shared_tags=False).collect()) == 3


def test_picked_and_varied(spark):
    rows = [("g", "a", "x", 0.9, 1), ("g", "b", "x", 0.8, 1), ("g", "c", "x", 0.7, 1), ("g", "d", "y", 0.1, 2), ("g", "d", "y", 0.05, 2)]
    df = spark.createDataFrame(rows, "grp string, id string, type string, score double, pos int")
    assert [r["id"] for r in ranking.picked(df, most=3).orderBy("place").collect()] == ["a", "d", "b"]
    v = spark.createDataFrame([("g", "1", "m", "c", 0.9), ("g", "2", "m2", "c", 0.8), ("g", "3", "m3", "c", 0.7), ("g", "4", "m3", "e", 0.6), ("g", "5", "m", "e", 0.5)], "grp string, id string, mid string, first string, score double")
    assert sorted(r["id"] for r in ranking.varied(v).collect()) == ["1", "2", "4"]


def test_extraction(spark):
    answer = '{"nodes": [{"id": "a", "name": "深度工作", "kind": "Person"}, {"name": "专注力训练", "kind": "odd"}, {"name": "今天"}], "links": [{"source": "a", "target": "n1", "type": "x"}, {"source": "a", "target": "a"}, {"source": "a", "target": "zz"}]}'
    df = spark.createDataFrame([("c", f"```json\n{answer}```"), ("d", "no"), ("e", None)], "capture_id string, answer string")
    g = extraction.parsed_graphs(df)
    n = extraction.extracted_nodes(g)
    assert [tuple(r)[:4] for r in n.orderBy("key").collect()] == [("c", "a", "深度工作", "person"), ("c", "n1", "专注力训练", "concept")]
    assert [tuple(r) for r in extraction.extracted_links(g, n).collect()] == [("c", "a", "n1", "related_to")]


def test_ingest_is_idempotent(spark):
    answer = '{"nodes": [{"id": "a", "name": "Deep work", "kind": "concept"}, {"id": "b", "name": "Focus time"}], "links": [{"source": "a", "target": "b", "type": "supports"}]}'
    caps = spark.createDataFrame([("c1", "s", "text")], "id string, scope_id string, content string")
    nodes = spark.createDataFrame([("s", "n1", "deep work", "view", None, ["c0"])], "scope_id string, id string, name string, kind string, aliases array<string>, source_captured_ids array<string>")
    links = spark.createDataFrame([], schemas.LINKS)
    merged, edges, status = ingest.ingested(caps, nodes, links, EchoAnswerer(lambda p: answer))
    got = {r["id"]: r for r in merged.collect()}
    assert set(got) == {"n1", "c1:b"} and got["n1"]["source_captured_ids"] == ["c0", "c1"] and got["n1"]["kind"] == "concept"
    assert [(r["source"], r["target"], r["relation_type"], r["evidence"]) for r in edges.collect()] == [("n1", "c1:b", "supports", ["c1"])]
    assert [tuple(r) for r in status.collect()] == [("c1", "completed", None)]
    again, _, _ = ingest.ingested(caps, merged, links, EchoAnswerer(lambda p: answer))
    assert {r["id"]: (r["source_captured_ids"], r["kind"]) for r in again.collect()} == {k: (r["source_captured_ids"], r["kind"]) for k, r in got.items()}


def test_providers(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "id string, t string")
    assert [len(r["embedding"]) for r in embedded(df, "t", HashEmbedder(8)).collect()] == [8, 8]

    class Broken:
        dim = 3

        def embed(self, texts):
            raise OSError("down")

    got = embedded(df, "t", Broken(), attempts=2, wait=0).collect()
    assert all(r["embedding"] is None and "down" in r["error"] for r in got)


def test_backup_round_trip(spark, tmp_path):
    cap = spark.createDataFrame([("c1", "u", "note", "T", "# body", None, ["t"], None, True, None, [1.0], "completed", None, None, None, None, None, None, None, 5)], schemas.CAPTURES)
    tables = {"captured_info": cap, "knowledge_nodes": spark.createDataFrame([], schemas.NODES), "knowledge_links": spark.createDataFrame([], schemas.LINKS)}
    assert backup.dump(tables, str(tmp_path / "dump")) == {"captured_info": 1, "knowledge_nodes": 0, "knowledge_links": 0}
    assert all(r["expected"] == r["found"] for r in backup.verified(spark, str(tmp_path / "dump")).collect())
    new, report = backup.restored(tables, backup.read_dump(spark, str(tmp_path / "dump")), "v")
    assert {r["name"]: (r["inserted"], r["skipped"]) for r in report.collect()}["captured_info"] == (0, 1)
    empty = {n: t.limit(0) for n, t in tables.items()}
    new, _ = backup.restored(empty, backup.read_dump(spark, str(tmp_path / "dump")), "v")
    row = new["captured_info"].head()
    assert row["user_id"] == "v" and row["embedding"] is None
    assert '"version":1' in backup.document(tables, "2025-01-01").head()[0]
    assert "\n\n\\# body" in backup.markdown(cap).head()["value"]
    assert backup.wiped(tables, "u")["captured_info"].isEmpty()


def test_summary_of_little(spark):
    cap = spark.createDataFrame([], schemas.CAPTURES)
    s = summary.summarize(cap, spark.createDataFrame([], schemas.NODES), spark.createDataFrame([], schemas.LINKS), F.lit("2025-01-01").cast("timestamp"))
    assert s.enough is False and s.themes.isEmpty() and s.changes.count() == 3


def test_quality_and_layout(spark):
    e = spark.createDataFrame([("q-1", "睡眠债", True), ("q-1", "今天", False), ("r-1", "阅读", True)], "case_id string, name string, wanted boolean")
    f = spark.createDataFrame([("q-1", "睡眠"), ("q-1", "今天")], "case_id string, name string")
    q = evaluation.extraction_quality(e, f)
    assert {r["case_id"]: tuple(r)[1:] for r in q.collect()} == {"q-1": (1, 1, 1, 2), "r-1": (1, 0, 0, 0)}
    assert {r["category"]: (r["passed"], r["partial"], r["failed"]) for r in evaluation.verdicts(q).collect()} == {"q": (0, 1, 0), "r": (0, 0, 1)}
    n = spark.createDataFrame([("v", f"t{i}") for i in range(12)], "view string, id string")
    l = spark.createDataFrame([("v", "t0", "t1"), ("v", "t1", "t2")], "view string, a string, b string")  # noqa: E741
    p = layout.force_layout(n, l)
    assert layout.layout_quality(p, width=5000, height=5000).head()["overlaps"] == 0
    assert sorted(p.collect()) == sorted(layout.force_layout(n, l).collect())


def test_trends(spark):
    day = lambda n: f"2025-01-{n:02d} 12:00:00"
    rows = [("a", ["x", "x2"], day(30)), ("b", ["x", " ", None], day(29)), ("c", ["y"], day(20)), ("d", ["y"], day(19)), ("e", None, day(29)), ("f", ["x"], None)]
    df = spark.createDataFrame(rows, "id string, tags array<string>, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    asof = F.lit("2025-01-31 00:00:00").cast("timestamp")
    got = {r["name"]: r["direction"] for r in trends.theme_directions(df, asof, 7, None).collect()}
    assert got == {"x": "new", "y": "down"}
    weeks = {r["week"]: (r["n"], r["top_tags"]) for r in trends.weekly_timeline(df, asof).collect()}
    assert weeks == {0: (3, "x(2), x2(1)"), 1: (2, "y(2)")}
    assert {r["tag"]: r["n"] for r in trends.tag_frequency(df, blanks=True).collect()}[" "] == 1
