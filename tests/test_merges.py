"""Merges of nodes with disambiguation, updates from values, restores: small cases by hand."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from loamgraph.operators import records, search
from loamgraph.plans import backup
from loamgraph.sources import tables

NODE = "scope_id string, id string, name string, kind string, aliases array<string>, source_captured_ids array<string>"


def test_merge_goes_by_name_then_alias_then_vector(spark):
    old = spark.createDataFrame([("s", "1", "Ada", "person", ["AL"], ["c1"]), ("s", "2", "Berlin", "location", None, ["c2"]), ("t", "3", "Ada", "person", None, None), ("s", "4", "Far", None, None, None)], NODE)
    new = spark.createDataFrame([("s", "a", "ada ", "person", None, ["c9"]), ("s", "b", "al", "person", ["Lady"], ["c8"]), ("s", "c", "Spreeathen", "location", None, ["c7"]), ("s", "d", "Near far", "event", None, None), ("s", "e", "Spree", "person", None, None), ("s", "f", "New", "concept", None, ["c1"]), ("s", "g", "NEW", "concept", ["Neu"], ["c2"])], NODE.replace(" id string", " key string"))
    v = lambda *rows: spark.createDataFrame(list(rows), "id string, embedding array<float>")
    have = v(("2", [1.0, 0.0]), ("4", [0.0, 1.0]))
    asked = v(("c", [2.0, 0.1]), ("d", [0.1, 3.0]), ("e", [1.0, 0.0]), ("f", None)).withColumnRenamed("id", "key")
    got = {r["id"]: r for r in records.merged_nodes(old, new, (asked, have)).collect()}
    assert set(got) == {"1", "2", "3", "4", "e", "f"}
    assert got["1"]["aliases"] == ["AL", "Lady", "ada", "al"] or set(got["1"]["aliases"]) >= {"AL", "Lady"}
    assert set(got["1"]["source_captured_ids"]) == {"c1", "c8", "c9"} and set(got["2"]["source_captured_ids"]) == {"c2", "c7"}
    assert "Near far" in got["4"]["aliases"] and set(got["f"]["source_captured_ids"]) == {"c1", "c2"} and got["3"]["aliases"] == []
    assert "c" in {r["id"] for r in records.merged_nodes(old, new).collect()}


def test_nearest_match_in_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(3)
    make = lambda n, p: [(f"{p}{i:02d}", "k" if rng.random() < 0.7 else "m" if rng.random() < 0.5 else None, [float(x) for x in rng.normal(size=4)]) for i in range(n)]
    new, known = make(23, "n"), make(31, "o")
    new += [("zero", "k", [0.0] * 4), ("none", "k", None), ("short", "k", [1.0])]
    known += [("o99", "k", known[0][2])]
    cos = lambda a, b: float(np.round(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)), 6))
    df = lambda rows: spark.createDataFrame(rows, "id string, kind string, embedding array<double>").withColumn("scope", F.lit("s"))
    for keys, lenient in ((["scope", "kind"], None), (["scope"], "kind"), (["scope"], None)):
        want = {}
        for i, k, v in new:
            if v is None or len(v) != 4 or not any(v):
                continue
            ok = [(-cos(v, w), j) for j, m, w in known if (k == m and k is not None if "kind" in keys else lenient is None or k is None or m is None or k == m) and cos(v, w) > 0.3]
            if ok:
                want[i] = min(ok)[1]
        got = {r["new_id"]: r["known_id"] for r in search.nearest_match(df(new), df(known), keys, 0.3, lenient).collect()}
        assert got == want and want
    assert search.nearest_match(df(new).limit(0), df(known), ["scope"], 0.3).isEmpty()


def test_values_seeds_and_first_states(spark):
    df = spark.createDataFrame([("1", "a", 1), ("2", "b", 2), (None, "c", 3)], "id string, x string, _x int")
    values = spark.createDataFrame([("1", "z"), ("1", "y"), ("2", None), ("9", "q"), (None, "w")], "id string, x string")
    assert sorted(map(str, records.updated_from(df, values, "id", ["x"]).collect())) == sorted(map(str, spark.createDataFrame([("1", "y", 1), ("2", "b", 2), (None, "c", 3)], "id string, x string, _x int").collect()))
    nodes = spark.createDataFrame([("s", "1", "Ada"), ("s", "2", " ada"), ("s", "3", "Bo"), ("t", "4", "Bo"), ("t", "5", None)], "scope_id string, id string, name string")
    wanted = spark.createDataFrame([("ADA", "bo ", "r"), ("ada", "Bo", "r"), ("Bo", "Ada", "r"), ("x", "Bo", "r"), (None, "Bo", "r")], "source_name string, target_name string, relation_type string")
    links = spark.createDataFrame([("3", "1")], "source string, target string")
    assert [tuple(r) for r in records.seeded_links(links, nodes, wanted).collect()] == [("s", "1", "3", "r")]
    first = records.started(spark.createDataFrame([("1", None, "note", "", "  some long text of more than thirty characters"), ("2", None, "note", None, None)], "id string, user_id string, type string, title string, content string"), F.lit("2025-01-01").cast("timestamp"))
    assert [r["title"] for r in first.orderBy("id").collect()] == ["some long text of more than th", "Untitled"]


def test_restore_from_dump_is_idempotent(spark, tmp_path):
    t = {n: spark.createDataFrame([("1", "u"), ("2", "u"), ("3", None)], "id string, user_id string") for n in backup.TABLES}
    backup.dump({n: d.where("user_id = 'u'") for n, d in t.items()}, str(tmp_path / "d"))
    now = {n: d.where("id <> '2'").unionByName(spark.createDataFrame([("4", "u")], "id string, user_id string")) for n, d in t.items()}
    for _ in range(2):
        now = backup.restored_from_dump(now, str(tmp_path / "d"))
        assert all(sorted(r["id"] for r in d.collect()) == ["1", "2", "3"] for d in now.values())


def test_formats(spark, tmp_path):
    rows = [("1", None, "a,b\n\"q\"", ["x", "y,z"], datetime.datetime(2025, 1, 1)), ("2", "u", None, None, None)]
    df = spark.createDataFrame(rows, "id string, user_id string, name string, aliases array<string>, created_at timestamp")
    full = spark.createDataFrame([], tables.SCHEMAS["knowledge_nodes"]).unionByName(df, allowMissingColumns=True)
    full.write.orc(str(tmp_path / "orc"))
    tables.write_csv(full, str(tmp_path / "csv"))
    for source in ("orc", "csv"):
        got = sorted(map(str, tables.read_table(spark, str(tmp_path / source), "knowledge_nodes", source).collect()))
        assert got == sorted(map(str, full.collect())), source
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>Tom &amp; Jerry</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:p>y</w:p>")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = {r["path"][-6:]: r["text"] for r in tables.read_documents(spark, str(tmp_path) + "/*.docx").collect()}
    assert got == {"a.docx": "Tom & Jerry\tx\ny\n", "b.docx": ""}
