"""Streams over files, run to the end of what is there."""

import datetime
import time

from pyspark.sql import functions as F

from loamgraph.streaming.changes import SnapshotMerge, change_stream, matched, rate_windows, reconcile, sessions


def test_snapshot_merge(spark, tmp_path):
    schema = "id string, v int, created_at timestamp"
    at = datetime.datetime(2025, 1, 1)

    def arrive(n, rows):
        spark.createDataFrame([(i, v, at + datetime.timedelta(minutes=10 * n)) for i, v in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    m = SnapshotMerge(spark, str(tmp_path / "snap"))
    assert m.read() is None
    arrive(1, [("a", 1), ("b", 2), ("b", 2)])
    stream = change_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    m.start(stream, str(tmp_path / "cp")).awaitTermination(120)
    assert {r["id"]: r["v"] for r in m.read().collect()} == {"a": 1, "b": 2}
    arrive(2, [("b", 3), ("c", 4)])
    m.start(stream, str(tmp_path / "cp")).awaitTermination(120)
    assert {r["id"]: r["v"] for r in m.read().collect()} == {"a": 1, "b": 3, "c": 4}
    # a batch that was done already changes nothing
    m.apply(spark.createDataFrame([("a", 99, at)], schema), 0)
    assert {r["id"]: r["v"] for r in m.read().collect()}["a"] == 1
    reconcile(spark, m, spark.createDataFrame([("c", 5, at)], schema), 50)
    assert [(r["id"], r["v"]) for r in m.read().collect()] == [("c", 5)]


def test_rate_windows(spark, tmp_path):
    rows = [("k", datetime.datetime(2025, 1, 1, 0, 0, s)) for s in (1, 2, 3)] + [("k", datetime.datetime(2025, 1, 1, 0, 1, 1))]
    spark.createDataFrame(rows, "key string, at timestamp").write.parquet(str(tmp_path / "in"))
    s = rate_windows(spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "in")), "key", "at", 60, 2)
    s.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r["n"], r["over"]) for r in spark.table("rates").select("n", "over").collect()) == [(1, False), (3, True)]
    assert spark.table("rates").agg(F.count("*")).head()[0] == 2


def test_watched(spark, tmp_path):
    from loamgraph.streaming.changes import watched

    rows = [("a", "processing", 1), ("a", "completed", 2), ("b", "processing", 1), ("c", "failed", 1)]
    spark.createDataFrame(rows, "id string, state string, at int").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        s = watched(spark.readStream.schema("id string, state string, at int").parquet(str(tmp_path / "in")))
        q = s.writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        for _ in range(240):  # timers keep such a query from ending by itself
            if spark.table("settled").count() >= 2:
                break
            time.sleep(0.5)
        q.stop()
        assert sorted(map(tuple, spark.table("settled").collect())) == [("a", "completed"), ("c", "failed")]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_late_rows_and_later_states_are_merged(spark, tmp_path):
    schema = "id string, processing_status string, created_at timestamp, processed_at timestamp"
    day = lambda n: datetime.datetime(2025, 1, n)
    m = SnapshotMerge(spark, str(tmp_path / "snap"))
    (tmp_path / "in").mkdir()
    stream = change_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    for rows in (
        [("new", "pending", day(30), None), ("a", "processing", day(29), None), ("a", "completed", day(29), day(30))],
        [("new", "completed", day(30), day(31)), ("weeks", "pending", day(2), None), ("a", "failed", day(29), day(29))],
        [("weeks", "completed", day(2), day(31)), ("weeks", "completed", day(2), day(31)), ("old", "pending", day(1), None)],
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        m.start(stream, str(tmp_path / "cp")).awaitTermination(120)
    got = {r["id"]: (r["processing_status"], r["processed_at"]) for r in m.read().collect()}
    assert got == {"new": ("completed", day(31)), "a": ("completed", day(30)), "weeks": ("completed", day(31)), "old": ("pending", None)}


def test_batches_after_a_reload_go_on(spark, tmp_path):
    schema = "id string, v int, created_at timestamp"
    at = datetime.datetime(2025, 1, 1)
    m = SnapshotMerge(spark, str(tmp_path / "snap"), buckets=3)
    (tmp_path / "in").mkdir()
    stream = change_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)

    def arrive(*rows):
        spark.createDataFrame([(i, v, at) for i, v in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        m.start(stream, str(tmp_path / "cp")).awaitTermination(120)
        return {r["id"]: r["v"] for r in m.read().collect()}

    assert arrive(("a", 1), ("b", 1), (None, 7)) == {"a": 1, "b": 1}
    for k in range(1, 3):
        m.reconcile(spark.createDataFrame([("b", 5, at), ("b", 5, at), (None, 1, at)], schema))
        assert arrive((f"c{k}", k)) == {"b": 5, f"c{k}": k}
    # a run that dies before its manifest leaves the snapshot as it was
    write, m.table._clean = m.table.write, lambda: None
    fs, _ = m.table._fs()
    m.apply(spark.createDataFrame([("d", 9, at)], schema), 100)
    last = m.table.state()
    fs.delete(m.table._fs()[1](str(tmp_path / "snap" / f"manifest-{last['version']}.json")), False)
    assert {r["id"] for r in m.read().collect()} == {"b", "c2"} and write is not None


def test_a_batch_writes_only_the_buckets_it_touches_and_may_bring_a_column(spark, tmp_path):
    m = SnapshotMerge(spark, str(tmp_path / "snap"), buckets=8)
    m.apply(spark.createDataFrame([(f"k{i}", i) for i in range(60)], "id string, v int"), 0)
    m.apply(spark.createDataFrame([("k7", 70, "x")], "id string, v int, more string"), 1)
    state = m.table.state()
    assert sum(v == state["version"] for v in state["at"].values()) == 1
    rows = {r["id"]: (r["v"], r["more"]) for r in m.read().collect()}
    assert len(rows) == 60 and rows["k7"] == (70, "x") and rows["k8"] == (8, None)


def test_sessions_and_matches(spark, tmp_path):
    t = lambda m: datetime.datetime(2025, 1, 1, 0, m)
    spark.createDataFrame([("k", t(0)), ("k", t(2)), ("k", t(20)), ("j", t(1))], "key string, at timestamp").write.parquet(str(tmp_path / "l"))
    spark.createDataFrame([("k", t(5)), ("k", t(40)), ("j", t(0))], "key string, at timestamp").write.parquet(str(tmp_path / "r"))
    read = lambda side: spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / side))
    sessions(read("l"), "key", "at", "10 minutes").writeStream.format("memory").queryName("runs").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r["key"], r["n"]) for r in spark.table("runs").collect()) == [("j", 1), ("k", 1), ("k", 2)]
    matched(read("l"), read("r"), "key", "at").writeStream.format("memory").queryName("both").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("both").collect()) == [("k", t(0), t(5)), ("k", t(2), t(5))]
