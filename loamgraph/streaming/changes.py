"""Structured Streaming forms of the change feed: keyed merge, watch list, timeouts, rate windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loamgraph.runtime import cut, free_name
from loamgraph.sources.buckets import BucketedTable

#: What tells the last state of a record, as in :func:`loamgraph.sources.tables.captures`.
LAST = ("processed_at", "processing_status", "embedding_status", "graph_status")


def change_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Files of changes as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class SnapshotMerge:
    """A keyed snapshot kept up by micro-batches, in hash buckets of which a batch writes those that it touches.

    The manifest of each version holds the number of the last batch; a batch that comes again after a failure finds it and does
    nothing. Versions count by themselves, so a reload between batches is no batch.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", keep: int = 2, buckets: int = 16):
        self.spark, self.key = spark, key
        self.table = BucketedTable(spark, path, key, buckets, keep)

    def read(self) -> DataFrame | None:
        return self.table.read()

    def _last(self, rows: DataFrame, src: str | None = None) -> DataFrame:
        """The last state of each key: the latest ``processed_at``, then the least status, then ``src``, then the newer ``created_at``."""
        rn = free_name(rows, "_rn")
        late = [F.col(c).desc_nulls_last() if c.endswith("_at") else F.col(c) for c in (*LAST, src, "created_at") if c in rows.columns]
        rest = F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind])
        return rows.withColumn(rn, F.row_number().over(Window.partitionBy(self.key).orderBy(*late, rest))).where(F.col(rn) == 1).drop(rn)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: of the snapshot's row and the batch's rows of a key the last state stays.

        Last is the latest ``processed_at``, then the least status, as the readers of the tables have it; where these are equal or not
        there, the batch's row wins over the snapshot's and the newer ``created_at`` within the batch. Rows without a key go.
        """
        state = self.table.state()
        if state is not None and state["tag"] >= batch_id:
            return
        batch = cut(batch.where(F.col(self.key).isNotNull()))
        hit = self.table.touched(batch)
        old = self.table.read(hit)
        src = free_name(batch if old is None else old.limit(0).unionByName(batch.limit(0), allowMissingColumns=True), "_src")
        both = batch.withColumn(src, F.lit(0))
        if old is not None:
            both = old.withColumn(src, F.lit(1)).unionByName(both, allowMissingColumns=True)
        self.table.write(self._last(both, src).drop(src), hit, batch_id)

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run over what is there now (and once more whenever called); every row is merged, however late, and repeats change nothing."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def reconcile(self, full: DataFrame) -> None:
        """The snapshot replaced by a full reload, which drops rows deleted at the source; later batches go on as before."""
        state = self.table.state()
        self.table.write(self._last(full.where(F.col(self.key).isNotNull())), None, -1 if state is None else state["tag"])


def reconcile(spark: SparkSession, merge: SnapshotMerge, full: DataFrame, batch_id: int | None = None) -> None:
    """:meth:`SnapshotMerge.reconcile`; batch_id is still taken from callers and has no bearing on the result."""
    merge.reconcile(full)


class Watch(StatefulProcessor):
    """Per record: remembered while unsettled; comes out once, with its state, when it settles or has shown no progress in time."""

    OUT = T.StructType([T.StructField("id", T.StringType()), T.StructField("state", T.StringType())])

    def __init__(self, timeout_ms: int = 180_000):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", T.StructType([T.StructField("state", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in rows:
            pdf = pdf.sort_values("at")
            state = pdf["state"].iloc[-1]
        if state in ("completed", "failed"):
            if self.open.exists():
                self.open.clear()
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
            yield pd.DataFrame({"id": [key[0]], "state": [state]})
        elif state is not None:
            self.open.update((state,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            self.open.clear()
            yield pd.DataFrame({"id": [key[0]], "state": ["failed"]})

    def close(self) -> None:
        pass


def watched(changes: DataFrame, timeout_ms: int = 180_000) -> DataFrame:
    """``(id, state)`` of records of ``changes (id, state, at)`` as they settle; needs the RocksDB state store."""
    return changes.groupBy("id").transformWithStateInPandas(statefulProcessor=Watch(timeout_ms), outputStructType=Watch.OUT, outputMode="Append", timeMode="ProcessingTime")


def rate_windows(events: DataFrame, key: str, at: str, seconds: int, limit: int, late: str = "1 hour") -> DataFrame:
    """``(key, window_start, n, over)`` of fixed windows aligned to the epoch; state older than ``late`` is dropped."""
    w = events.withWatermark(at, late).groupBy(F.window(at, f"{seconds} seconds").alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("over"))


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``(key, start, end, n)`` of runs of events without a longer gap."""
    s = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def matched(left: DataFrame, right: DataFrame, key: str, at: str, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``(key, left_at, right_at)``: events of two streams with the same key, the right one at most ``within`` after the left.

    Both sides drop state older than the watermark allows; a pair comes out once.
    """
    x = left.withWatermark(at, late).select(F.col(key), F.col(at).alias("left_at"))
    y = right.withWatermark(at, late).select(F.col(key).alias("_key"), F.col(at).alias("right_at"))
    near = (F.col("right_at") >= F.col("left_at")) & (F.col("right_at") <= F.col("left_at") + F.expr(f"INTERVAL {within}"))
    return x.join(y, (F.col(key) == F.col("_key")) & near).select(key, "left_at", "right_at")
