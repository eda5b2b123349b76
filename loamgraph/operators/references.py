"""References to records that do not exist.

Parents are range-partitioned by key and held as one sorted array per range; every batch of references of that
range is probed by vectorised binary search, and only the misses leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from loamgraph.runtime import broadcast_if, cut, parallelism

#: Parents in a range and references in a task, at most about.
RANGE_KEYS = 40_000
TASK_REFS = 40_000
#: Partitions for each core at most; beyond them a partition holds several groups, which its task takes one by one.
TASKS_A_CORE = 64
MISS_SCHEMA = T.StructType(
    [
        T.StructField("ref_field", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("ref_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def references(df: DataFrame, ref_field: str, record_id: str, refs: str, created_at: str, parent: str) -> DataFrame:
    """Rows ``(parent, ref_field, record_id, ref_id, created_at)`` of a scalar or array reference column.

    Null and empty references are none; a null or empty array gives no rows.
    """
    kind = df.schema[refs].dataType
    value = F.explode(F.col(refs)) if isinstance(kind, T.ArrayType) else F.col(refs)
    return df.select(
        F.lit(parent).alias("parent"),
        F.lit(ref_field).alias("ref_field"),
        F.lower(F.col(record_id)).alias("record_id"),
        value.alias("ref_id"),
        F.col(created_at).cast("timestamp").alias("created_at"),
    ).where(F.col("ref_id").isNotNull() & (F.col("ref_id") != ""))


def orphan_references(refs: DataFrame, parents: DataFrame, range_keys: int = RANGE_KEYS, task_refs: int = TASK_REFS) -> DataFrame:
    """References without a parent row.

    refs: as made by :func:`references`; parents: ``(parent, key)``, repeats and nulls allowed.
    Keys are compared without letter case; ``ref_id`` comes out as stored, one row for each distinct
    ``(ref_field, record_id, ref_id)`` with the earliest ``created_at``.

    The space of 64-bit key hashes is cut into equal ranges, so every range holds about ``range_keys`` parents however
    the keys are spelled; equal hashes are told apart by the keys themselves. A range with
    more than ``task_refs`` references (a hot key, say) is dealt out to several tasks by a hash of the referring
    record; its parents' array goes to each of them. Without parents every reference is an orphan; without references
    the result is empty.
    """
    spark = refs.sparkSession
    keys = parents.where(F.col("key").isNotNull()).select("parent", F.lower("key").alias("key"))
    n_parents = keys.count()
    n_ranges = max(1, -(-n_parents // range_keys))
    parent_r = keys.withColumn("h", F.xxhash64("key")).withColumn("range", _range_of("h", n_ranges))
    ref_r = refs.withColumn("h", F.xxhash64(F.lower("ref_id"))).withColumn("range", _range_of("h", n_ranges))
    load = ref_r.groupBy("parent", "range").agg((F.floor(F.count("*") / task_refs) + 1).cast("int").alias("salts"))
    # one row a range and parent table: about as many as tasks
    load = cut(load)
    groups = load.agg(F.count("*").alias("ranges"), F.coalesce(F.sum("salts"), F.lit(1)).alias("tasks")).head()
    told = broadcast_if(load, groups["ranges"])
    ref_s = ref_r.join(told, ["parent", "range"]).withColumn("salt", F.pmod(F.xxhash64("record_id", "ref_id"), F.col("salts").cast("long")))
    parent_s = parent_r.join(told, ["parent", "range"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)))
    group = ["parent", "range", "salt"]
    # a task holds one group at a time; without a number of partitions of their own, small ones would be merged as the data grow
    n = int(min(groups["tasks"], TASKS_A_CORE * parallelism(spark)))
    return (
        ref_s.select(*group, "h", "ref_field", "record_id", "ref_id", "created_at")
        .repartition(n, *group)
        .groupBy(*group)
        .cogroup(parent_s.select(*group, "h", "key").repartition(n, *group).groupBy(*group))
        .applyInArrow(_probe, MISS_SCHEMA)
    )


def _range_of(h: str, n_ranges: int) -> F.Column:
    """Number of the equal range of the signed 64-bit space that ``h`` lies in."""
    return F.floor((F.shiftright(F.col(h), 32) + F.lit(2**31)) * F.lit(n_ranges) / F.lit(2**32)).cast("int")


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    out = refs.select(MISS_SCHEMA.names)
    if out.num_rows == 0:
        return out
    if parents.num_rows:
        h = parents["h"].to_numpy()
        order = np.argsort(h, kind="stable")
        held, keys = h[order], parents["key"].combine_chunks().take(pa.array(order))
        low, probe = pc.utf8_lower(out["ref_id"]).combine_chunks(), refs["h"].to_numpy()
        at, end = np.searchsorted(held, probe, "left"), np.searchsorted(held, probe, "right")
        found, step = np.zeros(len(probe), dtype=bool), 0
        todo = np.flatnonzero(at < end)
        while len(todo):  # a second step only where different keys share a hash
            same = pc.equal(keys.take(pa.array(at[todo] + step)), low.take(pa.array(todo))).to_numpy(zero_copy_only=False)
            found[todo[same]] = True
            step += 1
            todo = todo[~same]
            todo = todo[at[todo] + step < end[todo]]
        out = out.filter(pa.array(~found))
    if out.num_rows == 0:
        return out
    first = out.group_by(["ref_field", "record_id", "ref_id"]).aggregate([("created_at", "min")])
    return first.rename_columns({"created_at_min": "created_at"}).select(MISS_SCHEMA.names).cast(out.schema)


def orphan_report(misses: DataFrame) -> DataFrame:
    """Orphan references counted per field and month of the referring record; ``month`` is null where the record has no date."""
    return misses.groupBy("ref_field", F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_orphans"), F.countDistinct("ref_id").alias("n_ids"), F.countDistinct("record_id").alias("n_records")
    )
