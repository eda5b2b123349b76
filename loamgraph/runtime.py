"""Session plumbing shared by every operator: reading tables, cutting lineage, shared folders."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The scope of rows without a user.
ZERO_SCOPE = "00000000-0000-0000-0000-000000000000"
#: Rows of a narrow table up to which it is broadcast.
BROADCAST_ROWS = 500_000
#: Seconds between two collections of the driver's garbage by :func:`cut`, at least.
TIDY_S = 2.0
_tidied = 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Only where the session names none (tests, a single machine) a temporary folder is made and set.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="loamgraph-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, for tables that outlive one job."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files.

    Unlike a cache this survives the loss of executors, and the lineage starts anew. The files go once nothing refers to them
    where the session sets ``spark.cleaner.referenceTracking.cleanCheckpoints``; else they stay until the folder is removed. So do the
    files of the shuffles that earlier calls ran, which a driver with free memory would keep to the end.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    out = df.checkpoint(eager=True)
    if time.monotonic() - _tidied > TIDY_S:
        tidy(spark)
    return out


def written(df: DataFrame) -> DataFrame:
    """As :func:`cut`, by a table in the shared folder: what is known of the columns (constraints) starts anew too.

    In loops that rename and join what they make, these would grow with every round until planning takes all the time.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession, wait_s: float = 0.0) -> None:
    """Has the files of shuffles and checkpoints that nothing refers to go now, not when the driver happens to collect its garbage.

    wait_s: seconds to wait at most until the JVM knows what Python has just let go; Py4J tells it in a thread that looks once a second.
    """
    global _tidied
    gc.collect()
    until, told = time.monotonic() + wait_s, getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while told and time.monotonic() < until:
        time.sleep(0.05)
    spark.sparkContext._jvm.System.gc()
    _tidied = time.monotonic()


def parallelism(spark: SparkSession, least: int = 1) -> int:
    """Number of tasks that the cluster can run at once."""
    return max(least, spark.sparkContext.defaultParallelism)


def broadcast_if(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a narrow table of so many rows, to be broadcast if these are few; else a join with it shuffles."""
    return F.broadcast(df) if rows <= most else df


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores as it needs to be no column of ``df`` yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
