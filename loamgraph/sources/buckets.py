"""A keyed table in hash buckets, of which a change writes only those that it touches.

Each version writes its buckets into a folder of its own and then a manifest that says where every bucket lies; the last
manifest is the table. A run that dies midway leaves no manifest, so the table stays as it was.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class BucketedTable:
    """Rows by a string key; ``tag`` is a number that the last writer left (a batch number, say), ``version`` counts the changes."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16, keep: int = 2):
        self.spark, self.path, self.key, self.keep = spark, path, key, keep
        self.wanted = buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(os.path.join(self.path, f"manifest-{version}.json"), wholetext=True).head()["value"])

    def state(self) -> dict | None:
        """The last manifest, or None for a table that was never written."""
        known = self._versions()
        return self._manifest(known[-1]) if known else None

    def bucket(self, n: int) -> F.Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(n)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows, of some buckets where given; None for a table that was never written."""
        state = self.state()
        if state is None:
            return None
        schema = T.StructType.fromJson(state["schema"])
        paths = [os.path.join(self.path, f"v{v}", f"_b={b}") for b, v in state["at"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys."""
        n = (self.state() or {"buckets": self.wanted})["buckets"]
        return sorted(r[0] for r in rows.select(self.bucket(n)).distinct().collect())  # buckets, not rows

    def write(self, rows: DataFrame, buckets: list[int] | None, tag: int) -> None:
        """``rows`` in the place of what lies in ``buckets``, or of the whole table."""
        state = self.state() or {"version": 0, "buckets": self.wanted, "at": {}}
        version, n = state["version"] + 1, state["buckets"]
        folder = os.path.join(self.path, f"v{version}")
        rows.withColumn("_b", self.bucket(n)).repartition(max(1, n if buckets is None else len(buckets)), "_b").write.mode("overwrite").partitionBy("_b").parquet(folder)
        fs, path = self._fs()
        made = [f.getPath().getName()[3:] for f in fs.listStatus(path(folder)) if f.getPath().getName().startswith("_b=")]
        at = {b: v for b, v in state["at"].items() if buckets is not None and int(b) not in buckets} | {b: version for b in made}
        new = {"version": version, "tag": tag, "buckets": n, "schema": rows.schema.jsonValue(), "at": at}
        name = f"manifest-{version}.json"
        out = fs.create(path(os.path.join(self.path, f".{name}.tmp")), True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if not fs.rename(path(os.path.join(self.path, f".{name}.tmp")), path(os.path.join(self.path, name))):
            raise RuntimeError(f"version {version} of {self.path} was written by another run")
        self._clean()

    def _clean(self) -> None:
        """Drop manifests but the last ``keep``, and folders that none of these names."""
        fs, path = self._fs()
        known = self._versions()
        held = {v for k in known[-self.keep :] for v in self._manifest(k)["at"].values()} | {known[-1]}
        for old in known[: -self.keep]:
            fs.delete(path(os.path.join(self.path, f"manifest-{old}.json")), False)
        for f in fs.listStatus(path(self.path)):
            name = f.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) not in held:
                fs.delete(f.getPath(), True)
