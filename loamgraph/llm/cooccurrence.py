"""Items that appear together: an incremental table of pair counts.

A changed basket emits a signed delta for each of its items and pairs (+1 where it now holds them, -1 where it no longer
does). Deltas are summed before the shuffle and merged into counts that lie in hash buckets in the shared folder. A pair is
kept with the counts of its items, so that only pairs of a delta or of an item whose count changed are scored anew, and only
the buckets that hold such pairs are written anew.
"""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamgraph.runtime import cut, parallelism, scratch_path

#: Rows in a bucket at most about; a table with more than twice as many is spread over more buckets.
BUCKET_ROWS = 2_000_000
#: Buckets at least.
BUCKETS = 8
#: Items of a basket whose pairs one task makes; baskets with more are dealt out.
ITEMS_A_TASK = 2_000
#: Changed items up to which they are broadcast to the pairs.
BROADCAST_ITEMS = 1_000_000


def clean_baskets(df: DataFrame, id_col: str, items_col: str) -> DataFrame:
    """``(basket, items)``: one row a basket, its items distinct and sorted by code point, null and empty ones left out.

    Repeated rows of a basket are united. Baskets without an item stay, with an empty list.
    """
    items = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(items_col), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))
    rows = df.where(F.col(id_col).isNotNull()).select(F.lower(F.col(id_col)).alias("basket"), items.alias("items"))
    return rows.groupBy("basket").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _twos(signed: DataFrame) -> DataFrame:
    """``(a, b, sign)``: the pairs of ``signed (items, sign)``, one after the other, so that no task holds all pairs of a basket.

    Where some basket has more than ITEMS_A_TASK items, stretches of first items are dealt out to tasks.
    """
    part = signed.select("items", "sign", F.explode(F.sequence(F.lit(1), F.size("items"), F.lit(ITEMS_A_TASK))).alias("at"))
    if (signed.agg(F.max(F.size("items"))).head()[0] or 0) > ITEMS_A_TASK:
        part = part.repartition(4 * parallelism(signed.sparkSession), "at", F.xxhash64("items"))
    firsts = part.select("items", "sign", "at", F.posexplode(F.slice("items", F.col("at"), ITEMS_A_TASK)).alias("i", "a"))
    return firsts.select("a", F.explode(F.slice("items", F.col("at") + F.col("i") + 1, F.size("items"))).alias("b"), "sign")


def signed_deltas(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marginal and pair deltas ``(a, n)`` and ``(a, b, n)`` of ``changes (basket, before, after)``, sorted lists or null.

    Item a null stands for the number of baskets that hold any item. Deltas are summed within each task before they move.
    """
    empty = F.array().cast("array<string>")
    # a basket that did not exist emits nothing for its empty past
    signed = changes.select(F.inline(F.array(F.struct(F.coalesce("before", empty).alias("items"), F.lit(-1).alias("sign")), F.struct(F.coalesce("after", empty).alias("items"), F.lit(1).alias("sign")))))
    signed = cut(signed.where(F.size("items") > 0))
    ones = signed.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("items"))).alias("a"), "sign")
    marginal = ones.groupBy("a").agg(F.sum("sign").alias("n")).where(F.col("n") != 0)
    pairs = _twos(signed).groupBy("a", "b").agg(F.sum("sign").alias("n")).where(F.col("n") != 0)
    return marginal, pairs


class PairTable:
    """Counts of items and of pairs in hash buckets, in a folder that can be opened again.

    Each change writes the buckets that it touches into a folder of its own and then a manifest that says where every
    bucket lies; the last manifest is the table. A run that dies midway leaves no manifest, so the table stays as it was. Counts that
    fall to 0 are dropped, and so are folders that the last two manifests no longer name.
    """

    KEYS = {"items": ["a"], "pairs": ["a", "b"]}
    SCHEMAS = {"items": "a string, n bigint", "pairs": "a string, b string, n bigint, n_a bigint, n_b bigint"}

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.buckets, self.bucket_rows = spark, buckets, bucket_rows
        self.path = path or scratch_path(spark, "pair-table")
        self.state = self._last()

    # ---- files

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _manifests(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _load(self, version: int) -> dict:
        rows = self.spark.read.text(os.path.join(self.path, f"manifest-{version}.json"), wholetext=True).collect()
        return json.loads(rows[0]["value"])

    def _last(self) -> dict:
        """The last manifest: ``version`` and, for each kind, the number of ``buckets``, of ``rows`` and the folder of each bucket."""
        known = self._manifests()
        nothing = {"version": 0, **{k: {"buckets": 0, "rows": 0, "at": {}} for k in self.KEYS}}
        return self._load(known[-1]) if known else nothing

    def _commit(self, state: dict) -> None:
        fs, path = self._fs()
        name = f"manifest-{state['version']}.json"
        out = fs.create(path(os.path.join(self.path, f".{name}.tmp")), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(path(os.path.join(self.path, f".{name}.tmp")), path(os.path.join(self.path, name))):
            raise RuntimeError(f"version {state['version']} of {self.path} was written by another run")
        before, self.state = self.state, state
        for old in self._manifests():
            if old < state["version"] - 1:
                fs.delete(path(os.path.join(self.path, f"manifest-{old}.json")), False)
        for kind in self.KEYS:
            held = {v for s in (before, state) for v in s[kind]["at"].values()}
            root = path(os.path.join(self.path, kind))
            for f in fs.listStatus(root) if fs.exists(root) else ():
                if int(f.getPath().getName()[1:]) not in held:
                    fs.delete(f.getPath(), True)

    def _read(self, kind: str, buckets: list[int] | None = None) -> DataFrame:
        at = self.state[kind]["at"]
        paths = [os.path.join(self.path, kind, f"v{v}", f"bucket={b}") for b, v in at.items() if buckets is None or int(b) in buckets]
        schema = self.SCHEMAS[kind]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, kind: str, n: int) -> F.Column:
        return F.pmod(F.xxhash64(*self.KEYS[kind]), F.lit(n)).cast("int")

    def _write(self, kind: str, rows: DataFrame, n: int, touched: list[int], version: int) -> dict:
        """The kind's part of the new manifest, once the touched buckets of ``rows`` are written."""
        folder = os.path.join(self.path, kind, f"v{version}")
        rows.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        fs, path = self._fs()
        made = {int(f.getPath().getName()[7:]) for f in fs.listStatus(path(folder)) if f.getPath().getName().startswith("bucket=")}
        at = {b: v for b, v in self.state[kind]["at"].items() if int(b) not in touched} if n == self.state[kind]["buckets"] else {}
        at |= {str(b): version for b in sorted(made)}
        paths = [os.path.join(self.path, kind, f"v{v}", f"bucket={b}") for b, v in at.items()]
        return {"buckets": n, "rows": self.spark.read.schema(self.SCHEMAS[kind]).parquet(*paths).count() if paths else 0, "at": at}

    def _spread(self, kind: str, more: int) -> int:
        """Buckets for the rows there are and ``more``; the number there is as long as it does."""
        now, rows = self.state[kind]["buckets"], self.state[kind]["rows"] + more
        return now if now and rows <= 2 * now * self.bucket_rows else max(self.buckets, now, -(-rows // self.bucket_rows))

    # ---- counts

    def items(self) -> DataFrame:
        """``(a, n)`` of each item; the row with a null holds the number of baskets."""
        return self._read("items")

    def pairs(self) -> DataFrame:
        """``(a, b, n, n_a, n_b)`` with a before b."""
        return self._read("pairs")

    def apply(self, changes: DataFrame) -> "PairTable":
        """Merge ``changes (basket, before, after)``; changes that change nothing write nothing."""
        ones, twos = (cut(d) for d in signed_deltas(changes))
        if ones.isEmpty() and twos.isEmpty():
            return self
        version, state = self.state["version"] + 1, {}
        n = self._spread("items", ones.count())
        hit, old = self._touched("items", ones, n)
        merged = old.unionByName(ones).groupBy("a").agg(F.sum("n").alias("n")).where("n <> 0")
        state["items"] = self._write("items", merged.withColumn("bucket", self._bucket("items", n)), n, hit, version)
        # the counts of the items whose count changed and of those in new pairs
        asked = ones.select("a").union(twos.select("a")).union(twos.select("b")).where(F.col("a").isNotNull()).distinct()
        paths = [os.path.join(self.path, "items", f"v{v}", f"bucket={b}") for b, v in state["items"]["at"].items()]
        now = self.spark.read.schema(self.SCHEMAS["items"]).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMAS["items"])
        counts = cut(now.join(asked, "a", "left_semi"))
        few = F.broadcast if counts.count() <= BROADCAST_ITEMS else (lambda d: d)
        n = self._spread("pairs", twos.count())
        moved = None
        if self.state["pairs"]["at"] and n == self.state["pairs"]["buckets"]:
            changed = ones.select("a")
            both = self.pairs().select("a", "b")
            moved = both.join(few(changed), "a", "left_semi").unionByName(both.join(few(changed.withColumnRenamed("a", "b")), "b", "left_semi"))
        hit, old = self._touched("pairs", twos.select("a", "b") if moved is None else twos.select("a", "b").unionByName(moved), n)
        none = F.lit(None).cast("long")
        merged = old.unionByName(twos.select("a", "b", "n", none.alias("n_a"), none.alias("n_b"))).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b")).where("n <> 0")
        scored = merged.join(few(counts.select("a", F.col("n").alias("new_a"))), "a", "left").join(few(counts.select(F.col("a").alias("b"), F.col("n").alias("new_b"))), "b", "left")
        scored = scored.select("a", "b", "n", F.coalesce("new_a", "n_a").alias("n_a"), F.coalesce("new_b", "n_b").alias("n_b"))
        state["pairs"] = self._write("pairs", scored.withColumn("bucket", self._bucket("pairs", n)), n, hit, version)
        self._commit({"version": version, **state})
        return self

    def _touched(self, kind: str, keys: DataFrame, n: int) -> tuple[list[int], DataFrame]:
        """The buckets that hold any of the keys, or all where their number changes, and what lies in them now."""
        if n != self.state[kind]["buckets"]:
            return list(range(n)), self._read(kind)
        hit = [r["b"] for r in keys.select(self._bucket(kind, n).alias("b")).distinct().collect()]  # buckets, not keys
        return hit, self._read(kind, hit)

    def scores(self, least: int = 1, lift: float = 0.0) -> DataFrame:
        """``(a, b, n_ab, n_a, n_b, n_baskets, lift, pmi)`` of pairs with ``n_ab >= least`` and ``n_ab * N >= lift * n_a * n_b``.

        lift is how many times as often as chance; pmi its logarithm to base 2. A scan of the pairs: their items' counts lie with them.
        """
        total = self.items().where(F.col("a").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
        pairs = self.pairs().where(F.col("n") >= least).withColumnRenamed("n", "n_ab").withColumn("n_baskets", F.lit(total).cast("long"))
        together, chance = F.col("n_ab") * F.col("n_baskets").cast("double"), F.col("n_a").cast("double") * F.col("n_b")
        kept = pairs.where(together >= F.lit(float(lift)) * chance)
        return kept.select("a", "b", "n_ab", "n_a", "n_b", "n_baskets", (together / chance).alias("lift"), (F.log(together / chance) / F.lit(math.log(2))).alias("pmi"))


def first_load(baskets: DataFrame) -> DataFrame:
    """Changes that insert ``baskets (basket, items)``."""
    return baskets.select("basket", F.lit(None).cast("array<string>").alias("before"), F.col("items").alias("after"))


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that turn the baskets of ``before`` into those of ``after``; equal baskets give none."""
    b, a = before.withColumnRenamed("items", "before"), after.withColumnRenamed("items", "after")
    return b.join(a, "basket", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
