"""The k most similar records of every record.

Vectors are coded with four bits a subspace under a score-aware (anisotropic) loss; tables of inner products are
scanned for all pairs that meet in a tile, and pairs whose estimate can reach the threshold are compared exactly.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from loamgraph.llm.vectors import COARSE, Index, Tile, fit, over_tiles, place, with_rank
from loamgraph.runtime import cut, tidy

#: Salts over which the copies of one vector are ranked before they meet.
SALTS = 64

NEIGHBOURS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("id", T.StringType()), T.StructField("other", T.StringType()), T.StructField("cosine", T.DoubleType())])


def _best(ask: np.ndarray, give: np.ndarray, cos: np.ndarray, ask_ids: np.ndarray, give_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs of each asking row, by cosine, then id."""
    rank = np.argsort(np.argsort(give_ids.astype(str), kind="stable"), kind="stable")
    order = np.lexsort((rank[give], -cos, ask))
    ask, give, cos = ask[order], give[order], cos[order]
    start = np.searchsorted(ask, ask, "left")
    top = np.arange(len(ask)) - start < k
    return ask_ids[ask[top]], give_ids[give[top]], cos[top]


def _work(index: Index, k: int, threshold: float, exact: bool):
    slack = 4.0 if exact else index.codes.error  # estimates decide nothing where exact

    def work(t: Tile) -> pa.Table:
        from_left, from_right = [], []
        if len(t.left) and len(t.right):
            stored = np.frombuffer(b"".join(t.right.t["code"].to_pylist()), dtype=np.uint8).reshape(len(t.right), -1)
            centre = index.centre(np.array([t.at]))[0]
            base = t.left.x @ centre
            for block in t.blocks():
                tables = index.codes.tables(t.left.x[block])
                guess = index.codes.scan(tables, stored)
                guess += base[block][:, None]
                mask = guess >= threshold - slack
                own = t.self_at[block]
                mask[np.flatnonzero(own >= 0), own[own >= 0]] = False
                a, b = np.nonzero(mask)
                for i in range(0, len(a), 65536):  # the exact comparison
                    p, q = a[i : i + 65536], b[i : i + 65536]
                    cos = np.round(np.einsum("ij,ij->i", t.left.x64[block][p], t.right.x64[q]), 6)
                    ok = cos >= threshold
                    p, q, cos = p[ok], q[ok], cos[ok]
                    from_left.append((p + block.start, q, cos))
                    if t.visitor[block].any() and len(p):
                        heard = t.visitor[block][p]
                        heard[heard] = ~t.deaf[q[heard], t.home[block][p[heard]]]
                        from_right.append((q[heard], p[heard] + block.start, cos[heard]))
        out = []
        for got, x, y in ((from_left, t.left.ids, t.right.ids), (from_right, t.right.ids, t.left.ids)):
            if got and sum(len(g[0]) for g in got):
                out.append(_best(*(np.concatenate([g[c] for g in got]) for c in range(3)), x, y, k))
        ids, others, cos = (np.concatenate([o[c] for o in out]) if out else np.empty(0, dtype=object if c < 2 else float) for c in range(3))
        return pa.table({"kind": pa.array([t.kind] * len(ids), pa.string()), "id": pa.array(ids, pa.string()), "other": pa.array(others, pa.string()), "cosine": pa.array(cos, pa.float64())})

    return work


def _crowds(placed: DataFrame, k: int) -> DataFrame:
    """``(kind, id, last)``: records of vectors with more than k + 1 copies, beyond the k + 1 smallest ids.

    Each of them has the same k best as ``last``, the largest id that stays: the k smallest of those at cosine 1.
    """
    key = [F.xxhash64("vec").alias("v1"), F.xxhash64("vec", F.lit(5)).alias("v2")]
    ids = placed.select("kind", "id", *key).distinct()
    crowd = ids.groupBy("kind", "v1", "v2").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("kind", "v1", "v2")
    crowd = cut(crowd)
    if crowd.isEmpty():
        return None
    members = ids.join(crowd, ["kind", "v1", "v2"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    group = ["kind", "v1", "v2"]
    first = members.withColumn("rn", F.row_number().over(Window.partitionBy(*group, "salt").orderBy("id"))).where(F.col("rn") <= k + 1)
    first = first.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy("id"))).where(F.col("rn") <= k + 1)
    last = first.groupBy(*group).agg(F.max("id").alias("last"))
    return cut(members.join(last, group).where(F.col("id") > F.col("last")).select("kind", "id", "last"))


def nearest(rows: DataFrame, k: int, threshold: float, dim: int, index: Index | None = None, exact: bool = False) -> DataFrame:
    """``(kind, id, other, cosine)``: for each record the k others of its kind with the highest cosine, rounded to 6
    decimals, that reach the threshold; the smaller id first where they are equal.

    rows: as made by :func:`vectors.vector_rows`; repeated rows of an id count once, invalid vectors and an empty table
    give nothing. The index is fitted on a bounded sample and holds every record; the answer is approximate only in
    that a pair is missed whose members visit neither the other's cell, or whose estimate is off by more than
    all but 2 in 1000. exact: every record visits every cell and every estimate is checked, for tables that all pairs can be
    worked out of. :func:`vectors.recall` measures what is found.
    """
    index = index or fit(rows, dim, codes_for=threshold, coarse=COARSE)
    if exact:
        index = replace(index, margin=4.0)
    placed = place(rows, index)
    crowds = _crowds(placed, k)
    if crowds is not None:
        placed = cut(placed.join(crowds.select("kind", "id"), ["kind", "id"], "left_anti"))
    tidy(rows.sparkSession)
    found = over_tiles(with_rank(placed), index, _work(index, k, threshold, exact), NEIGHBOURS)
    best = Window.partitionBy("kind", "id").orderBy(F.col("cosine").desc(), "other")
    top = found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")
    if crowds is None:
        return top
    top = cut(top)
    same = top.withColumnRenamed("id", "last").join(crowds, ["kind", "last"]).select("kind", "id", "other", "cosine")
    return top.unionByName(same)


def pairs(neighbours: DataFrame) -> DataFrame:
    """``(kind, id_a, id_b)``: pairs of which either has the other, the smaller id first."""
    return neighbours.select("kind", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
