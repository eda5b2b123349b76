"""Similarity clusters by parallel pivot correlation clustering.

Records have the order of a hash of their id. In each round a record whose smallest similar record is itself becomes a
pivot; one whose smallest is a pivot joins it; the others wait for the next round. This gives the clusters
that the sequential algorithm gives in that order, without listing the pairs: tiles only report, for each record, its
smallest similar one. Members are then moved to the closest pivot, and in rounds each cluster gets its medoid and members are
moved to the closest medoid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from loamgraph.llm.vectors import COARSE, Index, Side, Tile, fit, matrix, over_tiles, place, unit, with_rank
from loamgraph.runtime import cut, tidy

#: Bytes of a record's hash that are summed over neighbourhoods to compare them.
MARKS = 6
#: Vectors in a cell on average.
CELL = 2_500
#: Members of a cluster that are named as its most typical.
TYPICAL = 3
#: Rounds of new medoids and moves to them, at most; they end as soon as no medoid changes.
ROUNDS = 3

_MARKS = [f"m{i}" for i in range(MARKS)]
_SEEN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("best", T.StructType([T.StructField("h", T.LongType()), T.StructField("id", T.StringType())])),
        T.StructField("near", T.StructType([T.StructField("far", T.DoubleType()), T.StructField("id", T.StringType())])),
        T.StructField("n", T.LongType()),
        *[T.StructField(m, T.LongType()) for m in _MARKS],
    ]
)


def _look(threshold: float):
    """Reports for each asking record of a tile: its smallest and its closest giving neighbour, their number and marks."""

    def work(t: Tile) -> pa.Table:
        parts = []
        if len(t.left) and len(t.right):
            sides = []
            for s in (t.left, t.right):
                weights = _weights(s)
                exact = np.float32 if weights.sum() < 1 << 24 else np.float64
                sides.append((s.t["asks"].to_numpy(zero_copy_only=False), s.t["gives"].to_numpy(zero_copy_only=False), weights.astype(exact)))
            (l_asks, l_gives, l_w), (r_asks, r_gives, r_w) = sides
            nl, nr = len(t.left), len(t.right)
            l_first, r_first = np.full(nl, -1), np.full(nr, -1)
            l_near, r_near = np.full(nl, -1), np.full(nr, -1)
            l_cos, r_cos = np.full(nl, -2.0), np.full(nr, -2.0)
            l_sum, r_sum = np.zeros((nl, 1 + MARKS)), np.zeros((nr, 1 + MARKS))

            def closest(mask, a, b, cos, near):
                """Updates the closest of each row by exact cosine, the smaller rank where equal."""
                i, j = np.nonzero(mask)
                if not len(i):
                    return
                c = np.round(np.einsum("ij,ij->i", a[i], b[j]), 9)
                order = np.lexsort((j, -c, i))
                i, j, c = i[order], j[order], c[order]
                top = np.r_[True, i[1:] != i[:-1]]
                i, j, c = i[top], j[top], c[top]
                up = c > cos[i]
                cos[i[up]], near[i[up]] = c[up], j[up]

            wants = bool(t.left.t["closest"][0].as_py())
            for block in t.blocks():
                mask = t.similar(block, threshold)
                if not mask.any():
                    continue
                mine = mask & l_asks[block][:, None] & r_gives[None, :]
                any_ = mine.any(1)
                rows = np.flatnonzero(any_) + block.start
                l_first[rows] = mine[any_].argmax(1)
                l_sum[rows] += mine[any_].astype(r_w.dtype) @ r_w
                if wants:
                    cos, near = l_cos[block], l_near[block]
                    closest(mine, t.left.x64[block], t.right.x64, cos, near)
                    l_cos[block], l_near[block] = cos, near
                theirs = mask & t.told(block) & l_gives[block][:, None] & r_asks[None, :]
                any_ = theirs.any(0)
                if any_.any():
                    cols = np.flatnonzero(any_)
                    sub = theirs[:, cols]
                    new = r_first[cols] < 0
                    r_first[cols[new]] = sub[:, new].argmax(0) + block.start
                    r_sum[cols] += sub.T.astype(l_w.dtype) @ l_w[block]
                    if wants:
                        cos, near = r_cos[cols], r_near[cols]
                        before = near.copy()
                        closest(sub.T, t.right.x64[cols], t.left.x64[block], cos, near)
                        r_cos[cols], r_near[cols] = cos, np.where(near != before, near + block.start, near)
            for s, o, first, near, cos, total in ((t.left, t.right, l_first, l_near, l_cos, l_sum), (t.right, t.left, r_first, r_near, r_cos, r_sum)):
                k = np.flatnonzero(first >= 0)
                if len(k):
                    parts.append((s.ids[k], o.h[first[k]], o.ids[first[k]], -cos[k], np.where(near[k] >= 0, o.ids[near[k]], None), total[k]))
        ids, bh, bid, far, nid, total = (np.concatenate([p[c] for p in parts]) if parts else np.empty((0, 1 + MARKS) if c == 5 else 0) for c in range(6))
        n = len(ids)
        columns = {
            "kind": pa.array([t.kind] * n, pa.string()),
            "id": pa.array(list(ids), pa.string()),
            "best": pa.StructArray.from_arrays([pa.array(bh.astype(np.int64)), pa.array(list(bid), pa.string())], names=["h", "id"]),
            "near": pa.StructArray.from_arrays([pa.array(far.astype(float)), pa.array(list(nid), pa.string())], names=["far", "id"]),
        }
        columns |= {c: pa.array(total[:, i].astype(np.int64)) for i, c in enumerate(("n", *_MARKS))}
        return pa.table(columns)

    return work


def _scan(active: DataFrame, index: Index, threshold: float, closest: bool = False) -> DataFrame:
    """One row for each asking record with a giving neighbour: smallest, closest, number and marks of its neighbours."""
    least = [F.min("best").alias("best"), F.min("near").alias("near"), *[F.sum(c).alias(c) for c in ("n", *_MARKS)]]
    seen = cut(over_tiles(active.withColumn("closest", F.lit(closest)), index, _look(threshold), _SEEN).groupBy("kind", "id").agg(*least))
    tidy(active.sparkSession)  # else the rows of all tiles stay until the last scan
    return seen


def _weights(s: Side) -> np.ndarray:
    """Per record its weight and marks: those of its copies where given, else 1 and the bytes of a hash of its rank."""
    bytes_ = mixed(s.h)
    own = np.concatenate([np.ones((len(s), 1), dtype=np.int64), bytes_], axis=1)
    if "sums" in s.t.column_names:
        lists = s.t["sums"].to_pylist()
        for i, x in enumerate(lists):
            if x is not None:
                own[i] = x
    return own


def mixed(h: np.ndarray) -> np.ndarray:
    """The marks of records by their rank: bytes of a mix of its 64 bits."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return np.stack([(z >> np.uint64(8 * i)) & np.uint64(255) for i in range(MARKS)], axis=1).astype(np.int64)


def _with_marks(df: DataFrame) -> DataFrame:
    """``df (..., id)`` with its rank and, as columns own_w and own_m..., its weight and marks."""
    df = df.withColumn("h", F.xxhash64("id", F.lit(11)))
    schema = T.StructType([*df.schema.fields, T.StructField("own_w", T.LongType()), *[T.StructField(f"own_{m}", T.LongType()) for m in _MARKS]])
    at = df.columns.index("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = mixed(b.column(at).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.ones(b.num_rows, dtype=np.int64)), *[pa.array(np.ascontiguousarray(marks[:, i])) for i in range(MARKS)]], names=schema.names)

    return df.mapInArrow(run, schema)


def _copies(placed: DataFrame) -> DataFrame | None:
    """``(kind, id, rep, sums)`` of the records whose vector has copies: rep is the smallest id among them, sums their
    number and the sums of their marks."""
    group = ["kind", "v1", "v2"]
    ids = placed.select("kind", "id", F.xxhash64("code").alias("v1"), F.xxhash64("code", F.lit(5)).alias("v2"))
    many = cut(ids.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if many.isEmpty():
        return None
    own = cut(_with_marks(ids.join(many, group, "left_semi")))
    sums = own.groupBy(*group).agg(F.min("id").alias("rep"), F.array(F.sum("own_w"), *[F.sum(f"own_{m}") for m in _MARKS]).alias("sums"))
    return cut(own.join(sums, group).select("kind", "id", "rep", "sums"))


def pivot_clusters(rows: DataFrame, threshold: float, dim: int, index: Index | None = None, rounds: int = 0) -> DataFrame:
    """``(kind, id, pivot, isolated)`` of every record that is similar to another of its kind.

    rows: as made by :func:`vectors.vector_rows`. Records without a similar one are clusters of their own and left
    out. isolated: whether every two members of the cluster are similar and no member is similar to a record outside,
    told by comparing, for each member, the number and hashed sums of its neighbourhood with those of the cluster. Moving
    members makes no cluster isolated that was not: all members of one have the same smallest record, so they are one from the start.
    pivot: with rounds (ROUNDS, say), the medoid that the members of a cluster that is not isolated were moved to last; every
    member is similar to it. Copies of one vector are united
    first. An empty table gives an empty result.
    """
    index = index or fit(rows, dim, cell=CELL, coarse=COARSE)
    plain = with_rank(place(rows, index, packed=True))
    copies = _copies(plain)
    if copies is not None:
        own = copies.where(F.col("id") == F.col("rep")).select("kind", "id", "sums")
        extra = copies.where(F.col("id") != F.col("rep")).select("kind", "id")
        plain = cut(plain.join(extra, ["kind", "id"], "left_anti").join(own, ["kind", "id"], "left"))
    tidy(rows.sparkSession)
    flags = lambda asks, gives: [asks.alias("asks"), gives.alias("gives")]
    joined = _scan(plain.select("*", *flags(F.lit(True), F.lit(True))), index, threshold)
    if copies is not None:  # copies alone are a cluster too
        joined = joined.join(own, ["kind", "id"], "full_outer")
    joined = _with_marks(joined)
    if copies is not None:
        for i, c in enumerate(("own_w", *[f"own_{m}" for m in _MARKS])):
            joined = joined.withColumn(c, F.coalesce(F.col("sums")[i], c))
    around = cut(
        joined.select(
            "kind", "id", "h", "own_w", *[f"own_{m}" for m in _MARKS], "best",
            (F.coalesce("n", F.lit(0)) + F.col("own_w")).alias("closed_n"), *[(F.coalesce(m, F.lit(0)) + F.col(f"own_{m}")).alias(f"closed_{m}") for m in _MARKS],
        )
    )
    done, waiting = None, around.select("kind", "id", "h", "best")
    while True:
        me = F.struct(F.col("h"), F.col("id"))
        heads = waiting.where(F.col("best").isNull() | (me < F.col("best"))).select("kind", "id", F.col("id").alias("pivot"))
        pivots = heads if done is None else heads.unionByName(done.where(F.col("id") == F.col("pivot")))
        at = pivots.select("kind", F.col("id").alias("to"), F.col("id").alias("pivot"))
        behind = waiting.where(F.col("best").isNotNull() & (me > F.col("best"))).select("kind", "id", F.col("best.id").alias("to"))
        follow = behind.join(at, ["kind", "to"], "left").select("kind", "id", "pivot")
        joined = follow.where(F.col("pivot").isNotNull())
        done = cut(heads.unionByName(joined) if done is None else done.unionByName(heads).unionByName(joined))
        left = cut(follow.where(F.col("pivot").isNull()).select("kind", "id"))
        if left.isEmpty():
            break
        gives = left.select("kind", "id", F.lit(True).alias("asks")).unionByName(done.where(F.col("id") == F.col("pivot")).select("kind", "id", F.lit(False).alias("asks")))
        active = plain.join(gives, ["kind", "id"]).withColumn("gives", F.lit(True))
        again = _scan(active, index, threshold).select("kind", "id", "best")
        waiting = cut(left.withColumn("h", F.xxhash64("id", F.lit(11))).join(again, ["kind", "id"], "left"))
    # an isolated cluster stays as it is; the members of the others go to their closest pivot
    labelled = around.join(done, ["kind", "id"])
    sums = labelled.groupBy("kind", "pivot").agg(F.sum("own_w").alias("size"), *[F.sum(f"own_{m}").alias(f"all_{m}") for m in _MARKS])
    same = (F.col("closed_n") == F.col("size")) & F.expr(" AND ".join(f"closed_{m} = all_{m}" for m in _MARKS))
    clean = labelled.join(sums, ["kind", "pivot"]).groupBy("kind", "pivot").agg(F.min(same).alias("isolated"))
    labels = cut(done.join(clean, ["kind", "pivot"]).select("kind", "id", "pivot", "isolated"))
    labels = _moved(labels, plain, index, threshold, rounds)
    if copies is not None:
        rest = copies.where(F.col("id") != F.col("rep")).select("kind", F.col("id").alias("copy"), F.col("rep").alias("id"))
        labels = labels.unionByName(labels.join(rest, ["kind", "id"]).select("kind", F.col("copy").alias("id"), "pivot", "isolated"))
    return labels


def _moved(labels: DataFrame, plain: DataFrame, index: Index, threshold: float, rounds: int) -> DataFrame:
    """``labels`` with the members of clusters that are not isolated moved to the closest pivot, then to the closest medoid in rounds.

    A medoid takes the place of its cluster's last centre if all members are similar to it, so members always are to theirs.
    """
    loose = labels.where(~F.col("isolated")).select("kind", "id", "pivot")
    if loose.where(F.col("id") != F.col("pivot")).isEmpty():
        return labels
    plain = cut(plain.join(loose.select("kind", "id"), ["kind", "id"], "left_semi"))  # the rest takes no part in any round
    centres = loose.select("kind", "pivot", F.col("pivot").alias("centre")).distinct()
    for round_ in range(rounds + 1):
        if round_:
            centres = _medoids(loose, plain, index.dim, threshold)
            if centres.where("centre <> pivot").isEmpty():
                break
        named = loose.join(centres, ["kind", "pivot"])
        gives = F.col("id") == F.col("centre")
        active = plain.join(named.select("kind", "id", (~gives).alias("asks"), gives.alias("gives")), ["kind", "id"])
        near = _scan(active, index, threshold, closest=True).select("kind", "id", F.col("near.id").alias("closer"))
        loose = cut(named.join(near, ["kind", "id"], "left").select("kind", "id", F.coalesce("closer", "centre").alias("pivot")))
    return labels.where("isolated").unionByName(loose.withColumn("isolated", F.lit(False)))


def _medoids(clusters: DataFrame, plain: DataFrame, dim: int, threshold: float) -> DataFrame:
    """``(kind, pivot, centre)``: of each cluster ``(kind, id, pivot)`` the member with the largest mean cosine to all, the smaller id of
    equal ones; the pivot itself where some member is not similar to that one.

    plain: placed rows with the bytes of the vectors, and the weight of their copies in ``sums`` where there is any.
    """
    copies = F.col("sums")[0] if "sums" in plain.columns else F.lit(None)
    vecs = cut(plain.select("kind", "id", "code", F.coalesce(copies, F.lit(1)).cast("long").alias("n")).join(clusters.select("kind", "id", F.col("pivot").alias("cluster_id")), ["kind", "id"]))
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in ("kind", "id", "cluster_id")], T.StructField("score", T.DoubleType())])

    def score(read):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, _ = unit(_from_bytes(b.column(3), dim))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.einsum("ij,ij->i", x, read(b.column(4))))], names=schema.names)

        return run

    to_all = vecs.join(_sums(vecs, dim), ["kind", "cluster_id"]).select("kind", "id", "cluster_id", "code", "total")
    to_all = to_all.mapInArrow(score(lambda c: c.flatten().to_numpy().reshape(-1, dim)), schema)
    best = cut(to_all.groupBy("kind", "cluster_id").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "id"))["id"].alias("centre")))
    held = vecs.select("kind", F.col("id").alias("centre"), F.col("code").alias("head")).join(best, ["kind", "centre"]).drop("centre")
    to_head = vecs.join(held, ["kind", "cluster_id"]).select("kind", "id", "cluster_id", "code", "head")
    to_head = to_head.mapInArrow(score(lambda c: unit(_from_bytes(c, dim))[0]), schema)
    ok = to_head.groupBy("kind", "cluster_id").agg((F.min("score") >= threshold).alias("ok"))
    return cut(best.join(ok, ["kind", "cluster_id"]).select("kind", F.col("cluster_id").alias("pivot"), F.when(F.col("ok"), F.col("centre")).otherwise(F.col("cluster_id")).alias("centre")))


def _from_bytes(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f4").reshape(-1, dim)


def _sums(vecs: DataFrame, dim: int) -> DataFrame:
    """``(kind, cluster_id, size, total)``: the weighted sum of the unit vectors of ``(kind, cluster_id, code, n)``, summed by task first."""
    total = T.StructType([T.StructField("kind", T.StringType()), T.StructField("cluster_id", T.StringType()), T.StructField("size", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))])

    def add(kinds, ids, values, weights) -> pa.RecordBatch:
        keys = np.array([f"{k}\0{i}" for k, i in zip(kinds, ids)], dtype=object)
        names, where, back = np.unique(keys, return_index=True, return_inverse=True)
        out = np.zeros((len(names), dim))
        np.add.at(out, back, values)
        n = np.bincount(back, weights=weights, minlength=len(names)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([kinds[i] for i in where], pa.string()), pa.array([ids[i] for i in where], pa.string()), pa.array(n), pa.array(list(out), pa.list_(pa.float64()))], names=total.names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = b.column(3).to_numpy()
                yield add(b.column(0).to_pylist(), b.column(1).to_pylist(), unit(_from_bytes(b.column(2), dim))[0] * n[:, None], n)

    def whole(t: pa.Table) -> pa.Table:
        b = t.combine_chunks()
        values = b["total"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        return pa.Table.from_batches([add(b["kind"].to_pylist(), b["cluster_id"].to_pylist(), values, b["size"].to_numpy())])

    return vecs.select("kind", "cluster_id", "code", "n").mapInArrow(partial, total).groupBy("kind", "cluster_id").applyInArrow(whole, total)


def describe(clusters: DataFrame, rows: DataFrame, dim: int, typical: int = TYPICAL) -> DataFrame:
    """``(kind, cluster_id, size, members, cohesion)`` of each cluster: its size, its most typical members and the mean
    cosine of its members with the others.

    clusters: ``(kind, id, cluster_id)``. Most typical is the member with the largest mean cosine to the others, the
    medoid; sums of vectors are made by task first, so a cluster of any size is never gathered.
    """
    vecs = rows.dropDuplicates(["kind", "id"]).join(clusters.select("kind", "id", "cluster_id"), ["kind", "id"])
    vecs = cut(vecs)
    packed = T.StructType([T.StructField("kind", T.StringType()), T.StructField("cluster_id", T.StringType()), T.StructField("code", T.BinaryType()), T.StructField("n", T.LongType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = pa.array([r.tobytes() for r in matrix(b.column(2), dim).astype("<f4")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), code, pa.array(np.ones(b.num_rows, dtype=np.int64))], names=packed.names)

    sums = _sums(vecs.select("kind", "cluster_id", "vec").mapInArrow(pack, packed), dim)
    scored = T.StructType([*[T.StructField(c, T.StringType()) for c in ("kind", "cluster_id", "id")], T.StructField("size", T.LongType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, _ = unit(matrix(b.column(3), dim))
                n = b.column(4).to_numpy()
                s = (np.einsum("ij,ij->i", x, b.column(5).flatten().to_numpy().reshape(-1, dim)) - 1) / np.maximum(n - 1, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(np.round(s, 6))], names=scored.names)

    each = vecs.join(sums, ["kind", "cluster_id"]).select("kind", "cluster_id", "id", "vec", "size", "total").mapInArrow(score, scored)
    # the best few of every salt, then of the cluster
    by = lambda *c: Window.partitionBy("kind", "cluster_id", *c).orderBy(F.col("score").desc(), "id")
    first = each.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    mean = first.groupBy("kind", "cluster_id").agg(F.max("size").alias("size"), F.round(F.avg("score"), 6).alias("cohesion"))
    top = first.withColumn("rn", F.row_number().over(by("salt"))).where(F.col("rn") <= typical)
    top = top.withColumn("rn", F.row_number().over(by())).where(F.col("rn") <= typical)
    named = top.groupBy("kind", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]).alias("members"))
    return mean.join(named, ["kind", "cluster_id"]).select("kind", "cluster_id", "size", "members", "cohesion")
