"""Ranking of candidates from several rules: one score, feedback, quotas, variety."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from loamgraph.functions.scores import candidate_score, keyword_signal


def scored(candidates: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """``candidates (grp, id, type, semantic, keyword, graph, base, pos)`` with a score: the weighted signals, less one where
    dismissed and half a point more where clicked. feedback: ``(id, verdict)``."""
    out = candidates.withColumn("score", candidate_score(F.col("semantic"), F.col("keyword"), F.col("graph"), F.col("base")))
    if feedback is None:
        return out
    f = feedback.groupBy("id").agg(F.max((F.col("verdict") == "dismissed").cast("int")).alias("d"), F.max((F.col("verdict") == "clicked").cast("int")).alias("c"))
    return out.join(f, "id", "left").withColumn("score", F.col("score") - F.coalesce("d", F.lit(0)) + 0.5 * F.coalesce("c", F.lit(0))).drop("d", "c")


def picked(candidates: DataFrame, most: int = 6, per_type: int = 2) -> DataFrame:
    """The best of each type first, then by score, at most ``per_type`` of a type and ``most`` of a group; an id counts once."""
    once = candidates.withColumn("dup", F.row_number().over(Window.partitionBy("grp", "id").orderBy(F.col("score").desc(), "pos"))).where("dup = 1").drop("dup")
    ranked = once.withColumn("rn", F.row_number().over(Window.partitionBy("grp", "type").orderBy(F.col("score").desc(), "pos", "id"))).where(F.col("rn") <= per_type)
    w = Window.partitionBy("grp").orderBy((F.col("rn") != 1), F.col("score").desc(), "pos", "id")
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("rn")


def varied(rows: DataFrame, per_first: int = 2) -> DataFrame:
    """``rows (grp, id, mid, first, score)`` in order of score, one a middle node and at most ``per_first`` a first capture.

    A row that its first capture's quota rejects leaves its middle node free, so the pass is sequential; the rows of a group are a short list.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        mids, firsts, keep = set(), {}, []
        for i, (mid, first) in enumerate(zip(pdf["mid"], pdf["first"])):
            if mid in mids or firsts.get(first, 0) >= per_first:
                continue
            mids.add(mid)
            firsts[first] = firsts.get(first, 0) + 1
            keep.append(i)
        return pdf.iloc[keep]

    return rows.groupBy("grp").applyInPandas(walk, rows.schema)


def with_keyword_signal(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``keyword`` from their corpus scores ``bm25``, which go; rounded, as sums differ by order."""
    return candidates.withColumn("keyword", F.round(keyword_signal("bm25"), 9)).drop("bm25")
