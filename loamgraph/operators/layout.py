"""Positions of few topics on a canvas, and how legible they are. One view is one small group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

_PLACED = T.StructType([T.StructField("view", T.StringType()), T.StructField("id", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def force_layout(nodes: DataFrame, links: DataFrame, rounds: int = 150, width: float = 1000.0, radius: float = 30.0, relax: int = 80) -> DataFrame:
    """``(view, id, x, y)`` of nodes ``(view, id)`` and links ``(view, a, b)``: springs along links, repulsion else, from a spiral in order of id.

    Afterwards circles that overlap are pushed apart and the picture is centred. The same input gives the same picture.
    """

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(n["id"])
        if not ids:
            return pd.DataFrame({"view": [], "id": [], "x": [], "y": []})
        at = {i: k for k, i in enumerate(ids)}
        k = np.arange(len(ids))
        angle = k * math.pi * (3 - math.sqrt(5))
        p = np.stack([np.cos(angle), np.sin(angle)], 1) * (width / 2 * np.sqrt((k + 0.5) / len(ids)))[:, None]
        ends = np.array([(at[a], at[b]) for a, b in zip(e["a"], e["b"]) if a in at and b in at and a != b], dtype=int).reshape(-1, 2)
        ideal = width / math.sqrt(len(ids) + 1)
        for r in range(rounds):
            d = p[:, None] - p[None]
            far = np.maximum(np.hypot(d[..., 0], d[..., 1]), 1e-6)
            push = (d * (ideal**2 / far**2)[..., None]).sum(1)
            if len(ends):
                s = p[ends[:, 1]] - p[ends[:, 0]]
                pull = s * (np.hypot(s[:, 0], s[:, 1]) / ideal)[:, None]
                np.add.at(push, ends[:, 0], pull)
                np.add.at(push, ends[:, 1], -pull)
            size = np.maximum(np.hypot(push[:, 0], push[:, 1]), 1e-9)
            p = p + push / size[:, None] * np.minimum(size, width / 10 * (1 - r / rounds))[:, None]
        for _ in range(relax):
            d = p[:, None] - p[None]
            far = np.hypot(d[..., 0], d[..., 1]) + np.eye(len(ids)) * 1e9
            over = np.maximum(2 * radius - far, 0)
            if not over.any():
                break
            p = p + (d / np.maximum(far, 1e-6)[..., None] * (over / 2)[..., None]).sum(1)
        p = p - (p.max(0) + p.min(0)) / 2
        return pd.DataFrame({"view": key[0], "id": ids, "x": np.round(p[:, 0], 6), "y": np.round(p[:, 1], 6)})

    return nodes.select("view", "id").groupBy("view").cogroup(links.select(*[F.col(c).alias(c) for c in ("view", "a", "b")]).groupBy("view")).applyInPandas(run, _PLACED)


def layout_quality(placed: DataFrame, radius: float = 30.0, width: float = 1000.0, height: float = 1000.0) -> DataFrame:
    """``(view, n, overlaps, clipped)``: circles that overlap, and those that leave the canvas around the centre."""
    a, b = placed.withColumnsRenamed({"id": "ia", "x": "xa", "y": "ya"}), placed.withColumnsRenamed({"id": "ib", "x": "xb", "y": "yb"})
    near = F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")) < 2 * radius - 1e-6
    over = a.join(b, "view").where((F.col("ia") < F.col("ib")) & near).groupBy("view").agg(F.count("*").alias("overlaps"))
    out = placed.groupBy("view").agg(F.count("*").alias("n"), F.count_if((F.abs("x") > width / 2 - radius) | (F.abs("y") > height / 2 - radius)).alias("clipped"))
    return out.join(over, "view", "left").fillna(0, ["overlaps"])


def legible_labels(sizes: DataFrame, zoom: float = 1.0, least: float = 5.5) -> DataFrame:
    """``(view, n_legible, n_small)`` of circles ``(view, name, radius)``: labels whose letters fit at ``least`` pixels and more.

    A label has 0.62 of the radius for a letter's height, less where its first letters, at most seven, do not fit the width of 1.55 radii.
    """
    width, high = F.col("radius") * 1.55, F.col("radius") * 0.62
    letters = F.greatest(F.least(F.greatest(F.lit(2), F.floor(width / high)), F.lit(7), F.length("name")), F.lit(1))
    ok = F.least(high, width / letters) * zoom >= least
    return sizes.groupBy("view").agg(F.count_if(ok).alias("n_legible"), F.count_if(~ok).alias("n_small"))
