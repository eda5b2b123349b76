"""Views of one node, of a part of the graph, and of captures as cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loamgraph.functions.text import or_empty
from loamgraph.operators import graph, records
from loamgraph.schemas import KINDS


def cards(captures: DataFrame) -> DataFrame:
    """``(id, title, body, tags, created_at)``: the summary, or else the content; no tags as an empty list."""
    body = F.coalesce(F.nullif("summary", F.lit("")), F.nullif("content", F.lit("")), F.lit(""))
    return captures.select("id", or_empty("title").alias("title"), body.alias("body"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "created_at")


def known_kind(kind: Column | str) -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.when(kind.isin(*KINDS), kind).otherwise("unknown")


def node_detail(node_id: str, nodes: DataFrame, links: DataFrame, captures: DataFrame, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """The links at a node, and the newest of the first ``most`` captures that it or they name."""
    at = node_id.lower()
    own = links.where((F.lower("source") == at) | (F.lower("target") == at))
    named = nodes.where(F.col("id") == at).select(F.lit(0).alias("src"), F.posexplode("source_captured_ids").alias("pos", "c"))
    named = named.unionByName(own.select(F.lit(1).alias("src"), F.posexplode("evidence_captured_ids").alias("pos", "c")))
    first = named.where("c IS NOT NULL AND c <> ''").groupBy(F.lower("c").alias("id")).agg(F.min(F.struct("src", "pos")).alias("at")).orderBy("at", "id").limit(most)
    return own, captures.join(first.select("id"), "id", "left_semi").orderBy(F.col("created_at").desc_nulls_last(), "id")


def sub_graph(nodes: DataFrame, edges: DataFrame, kind: str | None = None, component_of: str | None = None, since: Column | None = None, until: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes by kind, component and time (both ends included), with their size on screen, and the links between them."""
    out = nodes
    if kind is not None:
        out = out.where(known_kind("kind") == kind)
    if since is not None or until is not None:
        out = records.between(out, since, until, closed=True)
    if component_of is not None:
        out = out.join(graph.component_of(edges, component_of), "id", "left_semi")
    ids = out.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    sized = out.join(graph.degrees(inner), "id", "left").withColumn("size", F.least(F.lit(14), 6 + F.coalesce("degree", F.lit(0))))
    return sized.drop("degree"), inner


def themes_to_tags(themes: DataFrame, tags: DataFrame) -> DataFrame:
    """``(theme, tag)``: for each theme's name the tag that stands first in it; the longer, then the smaller, of those at one place.

    Few themes against the tags of a period: the themes are broadcast.
    """
    hit = tags.where(F.length("tag") > 0).join(F.broadcast(themes), F.instr(F.lower("theme"), F.lower("tag")) > 0)
    w = Window.partitionBy("theme").orderBy(F.instr(F.lower("theme"), F.lower("tag")), F.length("tag").desc(), "tag")
    return hit.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("theme", "tag")
