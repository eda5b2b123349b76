"""Answers of an extractor as tables: nodes and links of a graph, facts of a capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loamgraph.functions.text import is_trivial_name, parsed_json, unique_strings
from loamgraph.schemas import KINDS, RELATIONS

GRAPH = "struct<nodes:array<struct<id:string,name:string,kind:string,aliases:array<string>>>,links:array<struct<source:string,target:string,type:string>>>"
FACTS = "struct<title:string,summary:string,keywords:array<string>>"


def parsed_graphs(answers: DataFrame, id_col: str = "capture_id", text_col: str = "answer") -> DataFrame:
    """``(id_col, graph)`` of answers in JSON, put right where they are nearly so; null where they are none."""
    return answers.select(id_col, parsed_json(text_col, GRAPH).alias("graph"))


def extracted_nodes(graphs: DataFrame, most: int = 50, latin: bool = True) -> DataFrame:
    """``(capture_id, key, name, kind, aliases)``: named nodes that say something, unknown kinds as concept, missing ids by position."""
    n = graphs.select("capture_id", F.posexplode("graph.nodes").alias("pos", "n"))
    n = n.select("capture_id", "pos", F.coalesce(F.nullif(F.trim("n.id"), F.lit("")), F.concat(F.lit("n"), F.col("pos").cast("string"))).alias("key"), F.trim("n.name").alias("name"), F.when(F.lower("n.kind").isin(*KINDS), F.lower("n.kind")).otherwise("concept").alias("kind"), unique_strings(F.col("n.aliases")).alias("aliases"))
    n = n.where(F.col("name").isNotNull() & ~is_trivial_name("name", latin))
    w = Window.partitionBy("capture_id").orderBy("pos")
    return n.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn", "pos")


def extracted_links(graphs: DataFrame, nodes: DataFrame, most: int = 80) -> DataFrame:
    """``(capture_id, source, target, relation_type)`` between extracted nodes, without self links and repeats, unknown types as related_to."""
    links = graphs.select("capture_id", F.posexplode("graph.links").alias("pos", "l")).select("capture_id", "pos", F.trim("l.source").alias("source"), F.trim("l.target").alias("target"), F.when(F.col("l.type").isin(*RELATIONS), F.col("l.type")).otherwise("related_to").alias("relation_type"))
    keys = nodes.select("capture_id", "key")
    ok = links.where("source <> target").join(keys.withColumnRenamed("key", "source"), ["capture_id", "source"], "left_semi").join(keys.withColumnRenamed("key", "target"), ["capture_id", "target"], "left_semi")
    ok = ok.groupBy("capture_id", "source", "target", "relation_type").agg(F.min("pos").alias("pos"))
    return ok.withColumn("rn", F.row_number().over(Window.partitionBy("capture_id").orderBy("pos"))).where(F.col("rn") <= most).drop("rn", "pos")


def extracted_facts(answers: DataFrame, id_col: str = "capture_id", text_col: str = "answer") -> DataFrame:
    """``(id_col, title, summary, keywords)``; at most eight keywords."""
    p = answers.select(id_col, parsed_json(text_col, FACTS).alias("p"))
    return p.select(id_col, F.coalesce("p.title", F.lit("")).alias("title"), F.coalesce("p.summary", F.lit("")).alias("summary"), F.slice(unique_strings(F.col("p.keywords")), 1, 8).alias("keywords"))
