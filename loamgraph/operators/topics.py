"""Topics over nodes and captures: votes, roll-ups of links between topics, groups, drill-down."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from loamgraph.functions.text import json_object_in
from loamgraph.operators.graph import bridge


def capture_votes(nodes: DataFrame, topics: DataFrame, other: str) -> DataFrame:
    """``(capture_id, topic, votes)``: the topic of most of a capture's nodes, 'other' not counted; more weight, then the smaller name, wins ties.

    nodes: ``(id, val, source_captured_ids)``; topics: ``(id, topic)``.
    """
    rows = bridge(nodes, ["val"]).join(topics.where(F.col("topic") != other).select(F.col("id").alias("node_id"), "topic"), "node_id")
    counted = rows.groupBy("capture_id", "topic").agg(F.count("*").alias("votes"), F.sum(F.coalesce("val", F.lit(0))).alias("w"))
    best = counted.groupBy("capture_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("w")).alias("w"), "topic")).alias("b"))
    return best.select("capture_id", F.col("b.topic").alias("topic"), (-F.col("b.v")).alias("votes"))


def cross_topic_edges(edges: DataFrame, topics: DataFrame) -> DataFrame:
    """``(topic_a, topic_b, n)``: links between different topics, undirected; ends without a topic are left out."""
    s = edges.join(topics.select(F.col("id").alias("a"), F.col("topic").alias("ta")), "a").join(topics.select(F.col("id").alias("b"), F.col("topic").alias("tb")), "b")
    return s.where("ta <> tb").groupBy(F.least("ta", "tb").alias("topic_a"), F.greatest("ta", "tb").alias("topic_b")).agg(F.count("*").alias("n"))


def topic_degrees(cross: DataFrame) -> DataFrame:
    """``(topic, n_topics, n_links)``: to how many topics, and by how many links, a topic is tied."""
    return cross.select(F.explode(F.array("topic_a", "topic_b")).alias("topic"), "n").groupBy("topic").agg(F.count("*").alias("n_topics"), F.sum("n").alias("n_links"))


def topic_groups(captures: DataFrame, votes: DataFrame) -> DataFrame:
    """``(topic, n, latest)`` of captures by topic, captures without one under null."""
    return captures.join(votes.withColumnRenamed("capture_id", "id"), "id", "left").groupBy("topic").agg(F.count("*").alias("n"), F.max("created_at").alias("latest"))


def topic_insight(nodes: DataFrame, topics: DataFrame, asof, days: int = 7) -> DataFrame:
    """``(topic, n_nodes, n_captures, n_new)``: members, distinct captures behind them, and members made in the last days."""
    m = nodes.join(topics, "id")
    new = F.coalesce(F.unix_millis("created_at") >= F.unix_millis(asof) - days * 86_400_000, F.lit(False))
    heads = m.groupBy("topic").agg(F.count("*").alias("n_nodes"), F.count_if(new).alias("n_new"))
    caps = bridge(nodes).join(topics.withColumnRenamed("id", "node_id"), "node_id").groupBy("topic").agg(F.countDistinct("capture_id").alias("n_captures"))
    return heads.join(caps, "topic", "left").select("topic", "n_nodes", F.coalesce("n_captures", F.lit(0)).alias("n_captures"), "n_new")


def topic_kinds(nodes: DataFrame, topics: DataFrame, most: int = 5) -> DataFrame:
    """``(topic, kind, n, rn)``: the most frequent kinds of each topic's members; the smaller kind of equally frequent ones first."""
    n = nodes.select("id", "kind").join(topics, "id").groupBy("topic", "kind").agg(F.count("*").alias("n"))
    w = Window.partitionBy("topic").orderBy(F.col("n").desc(), "kind")
    return n.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def related_topics(cross: DataFrame, most: int = 3) -> DataFrame:
    """``(topic, related, n, rn)``: the topics that a topic has most links to, of ``cross`` as :func:`cross_topic_edges` gives them."""
    both = cross.select("topic_a", "topic_b", "n").union(cross.select("topic_b", "topic_a", "n")).toDF("topic", "related", "n")
    w = Window.partitionBy("topic").orderBy(F.col("n").desc(), "related")
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def resolved_answers(answers: DataFrame, asked: DataFrame, known: list[str]) -> DataFrame:
    """``(batch, id, topic)`` from a model's answers ``(batch, answer)``: a JSON object of topics by number, name or id of what was asked.

    asked: ``(batch, pos, id, name)``, pos from 0. Talk around the object is cut off; a key is tried as number, then as name without letter
    case, then as id; topics that are not known are left out, and of several answers for a node the one whose key comes first counts.
    """
    said = answers.select("batch", F.posexplode(F.from_json(json_object_in("answer"), "map<string,string>")).alias("at", "k", "topic"))
    said = said.select("batch", "at", F.trim("k").alias("k"), F.trim("topic").alias("topic")).where(F.col("topic").isin(known))
    ways = F.array(*[F.struct(F.lit(p).alias("way"), k.alias("k")) for p, k in enumerate((F.col("pos").cast("string"), F.lower(F.trim("name")), F.col("id")))])
    keyed = asked.select("batch", "id", F.inline(ways)).where("k <> ''")
    hit = said.join(keyed.withColumnRenamed("k", "key"), "batch").where((F.col("k") == F.col("key")) | (F.col("way") == 1) & (F.lower("k") == F.col("key")))
    best = hit.groupBy("batch", "at", "topic").agg(F.min(F.struct("way", "id"))["id"].alias("id"))
    return best.groupBy("batch", "id").agg(F.min(F.struct("at", "topic"))["topic"].alias("topic"))


def topic_top_members(nodes: DataFrame, topics: DataFrame, degree: DataFrame, groups: int = 6, members: int = 4) -> DataFrame:
    """``(topic, id, rn)``: the best members of the largest topics, by sources, then links, then id."""
    m = nodes.select("id", F.size(F.array_distinct(F.coalesce("source_captured_ids", F.array().cast("array<string>")))).alias("n")).join(topics, "id").join(degree, "id", "left").fillna(0, ["degree"])
    top = m.groupBy("topic").agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), "topic").limit(groups)
    w = Window.partitionBy("topic").orderBy(F.col("n").desc(), F.col("degree").desc(), "id")
    return m.join(F.broadcast(top), "topic").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= members).select("topic", "id", "rn")


def drill_down(edges: DataFrame, topics: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """Members of a topic with their own links, and the topics next to it with the number of links."""
    mine = topics.where(F.col("topic") == topic).select("id")
    inner = edges.join(mine.withColumnRenamed("id", "a"), "a", "left_semi").join(mine.withColumnRenamed("id", "b"), "b", "left_semi")
    near = cross_topic_edges(edges, topics).where((F.col("topic_a") == topic) | (F.col("topic_b") == topic))
    return inner, near.select(F.when(F.col("topic_a") == topic, F.col("topic_b")).otherwise(F.col("topic_a")).alias("topic"), "n")


def strong_edges(edges: DataFrame, by: list[str], factor: float = 1.6) -> DataFrame:
    """The links of a view thinned out where there are more than two a node: the strongest, and then those that reach a node that has none.

    edges: ``(by, a, b, n)``, one view a group of a size that is shown on a screen; strongest first, then by names.
    """
    schema = T.StructType([edges.schema[c] for c in (*by, "a", "b", "n")])

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "a", "b"], ascending=[False, True, True], kind="stable")
        nodes = set(pdf["a"]) | set(pdf["b"])
        if len(pdf) <= 2 * len(nodes):
            return pdf
        keep = max(len(nodes), int(factor * len(nodes) + 0.5))
        head, reached, more = pdf.iloc[:keep], set(pdf["a"].iloc[:keep]) | set(pdf["b"].iloc[:keep]), []
        for i in range(keep, len(pdf)):
            a, b = pdf["a"].iloc[i], pdf["b"].iloc[i]
            if a not in reached or b not in reached:
                more.append(i)
                reached |= {a, b}
        return pd.concat([head, pdf.iloc[more]])

    return edges.select(*by, "a", "b", "n").groupBy(*by).applyInPandas(thin, schema)


def classify_missing(nodes: DataFrame, labels: DataFrame, classify: Callable[[list[str]], list[str]], known: list[str], batch: int = 2000) -> tuple[DataFrame, int]:
    """New labels ``(cluster_key, name)`` for nodes without a valid one, and how many remain beyond the batch.

    classify gives a fine topic for each name and is called once for each Arrow batch; answers that are no known topic are not kept.
    """
    valid = labels.where(F.col("name").isin(known)).select(F.lower("cluster_key").alias("id"))
    todo = nodes.select("id", "name").join(valid, "id", "left_anti")
    left = max(0, todo.count() - batch)
    schema = T.StructType([T.StructField("cluster_key", T.StringType()), T.StructField("name", T.StringType())])

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"cluster_key": pdf["id"], "name": classify(list(pdf["name"]))})

    return todo.orderBy("id").limit(batch).mapInPandas(run, schema).where(F.col("name").isin(known)), left


def cluster_signature(ids) -> F.Column:
    """A name for a set of nodes: SHA-1 of its sorted ids."""
    return F.sha1(F.array_join(F.array_sort(ids), "|"))
