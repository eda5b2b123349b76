"""Recommendations: candidates from several rules, ranked together. Rules are data steps; their wording is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loamgraph.functions.text import has_signal, is_noise_capture, is_trivial_name, or_empty
from loamgraph.operators import graph, ranking, records, retrieval, search, trends
from loamgraph.providers import Answerer, answered
from loamgraph.runtime import cut, tidy
from loamgraph.schemas import OTHER_TOPIC

def _candidates(df: DataFrame, kind: str, base: float, pos: int, semantic=0.0, graph_signal=0.0, text=None) -> DataFrame:
    """text: what the keyword signal is asked about; none for rules without one."""
    num = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return df.select("grp", "id", F.lit(kind).alias("type"), num(semantic).alias("semantic"), F.lit(0.0).alias("keyword"), num(graph_signal).alias("graph"), F.lit(base).alias("base"), F.lit(pos).alias("pos"), (F.lit("") if text is None else text).alias("text"))


def _titled(unnamed: str = "") -> Column:
    """A capture's title, with what tells which of two captures is the newer one."""
    return F.struct((-F.unix_micros("created_at")).alias("at"), "id", F.coalesce(F.nullif("title", F.lit("")), F.lit(unnamed)).alias("title"))


def _both_titles(a: str, b: str) -> Column:
    """The titles of two captures, that of the newer one first."""
    order = lambda t: F.struct(F.col(f"{t}.at").isNull().alias("n"), F.col(f"{t}.at"), F.col(f"{t}.id"))
    x, y = F.col(f"{a}.title"), F.col(f"{b}.title")
    return F.when(order(a) > order(b), F.concat_ws(" ", y, x)).otherwise(F.concat_ws(" ", x, y))


def _titles(pairs: DataFrame, signal: DataFrame, a: str, b: str, unnamed: str = "") -> DataFrame:
    """``pairs`` of captures with their titles as ``text``, that of the newer capture first."""
    t = signal.select("grp", "id", _titled(unnamed).alias("t"))
    both = pairs.join(t.withColumnsRenamed({"id": a, "t": "_a"}), ["grp", a]).join(t.withColumnsRenamed({"id": b, "t": "_b"}), ["grp", b])
    return both.withColumn("text", _both_titles("_a", "_b")).drop("_a", "_b")


def signal_captures(captures: DataFrame, n: int = 40) -> DataFrame:
    """The n newest captures of each scope that say something, as ``grp``; what the rules ask of them."""
    sound = captures.where(~is_noise_capture("title", "summary", "content", "tags")).withColumn("grp", F.col("scope_id"))
    asked = ("grp", "id", "title", "summary", "content", "tags", "created_at", "embedding")
    return records.newest(sound.select(*[c for c in asked if c in sound.columns]), n, partition=["grp"])


def review(signal: DataFrame, nodes: DataFrame) -> DataFrame:
    """Captures with a signal that no node comes from."""
    held = nodes.select(F.explode("source_captured_ids").alias("id")).where("id <> ''").select(F.lower("id").alias("id"))
    # as many as nodes have sources, which files tell little of: never in the driver
    rows = signal.where(has_signal("content", "summary", "tags")).join(held.hint("merge"), "id", "left_anti")
    return _candidates(rows.withColumn("id", F.concat(F.lit("review-"), "id")), "review", 0.4, 1, text=F.concat_ws(" ", or_empty("title"), or_empty("summary")))


def forming(signal: DataFrame, asof: Column, days: int = 7) -> DataFrame:
    """Themes on the rise or new, used at least twice lately and on two captures with some text."""
    t = trends.theme_directions(signal, asof, days, None, ["grp"]).where(F.col("direction").isin("up", "new") & (F.col("recent") >= 2)).where(~is_trivial_name("name"))
    long = trends.tag_rows(signal.where(F.greatest(F.length(F.coalesce("content", F.lit(""))), F.length(F.coalesce("summary", F.lit("")))) >= 24), "grp", "id")
    enough = long.groupBy("grp", F.col("tag").alias("name")).agg(F.countDistinct("id").alias("n")).where("n >= 2")
    return _candidates(t.join(enough, ["grp", "name"], "left_semi").withColumn("id", F.concat(F.lit("forming-"), "name")), "forming", 0.6, 4, text=F.col("name"))


def related(signal: DataFrame, n: int = 10) -> DataFrame:
    """Pairs with a tag in common among the n newest captures of a scope."""
    few = records.newest(signal, n, partition=["grp"]).select("grp", "id", "tags", _titled().alias("t"))
    x, y = few.withColumnsRenamed({"id": "a", "tags": "ta", "t": "_a"}), few.withColumnsRenamed({"id": "b", "tags": "tb", "t": "_b"})
    both = x.join(y, "grp").where((F.col("a") < F.col("b")) & F.coalesce(F.arrays_overlap("ta", "tb"), F.lit(False)))
    return _candidates(both.withColumn("id", F.concat_ws("-", F.lit("related"), "a", "b")), "related", 0.2, 5, text=_both_titles("_a", "_b"))


def dormant_nodes(signal: DataFrame, nodes: DataFrame, edges: DataFrame, asof: Column, days: int = 14, n: int = 4, iterations: int = 20) -> DataFrame:
    """Nodes near the recent captures' nodes that the scope's captures do not touch, by personalised rank."""
    held = graph.bridge(nodes).join(signal.select("grp", F.col("id").alias("capture_id"), "created_at"), "capture_id")
    seeds = held.where(F.unix_millis("created_at") >= F.unix_millis(asof) - days * 86_400_000).select("grp", F.col("node_id").alias("id"))
    active = held.select("grp", F.col("node_id").alias("id")).distinct()
    named = nodes.where(~is_trivial_name("name")).select("id")
    rank = graph.component_ranks(edges, seeds, best=n, listed=named, left_out=active, iterations=iterations).withColumn("rank", F.round("rank", 12))
    w = Window.partitionBy("grp")
    top = rank.withColumn("rn", F.row_number().over(w.orderBy(F.col("rank").desc(), "id"))).withColumn("most", F.max("rank").over(w)).where(F.col("rn") <= n)
    return _candidates(top.withColumn("id", F.concat(F.lit("knode-"), "id")), "knowledge_node", 0.7, 0, graph_signal=F.col("rank") / F.col("most"))


def dormant_topics(dormant: DataFrame, labels: DataFrame, n: int = 2) -> DataFrame:
    """Topics of which at least two of the best dormant nodes are members, by the sum of their ranks.

    dormant: the forty best, say, of :func:`dormant_nodes`; labels: ``(cluster_key, name)``.
    """
    named = dormant.withColumn("cluster_key", F.substring_index("id", "knode-", -1)).join(labels.where(F.col("name") != OTHER_TOPIC), "cluster_key")
    by = named.groupBy("grp", "name").agg(F.sum("graph").alias("s"), F.count("*").alias("k")).where("k >= 2").withColumn("s", F.round("s", 9))
    w = Window.partitionBy("grp")
    top = by.withColumn("rn", F.row_number().over(w.orderBy(F.col("s").desc(), "name"))).withColumn("most", F.max("s").over(w)).where(F.col("rn") <= n)
    return _candidates(top.withColumn("id", F.concat(F.lit("ktopic-"), "name")), "knowledge_topic", 0.75, 0, graph_signal=F.col("s") / F.col("most"))


def semantic_pairs(signal: DataFrame, threshold: float = 0.68, pool: int = 20, n: int = 15) -> DataFrame:
    """Similar captures without a tag in common among the newest of a scope; signal has ``embedding``."""
    got = search.similar_pairs(signal, ["grp"], threshold, n, pool)
    got = _titles(got, signal, "id_a", "id_b", "未命名")
    return _candidates(got.withColumn("id", F.concat_ws("-", F.lit("semantic"), "id_a", "id_b")), "semantic_pair", 0.3, 2, semantic=F.col("similarity"), text=F.col("text"))


def graph_bridges(signal: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = 18, iterations: int = 15) -> DataFrame:
    """Captures tied over a middle node, by its rank from the first capture's nodes; varied over middles and first captures."""
    ways = graph.two_hop_bridges(signal.select("grp", "id", "tags"), nodes, edges)
    say = nodes.where(~is_trivial_name("name")).select(F.col("id").alias("mid"))
    ways = cut(ways.join(say, "mid", "left_semi"))
    held = graph.bridge(nodes).withColumnRenamed("capture_id", "capture_a")
    seeds = ways.select("capture_a").distinct().join(held, "capture_a").select(F.col("capture_a").alias("grp"), F.col("node_id").alias("id"))
    middles = ways.select(F.col("capture_a").alias("grp"), F.col("mid").alias("id")).distinct()
    rank = graph.component_ranks(edges, seeds, middles, iterations=iterations).select(F.col("grp").alias("capture_a"), F.col("id").alias("mid"), F.round("rank", 9).alias("score"))
    scored = ways.join(rank, ["capture_a", "mid"]).withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("score").desc(), "capture_a", "capture_b"))).where(F.col("rn") <= n)
    short = scored.select("grp", F.concat_ws("-", F.lit("bridge"), "capture_a", "capture_b").alias("id"), "mid", F.col("capture_a").alias("first"), "capture_b", "score")
    kept = _titles(ranking.varied(short), signal, "first", "capture_b")
    return _candidates(kept, "graph_bridge", 0.2, 3, graph_signal=F.least(F.lit(1.0), 5 * F.col("score")), text=F.col("text"))


def implied_links(nodes: DataFrame, edges: DataFrame, n: int = 2) -> DataFrame:
    """Pairs of a scope's newest sixty nodes with neighbours in common but no link."""
    few = records.newest(nodes.where(~is_trivial_name("name")), 60, partition=["scope_id"]).select(F.col("scope_id").alias("grp"), "id")
    pairs = graph.implicit_pairs(few, edges)
    top = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("common").desc(), "a", "b"))).where(F.col("rn") <= n)
    return _candidates(top.withColumn("id", F.concat_ws("-", F.lit("implicit"), "a", "b")), "graph_bridge", 0.15, 3, graph_signal=0.4)


def recommend(captures: DataFrame, nodes: DataFrame, edges: DataFrame | None, asof: Column, feedback: DataFrame | None = None, labels: DataFrame | None = None, most: int = 6) -> DataFrame:
    """``(grp, id, type, score, place)``: the picked candidates of each scope.

    The rules on the graph join in where ``edges`` are given, those on topics where ``labels`` are, those on similarity where the
    captures have vectors.
    """
    signal = cut(signal_captures(captures))
    tidy(captures.sparkSession, wait_s=3)
    rules = [review(signal, nodes), forming(signal, asof), related(signal)]
    if "embedding" in captures.columns:
        rules.append(semantic_pairs(signal))
    if edges is not None:
        dormant = cut(dormant_nodes(signal, nodes, edges, asof, n=40))
        few = dormant.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("graph").desc(), "id"))).where("rn <= 4").drop("rn")
        rules += [few, graph_bridges(signal, nodes, edges), implied_links(nodes, edges)]
        if labels is not None:
            rules.append(dormant_topics(dormant, labels))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return ranking.picked(ranking.scored(keyword_scores(out, signal), feedback), most)


def reworded(picked: DataFrame, provider: Answerer, reason_col: str = "reason", longest: int = 80) -> DataFrame:
    """``picked`` with reasons as a language model puts them; where it fails, answers nothing, more than one line or too much, the reason as it is."""
    said = answered(picked, reason_col, provider).select("id", F.nullif(F.trim("answer"), F.lit("")).alias("_said"))
    said = said.where((F.length("_said") <= longest) & ~F.col("_said").contains("\n"))
    return picked.join(said, "id", "left").withColumn(reason_col, F.coalesce("_said", reason_col)).drop("_said")


def keyword_scores(candidates: DataFrame, signal: DataFrame) -> DataFrame:
    """``candidates`` with the keyword signal of their whole ``text``, which goes, over the signal captures of their scope."""
    docs = signal.select("grp", F.concat_ws(" ", or_empty("title"), or_empty("summary"), or_empty("content")).alias("text"))
    return ranking.with_keyword_signal(retrieval.bm25_within(docs, candidates.withColumnRenamed("text", "q_text")))
