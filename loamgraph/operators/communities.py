"""Communities by greedy modularity, and the topic hierarchy above them.

Merging two communities without a link between them never gains, so components are worked on apart, each by a kernel
that keeps the gains in a heap; the number of links of the whole graph goes in as a constant. For graphs with a component that no
task can hold there is :func:`detect_in_rounds`, which merges many pairs at once; callers choose between them, nothing switches by size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from loamgraph.functions.scores import evolution
from loamgraph.functions.text import is_trivial_name
from loamgraph.operators.graph import components, degrees
from loamgraph.runtime import cut, written
from loamgraph.schemas import OTHER_TOPIC

_MEMBERS = T.StructType([T.StructField("id", T.StringType()), T.StructField("community", T.StringType())])


def greedy_modularity(edges: Iterable[tuple[str, str]], m: int, max_merges: int | None = None) -> dict[str, str]:
    """The community of each node, named by its smallest member.

    The pair with the largest gain ``links * 2m - degree * degree`` is merged while that is positive; of equal ones
    the pair whose names come first. A gain only grows where two links become one, so the heap gets a pair anew only then;
    other entries are upper bounds, put right when they come up.
    """
    links: dict[str, dict[str, int]] = {}
    for a, b in edges:
        links.setdefault(a, {})[b] = links.setdefault(a, {}).get(b, 0) + 1
        links.setdefault(b, {})[a] = links.setdefault(b, {}).get(a, 0) + 1
    weight = {n: sum(to.values()) for n, to in links.items()}
    parent = {n: n for n in links}
    gain = lambda a, b: links[a][b] * 2 * m - weight[a] * weight[b]
    heap = [(-gain(a, b), a, b) for a in links for b in links[a] if a < b and gain(a, b) > 0]
    heapq.heapify(heap)
    merges = 0
    while heap and (max_merges is None or merges < max_merges):
        g, a, b = heapq.heappop(heap)
        if a not in links or b not in links[a]:
            continue
        if g >= 0:
            break
        now = gain(a, b)
        if now != -g:
            if 0 < now < -g:  # less since it was put in
                heapq.heappush(heap, (-now, a, b))
            continue  # more: its current value is in the heap too
        merges += 1
        parent[b] = a
        taken = links.pop(b)
        del links[a][b]
        del taken[a]
        weight[a] += weight.pop(b)
        for c, n in taken.items():
            del links[c][b]
            links[a][c] = links[a].get(c, 0) + n
            links[c][a] = links[a][c]
            x, y = (a, c) if a < c else (c, a)
            if (now := gain(x, y)) > 0:
                heapq.heappush(heap, (-now, x, y))

    def root(n: str) -> str:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    return {n: root(n) for n in parent}


def detect(edges: DataFrame, max_merges: int | None = None, component_edges: int | None = None) -> DataFrame:
    """``(id, community)`` of every linked node of ``edges (a, b)``.

    Every component, of whatever size, goes through the same kernel in one task. component_edges is still taken from callers
    and has no bearing on the result.
    """
    edges = cut(edges)
    m = edges.count()
    placed = edges.join(components(edges).withColumnRenamed("id", "a"), "a")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        got = greedy_modularity(zip(pdf["a"], pdf["b"]), m, max_merges)
        return pd.DataFrame({"id": list(got), "community": list(got.values())})

    return placed.groupBy("component").applyInPandas(kernel, _MEMBERS)


def modularity(members: DataFrame, edges: DataFrame) -> float:
    """Modularity of ``members (id, community)`` over ``edges (a, b)``; 0 without links."""
    c = members.select(F.col("id").alias("a"), F.col("community").alias("ca"))
    both = edges.join(c, "a").join(c.toDF("b", "cb"), "b")
    inner = both.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inner"))
    ends = both.select(F.explode(F.array("ca", "cb")).alias("community")).groupBy("community").agg(F.count("*").alias("ends"))
    m = edges.count()
    return ends.join(inner, "community", "left").agg(F.coalesce(F.sum(F.coalesce("inner", F.lit(0)) / m - (F.col("ends") / (2.0 * m)) ** 2), F.lit(0.0))).head()[0] if m else 0.0


def detect_in_rounds(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``(id, community)`` as :func:`detect`, by merges that all gain, many at once, so that a component of any size is worked on by all tasks.

    In a round each community looks for the neighbour that it gains most by. Of two that look at each other the heavier is a head; whoever
    looks at a head merges into it, as long as the head, which grows meanwhile, is still a gain to them: followers are taken by falling ratio of
    links to weight, from sums of their weights by ratio, so that a head with very many followers is never gathered. Equal gains go by a hash of the pair. A
    round merges at least the best pair of each component; the communities are named by their smallest member.
    """
    edges = written(edges.select("a", "b"))
    m2 = 2.0 * edges.count()
    weight = written(degrees(edges).select(F.col("id").alias("c"), F.col("degree").cast("double").alias("w")))
    members = written(weight.select(F.col("c").alias("id"), "c"))
    links = edges.select("a", "b", F.lit(1.0).alias("n"))
    for _ in range(most_rounds):
        g = links.join(weight.toDF("a", "wa"), "a").join(weight.toDF("b", "wb"), "b").withColumn("gain", F.col("n") * m2 - F.col("wa") * F.col("wb")).where("gain > 0")
        g = g.withColumn("tie", F.xxhash64("a", "b"))
        both = g.select(F.col("a").alias("c"), F.col("b").alias("o"), "n", F.col("wa").alias("w"), F.col("wb").alias("wo"), "gain", "tie").unionByName(g.select(F.col("b").alias("c"), F.col("a").alias("o"), "n", F.col("wb").alias("w"), F.col("wa").alias("wo"), "gain", "tie"))
        best = written(both.groupBy("c").agg(F.max(F.struct("gain", "tie", "o", "n", "w", "wo")).alias("x")).select("c", "x.o", "x.n", "x.w", "x.wo"))
        if best.isEmpty():
            break
        mutual = best.join(best.select(F.col("c").alias("o"), F.col("o").alias("c")), ["c", "o"])
        heads = written(mutual.where((F.col("w") > F.col("wo")) | (F.col("w") == F.col("wo")) & (F.col("c") < F.col("o"))).select(F.col("c").alias("head"), F.col("o").alias("partner"), (F.col("w") + F.col("wo")).alias("base")))
        follow = best.join(heads, best["o"] == heads["head"]).where("c <> partner").withColumn("ratio", F.col("n") * m2 / F.col("w")).withColumn("step", F.floor(F.log2("ratio") * 8).cast("int")).select("c", "head", "base", "w", "ratio", "step")
        follow = written(follow.join(heads.select(F.col("head").alias("c")), "c", "left_anti"))
        sums = follow.groupBy("head", "step").agg(F.sum("w").alias("sum"), F.min("ratio").alias("least"), F.first("base").alias("base"))
        before = F.coalesce(F.sum("sum").over(Window.partitionBy("head").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("least") - F.col("base") - before) / F.col("sum")))
        part = sums.withColumn("share", share).select("head", "step", "share")  # as many rows a head as steps of the ratio
        taken = follow.join(part, ["head", "step"]).where((F.col("share") >= 1) | (F.pmod(F.xxhash64("c", F.lit(5)), F.lit(1 << 20)) < F.col("share") * (1 << 20)))
        to = written(taken.select("c", F.col("head").alias("to")).unionByName(heads.select(F.col("partner").alias("c"), F.col("head").alias("to"))))
        now = lambda df, c: df.join(to.toDF(c, "_to"), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        a, b = F.least("a", "b"), F.greatest("a", "b")
        links = now(now(links, "a"), "b").where("a <> b").select(a.alias("x"), b.alias("y"), "n").groupBy("x", "y").agg(F.sum("n").alias("n")).toDF("a", "b", "n")
        links, weight, members = written(links), written(now(weight, "c").groupBy("c").agg(F.sum("w").alias("w"))), written(now(members, "c"))
    else:
        raise RuntimeError("communities did not settle")
    names = members.groupBy("c").agg(F.min("id").alias("community"))
    return members.join(names, "c").select("id", "community")


def describe(members: DataFrame, nodes: DataFrame, edges: DataFrame, asof, recent_days: int = 7, min_nodes: int = 2) -> DataFrame:
    """``(community, name, n_nodes, n_captures, recent_nodes, older_nodes, recent_captures, evolution)``.

    The name is that of the member with the most links among those whose name says something; ties go to the smaller id.
    """
    m = members.join(nodes.select("id", "name", "created_at", "source_captured_ids"), "id").join(degrees(edges), "id", "left")
    recent = F.coalesce(F.unix_millis("created_at") >= F.unix_millis(asof) - recent_days * 86_400_000, F.lit(False))
    m = m.withColumn("recent", recent)
    named = F.min(F.struct(is_trivial_name("name").cast("int").alias("t"), (-F.coalesce("degree", F.lit(0))).alias("d"), "id", "name"))
    heads = m.groupBy("community").agg(F.count("*").alias("n_nodes"), F.count_if("recent").alias("recent_nodes"), F.count_if(~F.col("recent")).alias("older_nodes"), named["name"].alias("name"))
    refs = m.select("community", "recent", F.explode("source_captured_ids").alias("c")).where("c IS NOT NULL AND c <> ''").withColumn("c", F.lower("c"))
    caps = refs.groupBy("community", "c").agg(F.max("recent").alias("r")).groupBy("community").agg(F.count("*").alias("n_captures"), F.count_if("r").alias("recent_captures"))
    out = heads.join(caps, "community", "left").fillna(0, ["n_captures", "recent_captures"]).where(F.col("n_nodes") >= min_nodes)
    return out.withColumn("evolution", evolution("n_nodes", "recent_nodes", "older_nodes"))


def absorbed(members: DataFrame, edges: DataFrame, min_nodes: int = 3) -> DataFrame:
    """``(id, topic)``: members of small communities move to the topic that most of their neighbours are in.

    One round for all at once; the smaller topic wins ties, and those without a neighbour in a topic go to 'other'.
    """
    sizes = members.groupBy("community").agg(F.count("*").alias("n"))
    kept = members.join(sizes.where(F.col("n") >= min_nodes), "community", "left_semi").select("id", F.col("community").alias("topic"))
    rest = members.join(kept, "id", "left_anti").select("id")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    votes = rest.join(both.withColumnRenamed("a", "id"), "id").join(kept.withColumnsRenamed({"id": "b"}), "b").groupBy("id", "topic").agg(F.count("*").alias("n"))
    won = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "topic"))["topic"].alias("topic"))
    return kept.unionByName(rest.join(won, "id", "left").select("id", F.coalesce("topic", F.lit("other")).alias("topic")))


def hierarchy(edges: DataFrame, split_over: int = 25, min_nodes: int = 3, in_rounds: bool = False) -> DataFrame:
    """``(id, super_topic, topic)``: communities, and within those of more than ``split_over`` members their own communities.

    A large community is only cut where at least two parts come out; else its topic is itself. in_rounds: by :func:`detect_in_rounds`, for
    components and communities that no task can hold; the links of all large communities are then one graph, cut along its components.
    """
    top = cut(absorbed(detect_in_rounds(edges) if in_rounds else detect(edges), edges, min_nodes).withColumnRenamed("topic", "super_topic"))
    big = top.where("super_topic <> 'other'").groupBy("super_topic").agg(F.count("*").alias("n")).where(F.col("n") > split_over)
    inside = edges.join(top.withColumnsRenamed({"id": "a", "super_topic": "s"}), "a").join(top.withColumnsRenamed({"id": "b", "super_topic": "t"}), "b").where("s = t").join(big.select(F.col("super_topic").alias("s")), "s", "left_semi")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        got = greedy_modularity(list(zip(pdf["a"], pdf["b"])), len(pdf))
        return pd.DataFrame({"id": list(got), "community": list(got.values())})

    parts = cut(detect_in_rounds(inside.select("a", "b")) if in_rounds else inside.select("s", "a", "b").groupBy("s").applyInPandas(kernel, _MEMBERS))
    sized = parts.withColumn("n", F.count("*").over(Window.partitionBy("community")))
    sub = top.join(sized.where(F.col("n") >= min_nodes).select("id", "community"), "id", "left")
    several = sub.groupBy("super_topic").agg(F.countDistinct("community").alias("k"))
    return sub.join(several, "super_topic").select("id", "super_topic", F.when(F.col("k") >= 2, F.coalesce("community", F.concat("super_topic", F.lit("-rest")))).otherwise(F.col("super_topic")).alias("topic"))


def semantic_hierarchy(nodes: DataFrame, labels: DataFrame, topics: DataFrame) -> DataFrame:
    """``(broad, fine, n_nodes)``: nodes by their fine topic and the broad one above it; without a known label they are 'other'.

    labels: ``(cluster_key, name)``, one a node; topics: ``(fine, broad)``, a fixed list that is broadcast.
    """
    fine = nodes.select("id").join(labels.select(F.lower("cluster_key").alias("id"), F.col("name").alias("fine")), "id", "left")
    placed = fine.join(F.broadcast(topics.select("fine", "broad")), "fine", "left")
    known = F.col("broad").isNotNull()
    return placed.select(F.when(known, F.col("broad")).otherwise(OTHER_TOPIC).alias("broad"), F.when(known, F.col("fine")).otherwise(OTHER_TOPIC).alias("fine")).groupBy("broad", "fine").agg(F.count("*").alias("n_nodes"))
