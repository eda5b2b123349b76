"""The property graph as DataFrames: adjacency, degrees, bridges, paths, ranks, components.

Links are analysed as undirected, without repeats and self links, and only between known nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from loamgraph.runtime import cut, parallelism

#: Links times groups of a component that one task ranks, about.
RANKED_A_TASK = 50_000_000
#: Links times groups whose ranks are worked out at once.
RANKED_AT_ONCE = 1_000_000


def bridge(nodes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``(node_id, capture_id)``: the captures that a node comes from, once each."""
    rows = nodes.select(F.col("id").alias("node_id"), *(keep or []), F.explode("source_captured_ids").alias("capture_id"))
    return rows.where(F.col("capture_id").isNotNull() & (F.col("capture_id") != "")).withColumn("capture_id", F.lower("capture_id")).distinct()


def undirected(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(a, b)``, a before b: distinct undirected links, self links dropped, both ends among ``nodes (id)`` where given."""
    s, t = F.lower("source"), F.lower("target")
    edges = links.select(F.least(s, t).alias("a"), F.greatest(s, t).alias("b")).where("a <> b").distinct()
    if nodes is not None:
        known = nodes.select(F.col("id").alias("a")).distinct()
        edges = edges.join(known, "a", "left_semi").join(known.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
    return edges


def adjacency(edges: DataFrame) -> DataFrame:
    """``(src, dst)``, both ways."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.src", "e.dst")


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, degree)`` of the nodes with a link."""
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def degrees_by_name(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(name, degree)``: ends of links at nodes of a name, parallel links and both ends of a self link counted each."""
    ends = links.select(F.explode(F.array(F.lower("source"), F.lower("target"))).alias("id"))
    return ends.join(nodes.select("id", "name"), "id").groupBy("name").agg(F.count("*").alias("degree"))


def depth_profile(nodes: DataFrame, edges: DataFrame, shallow_sources: int = 2, deep_degree: int = 3) -> DataFrame:
    """``(id, n_sources, degree, depth)``: 'shallow' with sources but no link, 'deep' with many links; others left out."""
    n = nodes.select("id", F.size(F.array_distinct(F.filter(F.coalesce("source_captured_ids", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))).alias("n_sources"))
    out = n.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    depth = F.when(F.col("degree") >= deep_degree, "deep").when((F.col("n_sources") >= shallow_sources) & (F.col("degree") == 0), "shallow")
    return out.withColumn("depth", depth).where(F.col("depth").isNotNull())


def implicit_pairs(candidates: DataFrame, edges: DataFrame, min_common: int = 2) -> DataFrame:
    """``(grp, a, b, common)``: pairs of one group's candidates with neighbours in common but no link of their own.

    candidates: ``(grp, id)``, few a group (the newest sixty, say), which bounds the pairs that a much linked neighbour gives.
    """
    adj = adjacency(edges)
    near = candidates.join(adj.withColumnRenamed("src", "id"), "id").select("grp", "id", F.col("dst").alias("mid"))
    x, y = near.withColumnRenamed("id", "a"), near.withColumnRenamed("id", "b")
    pairs = x.join(y, ["grp", "mid"]).where("a < b").groupBy("grp", "a", "b").agg(F.countDistinct("mid").alias("common")).where(F.col("common") >= min_common)
    return pairs.join(edges, ["a", "b"], "left_anti").select("grp", "a", "b", "common")


def two_hop_bridges(captures: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(grp, capture_a, capture_b, node_a, mid, node_b)``: for each pair of a group's captures the first way over a middle node.

    captures: ``(grp, id, tags)``, few a group. The middle node belongs to neither capture, the ends differ, and captures
    that share a tag, without letter case, are no pair. First is the least node_a, then mid, then node_b.
    """
    low = cut(captures.select("grp", "id", F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t)).alias("tags")))
    held = cut(bridge(nodes).join(low.select("grp", F.col("id").alias("capture_id")), "capture_id"))
    adj = adjacency(edges)
    own = held.select("capture_id", F.col("node_id").alias("mid")).distinct()
    one = held.join(adj.withColumnRenamed("src", "node_id"), "node_id").select("grp", "capture_id", "node_id", F.col("dst").alias("mid"))
    one = cut(one.join(own, ["capture_id", "mid"], "left_anti"))
    x = one.withColumnsRenamed({"capture_id": "capture_a", "node_id": "node_a"})
    y = one.withColumnsRenamed({"capture_id": "capture_b", "node_id": "node_b"})
    ways = x.join(y, ["grp", "mid"]).where("capture_a < capture_b AND node_a <> node_b")
    best = ways.groupBy("grp", "capture_a", "capture_b").agg(F.min(F.struct("node_a", "mid", "node_b")).alias("w"))
    tags = low.where(F.col("grp").isNotNull()).groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("id", "tags"))).alias("tags"))  # one shuffle of the pairs, not two
    out = best.join(tags, "grp").withColumns({"ta": F.col("tags")[F.col("capture_a")], "tb": F.col("tags")[F.col("capture_b")]})
    return out.where((F.size(F.array_intersect("ta", "tb")) == 0)).select("grp", "capture_a", "capture_b", "w.node_a", "w.mid", "w.node_b")


def distances(edges: DataFrame, seeds: DataFrame, max_depth: int = 6) -> DataFrame:
    """``(id, depth, prev)`` of the nodes within ``max_depth`` links of a seed: frontier joins that stop once nothing is new.

    prev is the smallest neighbour that is one link closer; null for seeds.
    """
    adj = cut(adjacency(edges))
    seen = cut(seeds.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("prev")))
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.select(F.col("id").alias("src")).join(adj, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("prev"))
        frontier = cut(reached.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth"), "prev"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 3 == 0:
            seen = cut(seen)
    return seen


def shortest_paths(found: DataFrame, nodes: DataFrame, max_depth: int = 6) -> DataFrame:
    """``(id, depth, path)``: the names from each reached node to its seed, both ends included."""
    name = nodes.select("id", "name")
    out = found.join(name, "id").select("id", "depth", F.col("prev").alias("at"), F.array("name").alias("path"))
    step = found.join(name, "id").select(F.col("id").alias("at"), F.col("prev").alias("next"), F.col("name").alias("n"))
    for _ in range(max_depth):
        out = out.join(step, "at", "left").select("id", "depth", F.col("next").alias("at"), F.when(F.col("n").isNull(), F.col("path")).otherwise(F.concat("path", F.array("n"))).alias("path"))
    return out.drop("at")


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, iterations: int = 20, cut_every: int = 5) -> DataFrame:
    """``(grp, id, rank)``: ranks from the seeds ``(grp, id)`` of each group at once, scaled to sum 1 in every iteration.

    Only reached nodes have a row. Mass is lost only at seeds without a link, which have nothing but their own share of
    the restart; so the sum of an iteration follows from their share u alone, and an iteration is one join and one aggregation.
    """
    adj = adjacency(edges)
    out_degree = adj.groupBy("src").agg(F.count("*").alias("deg"))
    adj = cut(adj.join(out_degree, "src"))
    seeds = seeds.select("grp", "id").distinct().withColumn("tp", F.lit(1.0) / F.count("*").over(Window.partitionBy("grp")))
    linked = adj.select(F.col("src").alias("id")).distinct().withColumn("linked", F.lit(True))
    start = seeds.join(linked, "id", "left")
    lost = start.groupBy("grp").agg(F.coalesce(F.sum(F.when(F.col("linked").isNull(), F.col("tp"))), F.lit(0.0)).alias("u"))
    start = cut(start.join(lost, "grp").select("grp", "id", "tp", "u"))
    rank, unlinked = start.select("grp", "id", F.col("tp").alias("rank"), "u"), F.col("u")
    for i in range(iterations):
        total = 1 - alpha * unlinked
        flow = rank.join(adj, rank["id"] == adj["src"]).select("grp", F.col("dst").alias("id"), (F.col("rank") * alpha / F.col("deg")).alias("v"), "u")
        back = start.select("grp", "id", (F.col("tp") * (1 - alpha)).alias("v"), "u")
        rank = flow.unionByName(back).groupBy("grp", "id").agg(F.sum("v").alias("v"), F.max("u").alias("u")).select("grp", "id", (F.col("v") / total).alias("rank"), "u")
        unlinked = F.col("u") * (1 - alpha) / total
        if (i + 1) % cut_every == 0:
            rank = cut(rank)
    return rank.drop("u")


def component_ranks(edges: DataFrame, seeds: DataFrame, wanted: DataFrame | None = None, best: int = 0, listed: DataFrame | None = None, left_out: DataFrame | None = None, alpha: float = 0.85, iterations: int = 20) -> DataFrame:
    """``(grp, id, rank)`` as of :func:`personalized_pagerank`, of the pairs ``wanted (grp, id)`` that are reached; or, without these, of the
    ``best`` of each group and component among the nodes ``listed (id)`` less the pairs ``left_out (grp, id)``, with those that come
    within 1e-11 of them. Of nodes with a link only.

    Ranks never leave a component, so each is worked out whole by the tasks that hold its links, some of the groups each; only the ranks that
    are asked for leave a task, not those of every node that a group reaches. The links of a component have to fit the memory of a task.
    """
    at = components(edges)
    seeds = seeds.select("grp", "id").distinct().withColumn("tp", F.lit(1.0) / F.count("*").over(Window.partitionBy("grp")))
    seeds = cut(seeds.join(at, "id", "left"))
    lost = seeds.groupBy("grp").agg(F.coalesce(F.sum(F.when(F.col("component").isNull(), F.col("tp"))), F.lit(0.0)).alias("u"))
    links = edges.join(at.withColumnRenamed("id", "a"), "a")
    size = links.groupBy("component").agg(F.count("*").alias("n")).join(seeds.groupBy("component").agg(F.countDistinct("grp").alias("k")), "component")
    parts = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") * F.col("k") / RANKED_A_TASK), F.lit(16 * parallelism(edges.sparkSession)))).cast("int")
    size = cut(size.select("component", parts.alias("parts")))
    every, one = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), F.pmod(F.xxhash64("grp"), F.col("parts").cast("long")).cast("int")
    none, zero = F.lit(None).cast("string"), F.lit(0.0)

    def rows(df: DataFrame, what: str, part, x, y, tp=zero, u=zero) -> DataFrame:
        return df.join(size, "component").select("component", part.alias("part"), F.lit(what).alias("what"), x.alias("x"), y.alias("y"), tp.alias("tp"), u.alias("u"))

    pair = F.col("grp"), F.col("id")
    told = rows(links, "link", every, F.col("a"), F.col("b")).unionByName(rows(seeds.join(lost, "grp"), "seed", one, *pair, F.col("tp"), F.col("u")))
    if wanted is not None:
        told = told.unionByName(rows(wanted.join(at, "id"), "wanted", one, *pair))
    else:
        told = told.unionByName(rows(listed.join(at, "id"), "listed", every, none, F.col("id"))).unionByName(rows(left_out.join(at, "id"), "left out", one, *pair))

    def work(t: pa.Table) -> pa.Table:
        of = {w: t.filter(pc.equal(t["what"], w)).combine_chunks() for w in ("link", "seed", "wanted", "listed", "left out")}
        got = list(_ranked(of, alpha, iterations, best)) if len(of["seed"]) else []
        return pa.concat_tables(got) if got else pa.table({"grp": pa.array([], pa.string()), "id": pa.array([], pa.string()), "rank": pa.array([], pa.float64())})

    return told.groupBy("component", "part").applyInArrow(work, "grp string, id string, rank double")


def _ranked(of: dict[str, pa.Table], alpha: float, iterations: int, best: int) -> Iterator[pa.Table]:
    """The ranks that are asked for in a component, by some groups at once; of: its rows by what they tell."""
    ids, groups = pc.unique(pa.concat_arrays([*of["link"]["x"].chunks, *of["link"]["y"].chunks])), pc.unique(of["seed"]["x"]).sort()
    number = lambda c, among: pc.index_in(c, among).to_numpy(zero_copy_only=False).astype(np.float64)  # noqa: E731  # nulls are NaN
    a, b = (number(of["link"][c], ids).astype(np.int64) for c in "xy")
    src, dst = np.r_[a, b], np.r_[b, a]
    order = np.argsort(dst, kind="stable")
    src, first = src[order], np.searchsorted(dst[order], np.arange(len(ids)))  # every node has a link
    share = alpha / np.bincount(src, minlength=len(ids))[:, None]
    pairs = {}
    for w in ("seed", "wanted", "left out"):
        g, i = number(of[w]["x"], groups), number(of[w]["y"], ids)
        ok = np.flatnonzero(~np.isnan(g) & ~np.isnan(i))
        by = ok[np.argsort(g[ok], kind="stable")]
        pairs[w] = g[by].astype(np.int64), i[by].astype(np.int64), by
    _, _, by = pairs["seed"]
    tp, u = (of["seed"][c].to_numpy()[by] for c in ("tp", "u"))
    shown = np.zeros(len(ids), dtype=bool)
    shown[number(of["listed"]["y"], ids).astype(np.int64)] = True
    step = max(1, RANKED_AT_ONCE // len(src))
    for lo in range(0, len(groups), step):
        hi = min(lo + step, len(groups))
        own = {w: slice(*np.searchsorted(g, [lo, hi])) for w, (g, _, _) in pairs.items()}
        col, row = pairs["seed"][0][own["seed"]] - lo, pairs["seed"][1][own["seed"]]
        back, lost = np.zeros((len(ids), hi - lo)), np.zeros(hi - lo)
        back[row, col], lost[col] = tp[own["seed"]], u[own["seed"]]
        rank, unlinked = back, lost
        for _ in range(iterations):
            total = 1 - alpha * unlinked
            rank = (np.add.reduceat((rank * share)[src], first, axis=0) + back * (1 - alpha)) / total
            unlinked = lost * (1 - alpha) / total
        if best:
            open_ = np.where(shown[:, None] & (rank > 0), rank, -1.0)
            open_[pairs["left out"][1][own["left out"]], pairs["left out"][0][own["left out"]] - lo] = -1.0
            k = max(0, len(ids) - best)
            row, col = np.nonzero((open_ > 0) & (open_ >= np.partition(open_, k, axis=0)[k] - 1e-11))
        else:
            col, row = pairs["wanted"][0][own["wanted"]] - lo, pairs["wanted"][1][own["wanted"]]
            reached = rank[row, col] > 0
            row, col = row[reached], col[reached]
        yield pa.table({"grp": groups.take(pa.array(col + lo)), "id": ids.take(pa.array(row)), "rank": pa.array(rank[row, col])})


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(id, component)``: the smallest id that a node is linked to by any way.

    Labels take the least of the neighbours' and jump to their label's label, so rounds grow with the logarithm of the diameter.
    """
    adj = cut(adjacency(edges))
    label = cut(adj.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    for _ in range(max_rounds):
        near = adj.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("c"))
        step = label.join(near, "id").select("id", F.least("component", "c").alias("new"), "component")
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("next"))
        moved = cut(step.join(jump, "new", "left").select("id", F.least("new", F.coalesce("next", "new")).alias("new"), "component"))
        same = moved.where("new <> component").isEmpty()
        label = moved.select("id", F.col("new").alias("component"))
        if same:
            return label
    raise RuntimeError("components did not settle")


def component_of(edges: DataFrame, start: str) -> DataFrame:
    """``(id)`` of the nodes linked to ``start`` by any way, itself included."""
    all_ = components(edges)
    mine = all_.where(F.col("id") == start.lower()).select("component")
    return all_.join(mine, "component", "left_semi").select("id")
