"""A period's summary: what was made, what changed, in which direction themes go, which communities grew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loamgraph.functions.text import clip, is_noise_capture, is_trivial_name
from loamgraph.operators import communities, graph, records, trends


@dataclass
class Summary:
    changes: DataFrame
    themes: DataFrame
    weeks: DataFrame
    excerpts: DataFrame
    hubs: DataFrame
    communities: DataFrame
    enough: bool


def summarize(captures: DataFrame, nodes: DataFrame, links: DataFrame, asof: Column, days: int = 7, least: int = 3) -> Summary:
    """The deterministic facts of the ``days`` before asof; ``enough`` is false where fewer than ``least`` captures say something."""
    now = captures.where(trends.period_of("created_at", asof, days) == "recent")
    sound = now.where(~is_noise_capture("title", "summary", "content", "tags"))
    directions = trends.theme_directions(captures, asof, days, days if days <= 15 else None, min_total=2 if days <= 15 else 3).where(~is_trivial_name("name"))
    edges = graph.undirected(links, nodes)
    hubs = nodes.where(trends.period_of("created_at", asof, days) == "recent").select("id", "name", F.size("source_captured_ids").alias("n_sources")).where(~is_trivial_name("name"))
    found = communities.describe(communities.detect(edges), nodes, edges, asof, max(1, -(-days // 2)))
    return Summary(
        changes=trends.period_changes({"captures": captures, "nodes": nodes, "links": links}, asof, days),
        themes=trends.theme_quota(directions, [], {"up": 3, "new": 3, "down": 4}),
        weeks=trends.weekly_timeline(captures, asof),
        excerpts=records.newest(sound, 3).select("id", "title", clip(F.coalesce(F.nullif("summary", F.lit("")), "content"), 120).alias("excerpt")),
        hubs=hubs.orderBy(F.col("n_sources").desc(), "id").limit(5),
        communities=found.orderBy(F.col("n_nodes").desc(), F.col("n_captures").desc(), "community").limit(4),
        enough=sound.limit(least).count() >= least,
    )


def trend_list(changes: DataFrame, directions: DataFrame, most: int = 5) -> DataFrame:
    """``(pos, trend, direction, now, before, percent, names)``: what changed, in order: activity, growth of nodes and of links, themes.

    changes: as :func:`trends.period_changes` gives them for 'captures', 'nodes' and 'links'; directions: ``(name, recent, older, total,
    direction)``. Activity always has a row where there is any; nodes where they grew or shrank by 30 % and more, links where they grew so;
    themes that rise, are new or fall with at most two names.
    """
    kept = changes.where("measure = 'captures' AND change IS NOT NULL OR measure = 'nodes' AND change IN ('up', 'down') OR measure = 'links' AND change = 'up'")
    pos = F.when(F.col("measure") == "captures", 0).when(F.col("measure") == "nodes", 1).otherwise(2)
    none = F.array().cast("array<string>")
    a = kept.select(pos.alias("pos"), F.col("measure").alias("trend"), F.col("change").alias("direction"), "now", "before", "percent", none.alias("names"))
    quota = trends.theme_quota(directions.where("direction <> 'stable'"), [], {"up": 2, "new": 2, "down": 2})
    names = F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"])
    t = quota.groupBy("direction").agg(names.alias("names"), F.sum("recent").alias("now"), F.sum("older").alias("before"))
    order = F.when(F.col("direction") == "up", 3).when(F.col("direction") == "new", 4).otherwise(5)
    b = t.select(order.alias("pos"), F.lit("themes").alias("trend"), "direction", "now", "before", F.lit(None).cast("long").alias("percent"), "names")
    return a.unionByName(b).orderBy("pos").limit(most)


def next_actions(changes: DataFrame, directions: DataFrame, hubs: DataFrame, tags: DataFrame) -> DataFrame:
    """``(pos, action, subject, now, before, names)``: the facts behind what to do next; their wording is left to the caller.

    changes, directions: as of :func:`trend_list`; hubs: ``(id, name, n_sources)``; tags: ``(tag, n)`` of the period. Actions: 'record' where
    there is little or nothing (at most three captures), 'link' where captures made no node, 'deepen' for the two themes most used of those that rise or are
    new and were used twice, 'resume' for the falling one that was used most, 'review' for the first hub with the three most used tags, 'keep' where
    activity rose by 30 % and more.
    """
    none = F.array().cast("array<string>")
    nothing = F.lit(None).cast("string")
    row = lambda df, pos, action, subject=nothing, now=F.lit(None).cast("long"), before=F.lit(None).cast("long"), names=none: df.select(F.lit(pos).alias("pos"), F.lit(action).alias("action"), subject.alias("subject"), now.cast("long").alias("now"), before.cast("long").alias("before"), names.alias("names"))
    made = changes.agg(*[F.coalesce(F.max(F.when(F.col("measure") == m, F.col(c))), F.lit(0)).alias(f"{m}_{c}") for m in ("captures", "nodes") for c in ("now", "before")], F.max(F.when(F.col("measure") == "captures", F.col("change"))).alias("activity"))
    rising = directions.where("direction IN ('up', 'new') AND recent >= 2").orderBy(F.col("recent").desc(), "name").limit(2)
    falling = directions.where("direction = 'down'").orderBy(F.col("older").desc(), "name").limit(1)
    top = tags.orderBy(F.col("n").desc(), "tag").limit(3).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "tag"))), lambda x: x["tag"]).alias("names"))
    hub = hubs.orderBy(F.col("n_sources").desc(), "id").limit(1).crossJoin(F.broadcast(top))  # one row each
    parts = [
        row(made.where("captures_now <= 3"), 1, "record", now=F.col("captures_now"), before=F.col("captures_before")),
        row(made.where("nodes_now = 0 AND captures_now > 0"), 2, "link", now=F.col("captures_now")),
        row(rising, 3, "deepen", F.col("name"), F.col("recent"), F.col("older"), F.array("direction")),
        row(falling, 4, "resume", F.col("name"), F.col("recent"), F.col("older")),
        row(hub, 5, "review", F.col("name"), F.col("n_sources"), names=F.col("names")),
        row(made.where("activity = 'up'"), 6, "keep", now=F.col("captures_now"), before=F.col("captures_before")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def change_lines(changes: DataFrame) -> DataFrame:
    """``(measure, line)``: each change in words."""
    p = F.abs("percent").cast("string")
    line = (
        F.when(F.col("change") == "up", F.concat("measure", F.lit(" up "), p, F.lit(" %")))
        .when(F.col("change") == "down", F.concat("measure", F.lit(" down "), p, F.lit(" %")))
        .when(F.col("change") == "new", F.concat(F.lit("first "), "measure"))
        .otherwise(F.concat("measure", F.lit(" steady")))
    )
    return changes.select("measure", F.concat(line, F.lit(" ("), F.col("before").cast("string"), F.lit(" to "), F.col("now").cast("string"), F.lit(")")).alias("line"))


def theme_lines(themes: DataFrame) -> DataFrame:
    counts = F.concat(F.col("recent").cast("string"), F.lit(" now, "), F.col("older").cast("string"), F.lit(" before"))
    return themes.select("name", "direction", F.concat("name", F.lit(": "), "direction", F.lit(" ("), counts, F.lit(")")).alias("line"))
