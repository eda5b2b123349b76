"""Composite plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamgraph.functions.scores import topic_radius
from loamgraph.functions.text import clip, is_noise_capture, is_trivial_name
from loamgraph.operators import evaluation, graph, layout, records, trends
from loamgraph.plans import backup, recommend, summary, views
from loamgraph.queries.common import ASOF, BRIDGE, CAP, EDGE, LABEL, NODE, asof, noise_sql, sql, trivial_sql
from loamgraph.queries.graph import cross_topic_edges
from loamgraph.runtime import cut
from loamgraph.queries.trends import ORACLES as TREND_SQL, _terms
from loamgraph.schemas import KIND_COLOR, topic_rows
from loamgraph.sources.tables import captures, labels, links, nodes

_TEXT = ("title", "content", "summary", "tags", "created_at")


def recommend_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The picked review, forming and related candidates of each scope."""
    out = recommend.recommend(captures(spark, d, *_TEXT), nodes(spark, d, "name", "source_captured_ids"), None, asof())
    return out.select("grp", "id", "type", F.round("score", 6).alias("score"), "place")


def recommend_with_graph(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "name", "source_captured_ids", "created_at")
    e = cut(graph.undirected(links(spark, d), n))
    return recommend.recommend(captures(spark, d, *_TEXT, "embedding"), n, e, asof(), labels=labels(spark, d)).select("grp", "id", "type", F.round("score", 6).alias("score"), "place")


def summary_themes(spark: SparkSession, d: str) -> DataFrame:
    s = summary.summarize(captures(spark, d, *_TEXT), nodes(spark, d), links(spark, d), asof(), 30)
    return summary.theme_lines(s.themes)


def summary_communities(spark: SparkSession, d: str) -> DataFrame:
    s = summary.summarize(captures(spark, d, *_TEXT), nodes(spark, d), links(spark, d), asof(), 30)
    return s.communities.select("community", "name", "n_nodes", "n_captures", "evolution")


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Changes of the last month against the one before, directions of themes, hubs, and the tags of the month."""
    c, n = captures(spark, d, "tags", "created_at"), nodes(spark, d, "name", "source_captured_ids", "created_at")
    changes = trends.period_changes({"captures": c, "nodes": n, "links": links(spark, d)}, asof(), 30)
    directions = trends.theme_directions(c, asof(), 30, 30)
    hubs = n.select("id", "name", F.size("source_captured_ids").alias("n_sources")).where((F.col("n_sources") > 0) & ~is_trivial_name("name"))
    return changes, directions, hubs, trends.tag_frequency(c.where(trends.period_of("created_at", asof(), 30) == "recent"))


def trend_list(spark: SparkSession, d: str) -> DataFrame:
    changes, directions, _, _ = _facts(spark, d)
    return summary.trend_list(changes, directions).select("pos", "trend", "direction", "now", "before", "percent", F.array_join("names", "|").alias("names"))


def next_actions(spark: SparkSession, d: str) -> DataFrame:
    return summary.next_actions(*_facts(spark, d)).select("pos", "action", "subject", "now", "before", F.array_join("names", "|").alias("names"))


def summary_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The first words of the three newest captures of each scope that say something."""
    c = captures(spark, d, *_TEXT)
    sound = c.where(~is_noise_capture("title", "summary", "content", "tags"))
    return records.newest(sound, 3, partition=["scope_id"]).select("id", clip(F.coalesce(F.nullif("summary", F.lit("")), "content"), 120).alias("excerpt"))


def shared_tag_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the ten newest captures of a scope that share a tag."""
    few = records.newest(captures(spark, d, "tags", "created_at"), 10, partition=["scope_id"]).select("scope_id", "id", "tags")
    x, y = few.withColumnsRenamed({"id": "a", "tags": "ta"}), few.withColumnsRenamed({"id": "b", "tags": "tb"})
    shared = F.filter(F.array_intersect("ta", "tb"), lambda t: t.isNotNull())
    return x.join(y, "scope_id").where("a < b").withColumn("s", shared).where(F.size("s") > 0).select("scope_id", "a", "b", F.size("s").alias("n_shared"))


def themes_to_tags(spark: SparkSession, d: str) -> DataFrame:
    """The fine topics' names matched to the tags that stand in them."""
    tags = trends.tag_frequency(captures(spark, d, "tags")).select("tag")
    known = spark.createDataFrame([(r[0],) for r in topic_rows()] + [("morning sleep debt",), ("weekly plan and budget",)], "theme string")
    return views.themes_to_tags(known, tags)


def markdown_archive(spark: SparkSession, d: str) -> DataFrame:
    m = backup.markdown(captures(spark, d, "title", "content", "summary", "tags", "note", "created_at"))
    return m.select("id", F.md5("value").alias("digest"), F.length("value").alias("n"))


def topic_layout_quality(spark: SparkSession, d: str) -> DataFrame:
    e = cross_topic_edges(spark, d).select(F.lit("all").alias("view"), F.col("topic_a").alias("a"), F.col("topic_b").alias("b"))
    n = e.select("view", F.explode(F.array("a", "b")).alias("id")).distinct()
    return layout.layout_quality(layout.force_layout(n, e))


def topic_label_legibility(spark: SparkSession, d: str) -> DataFrame:
    n = labels(spark, d).groupBy("name").agg(F.count("*").alias("members"))
    return layout.legible_labels(n.select(F.lit("all").alias("view"), "name", topic_radius("members").alias("radius")))


def kind_color_spread(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.color_spread(spark.createDataFrame(list(KIND_COLOR.items()), "name string, color string"))


def capture_cards(spark: SparkSession, d: str) -> DataFrame:
    return views.cards(captures(spark, d, "title", "summary", "content", "tags", "created_at")).select("id", "title", "body", F.size("tags").alias("n_tags"))


def component_view(spark: SparkSession, d: str) -> DataFrame:
    """The nodes linked by any way to the node with the most links, with their size on screen."""
    n = nodes(spark, d, "name", "kind", "created_at")
    e = cut(graph.undirected(links(spark, d), n))
    hub = graph.degrees(e).orderBy(F.col("degree").desc(), "id").limit(1).head()
    shown, _ = views.sub_graph(n, e, component_of=hub["id"] if hub else "")
    return shown.select("id", "size")


_BODY = "coalesce(nullif(content, ''), nullif(summary, ''), '')"
QUERIES = {f.__name__: f for f in (recommend_candidates, recommend_with_graph, summary_themes, summary_communities, markdown_archive, topic_layout_quality, topic_label_legibility, kind_color_spread, capture_cards, component_view, trend_list, next_actions, summary_excerpts, shared_tag_pairs, themes_to_tags)}
_CHANGES = "changes AS (" + TREND_SQL["period_activity_change"] + ")"
_DIRS = "dirs AS (SELECT name, direction, recent, older, total FROM (" + TREND_SQL["theme_order"].replace("SELECT name, direction, total, row_number()", "SELECT name, direction, recent, older, total, row_number()") + "))"
_HUBS = f"hubs AS (SELECT id, name, len(src) AS n FROM node WHERE len(src) > 0 AND NOT {trivial_sql('name')} ORDER BY len(src) DESC, id LIMIT 1)"
_MONTH = f"month AS (SELECT t, count(*) AS n FROM (SELECT unnest(tags) AS t FROM cap WHERE created_at >= {ASOF} - INTERVAL 30 DAY AND created_at < {ASOF}) WHERE t IS NOT NULL AND trim(t) <> '' GROUP BY t ORDER BY n DESC, t LIMIT 3)"
_AGE = f"(epoch_ms({ASOF}) - epoch_ms(created_at))"
_CANDIDATES = sql(
    CAP, NODE, BRIDGE,
    f"s AS (SELECT *, scope_id AS grp, row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC NULLS LAST, id) AS newest FROM cap WHERE NOT {noise_sql('cap')} QUALIFY newest <= 40)",
    "review AS (SELECT grp, 'review-' || id AS id, 'review' AS type, 0.4::DOUBLE AS base, 1 AS pos, coalesce(title, '') || ' ' || coalesce(summary, '') AS text FROM s WHERE (coalesce(len(tags), 0) > 0 OR greatest(length(coalesce(content, '')), length(coalesce(summary, ''))) >= 24) AND id NOT IN (SELECT capture_id FROM bridge))",
    "tag AS (SELECT grp, id, created_at, long, t FROM (SELECT grp, id, created_at, greatest(length(coalesce(content, '')), length(coalesce(summary, ''))) >= 24 AS long, unnest(tags) AS t FROM s) WHERE t IS NOT NULL AND trim(t) <> '')",
    f"th AS (SELECT grp, t, count(*) FILTER (WHERE {_AGE} > 0 AND {_AGE} <= 604800000) AS recent, count(*) FILTER (WHERE {_AGE} > 604800000) AS older, count(DISTINCT id) FILTER (WHERE long) AS n_long FROM tag GROUP BY 1, 2)",
    f"forming AS (SELECT grp, 'forming-' || t AS id, 'forming' AS type, 0.6::DOUBLE AS base, 4 AS pos, t AS text FROM th WHERE recent >= 2 AND (older = 0 OR recent >= older + 1 AND recent * 2 >= older * 3) AND n_long >= 2 AND NOT {trivial_sql('t')})",
    "few AS (SELECT grp, id, list_filter(tags, lambda t: t IS NOT NULL) AS tags, coalesce(title, '') AS title, created_at FROM s WHERE newest <= 40 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY created_at DESC NULLS LAST, id) <= 10)",
    "related AS (SELECT x.grp, 'related-' || x.id || '-' || y.id AS id, 'related' AS type, 0.2::DOUBLE AS base, 5 AS pos, CASE WHEN x.created_at > y.created_at OR x.created_at = y.created_at THEN x.title || ' ' || y.title ELSE y.title || ' ' || x.title END AS text FROM few x JOIN few y ON x.grp = y.grp AND x.id < y.id WHERE list_has_any(x.tags, y.tags))",
    "cand AS (SELECT * FROM review UNION ALL SELECT * FROM forming UNION ALL SELECT * FROM related)",
    f"doc AS (SELECT grp, id, {_terms('text')} AS w FROM (SELECT grp, id, coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(content, '') AS text FROM s))",
    "size AS (SELECT grp, count(*) AS n, avg(len(w)) AS avg_len FROM doc GROUP BY grp)",
    "tf AS (SELECT grp, id, len, term, count(*) AS tf FROM (SELECT grp, id, len(w) AS len, unnest(w) AS term FROM doc) GROUP BY ALL)",
    "wt AS (SELECT grp, term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) * sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS w FROM tf JOIN size USING (grp) GROUP BY grp, term)",
    f"asked AS (SELECT DISTINCT grp, id, unnest(w) AS term FROM (SELECT grp, id, {_terms('text')} AS w FROM cand WHERE text <> ''))",
    "kw AS (SELECT grp, id, round(least(1.0, sum(w) / 50), 9) AS k FROM asked JOIN wt USING (grp, term) GROUP BY 1, 2)",
    "scored AS (SELECT cand.grp, cand.id, type, pos, 0.3 * coalesce(k, 0) + 0.3 * base AS score FROM cand LEFT JOIN kw ON kw.grp = cand.grp AND kw.id = cand.id)",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY grp, type ORDER BY score DESC, pos, id) AS rn FROM scored QUALIFY rn <= 2)",
    query="SELECT grp, id, type, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rn <> 1, score DESC, pos, id) AS place FROM ranked) WHERE place <= 6",
)
_COLORS = "c(n, r, g, b) AS (VALUES " + ", ".join(f"('{k}', {int(v[1:3], 16)}, {int(v[3:5], 16)}, {int(v[5:7], 16)})" for k, v in KIND_COLOR.items()) + ")"
ORACLES = {
    "recommend_candidates": _CANDIDATES,
    "trend_list": sql(_CHANGES, _DIRS, "q AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY total DESC, name) AS rn FROM dirs WHERE direction <> 'stable')",
        query="""SELECT * FROM (SELECT CASE measure WHEN 'captures' THEN 0 WHEN 'nodes' THEN 1 ELSE 2 END AS pos, measure AS trend, change AS direction, now, before, percent, '' AS names FROM changes
        WHERE measure = 'captures' AND change IS NOT NULL OR measure = 'nodes' AND change IN ('up', 'down') OR measure = 'links' AND change = 'up'
        UNION ALL SELECT CASE direction WHEN 'up' THEN 3 WHEN 'new' THEN 4 ELSE 5 END, 'themes', direction, sum(recent)::BIGINT, sum(older)::BIGINT, NULL, string_agg(name, '|' ORDER BY rn) FROM q WHERE rn <= 2 GROUP BY direction) ORDER BY pos LIMIT 5"""),
    "next_actions": sql(CAP, NODE, _CHANGES, _DIRS, _HUBS, _MONTH, "cc AS (SELECT * FROM changes WHERE measure = 'captures')", "nn AS (SELECT * FROM changes WHERE measure = 'nodes')",
        query="""SELECT 1 AS pos, 'record' AS action, NULL::VARCHAR AS subject, now, before, '' AS names FROM cc WHERE now <= 3
        UNION ALL SELECT 2, 'link', NULL, cc.now, NULL, '' FROM cc, nn WHERE nn.now = 0 AND cc.now > 0
        UNION ALL (SELECT 3, 'deepen', name, recent, older, direction FROM dirs WHERE direction IN ('up', 'new') AND recent >= 2 ORDER BY recent DESC, name LIMIT 2)
        UNION ALL (SELECT 4, 'resume', name, recent, older, '' FROM dirs WHERE direction = 'down' ORDER BY older DESC, name LIMIT 1)
        UNION ALL SELECT 5, 'review', name, n, NULL, (SELECT string_agg(t, '|' ORDER BY n DESC, t) FROM month) FROM hubs
        UNION ALL SELECT 6, 'keep', NULL, now, before, '' FROM cc WHERE change = 'up'"""),
    "summary_excerpts": sql(CAP, f"s AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC NULLS LAST, id) AS rn FROM cap WHERE NOT {noise_sql('cap')})", query="SELECT id, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '…' ELSE t END AS excerpt FROM (SELECT id, coalesce(nullif(summary, ''), content, '') AS t FROM s WHERE rn <= 3)"),
    "shared_tag_pairs": sql(CAP, "few AS (SELECT scope_id, id, list_distinct(list_filter(tags, lambda t: t IS NOT NULL)) AS tags FROM cap QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC NULLS LAST, id) <= 10)", query="SELECT * FROM (SELECT x.scope_id, x.id AS a, y.id AS b, len(list_intersect(x.tags, y.tags))::INTEGER AS n_shared FROM few x JOIN few y ON x.scope_id = y.scope_id AND x.id < y.id) WHERE n_shared > 0"),
    "themes_to_tags": sql(CAP, "tag AS (SELECT DISTINCT t FROM (SELECT unnest(tags) AS t FROM cap) WHERE trim(t) <> '')", "known(theme) AS (VALUES " + ", ".join(f"('{r[0]}')" for r in topic_rows()) + ", ('morning sleep debt'), ('weekly plan and budget'))", query="SELECT theme, t AS tag FROM known JOIN tag ON contains(lower(theme), lower(t)) QUALIFY row_number() OVER (PARTITION BY theme ORDER BY instr(lower(theme), lower(t)), length(t) DESC, t) = 1"),
    "summary_themes": sql(CAP, "tag AS (SELECT created_at, t FROM (SELECT created_at, unnest(tags) AS t FROM cap) WHERE t IS NOT NULL AND trim(t) <> '')",
        f"w AS (SELECT t AS name, count(*) FILTER (WHERE created_at >= {ASOF} - INTERVAL 30 DAY AND created_at < {ASOF}) AS recent, count(*) FILTER (WHERE created_at < {ASOF} - INTERVAL 30 DAY) AS older FROM tag GROUP BY 1)",
        "dirs AS (SELECT *, recent + older AS total, CASE WHEN older = 0 AND recent > 0 THEN 'new' WHEN recent = 0 AND older > 0 THEN 'down' WHEN recent >= older + 1 AND recent * 2 >= older * 3 THEN 'up' WHEN older >= recent + 1 AND older * 2 >= recent * 3 THEN 'down' ELSE 'stable' END AS direction FROM w WHERE recent + older >= 3)",
        query=f"SELECT name, direction, name || ': ' || direction || ' (' || recent || ' now, ' || older || ' before)' AS line FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY total DESC, name) AS rn FROM dirs WHERE NOT {trivial_sql('name')}) WHERE rn <= CASE direction WHEN 'up' THEN 3 WHEN 'new' THEN 3 WHEN 'down' THEN 4 ELSE 0 END"),
    "topic_label_legibility": sql(LABEL, "m AS (SELECT topic AS name, greatest(9.0, least(24.0, 7 + 19 * sqrt(least(count(*), 400) / 400.0))) AS r FROM label GROUP BY 1)", "f AS (SELECT least(r * 0.62, r * 1.55 / greatest(least(greatest(2, floor(r * 1.55 / (r * 0.62))), 7, length(name)), 1)) >= 5.5 AS ok FROM m)", query="SELECT 'all' AS view, count(*) FILTER (WHERE ok) AS n_legible, count(*) FILTER (WHERE NOT ok) AS n_small FROM f"),
    "kind_color_spread": sql(_COLORS, "p AS (SELECT sqrt(power(x.r - y.r, 2) + power(x.g - y.g, 2) + power(x.b - y.b, 2)) AS d FROM c x JOIN c y ON x.n < y.n)", query="SELECT round(min(d), 6) AS least, round(median(d), 6) AS median, count(*) FILTER (WHERE d = 0) AS n_same FROM p"),
    "capture_cards": sql(CAP, query="SELECT id, coalesce(title, '') AS title, coalesce(nullif(summary, ''), nullif(content, ''), '') AS body, coalesce(len(tags), 0) AS n_tags FROM cap"),
    "component_view": sql(NODE, EDGE, "g AS (SELECT src AS id, count(*) AS degree FROM adj GROUP BY 1)", "walk AS (SELECT id FROM (SELECT id FROM g ORDER BY degree DESC, id LIMIT 1) UNION SELECT dst FROM walk JOIN adj ON adj.src = walk.id)", query="SELECT id, least(14, 6 + degree) AS size FROM g WHERE id IN (SELECT id FROM walk)"),
    "markdown_archive": sql(CAP, "m AS (SELECT id, concat_ws(chr(10) || chr(10), '## ' || coalesce(nullif(title, ''), 'Untitled'), concat_ws(' · ', strftime(created_at, '%Y-%m-%d %H:%M'), nullif(array_to_string(coalesce(tags, []), ', '), '')), nullif(regexp_replace(" + _BODY + ", '(?m)^#', '\\\\#', 'g'), ''), nullif(coalesce(note, ''), '')) AS value FROM cap)", query="SELECT id, md5(value) AS digest, length(value) AS n FROM m"),
}
