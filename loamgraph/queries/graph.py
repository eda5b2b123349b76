"""The graph, its communities and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loamgraph.functions.scores import kind_priority
from loamgraph.operators import communities, graph, records, topics
from loamgraph.plans import views
from loamgraph.queries.common import ASOF, BRIDGE, CAP, EDGE, LABEL, LINK, NODE, asof, sql
from loamgraph.runtime import cut
from loamgraph.schemas import OTHER_TOPIC, topic_rows
from loamgraph.sources.tables import captures, labels, links, nodes


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.undirected(links(spark, d), nodes(spark, d, "name"))


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return labels(spark, d).select(F.col("cluster_key").alias("id"), F.col("name").alias("topic")).join(nodes(spark, d, "name").select("id"), "id", "left_semi")


def _recent_seeds(spark: SparkSession, d: str, days: int = 30) -> DataFrame:
    """``(grp, id)``: the nodes behind each scope's captures of the last days."""
    c = captures(spark, d, "created_at").where(F.unix_millis("created_at") >= F.unix_millis(asof()) - days * 86_400_000)
    held = graph.bridge(nodes(spark, d, "source_captured_ids"))
    return held.join(c.select(F.col("id").alias("capture_id"), F.col("scope_id").alias("grp")), "capture_id").select("grp", F.col("node_id").alias("id")).distinct()


def capture_node_bridge_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.bridge(nodes(spark, d, "source_captured_ids")).groupBy("node_id").agg(F.count("*").alias("n_captures"))


def unlinked_captures(spark: SparkSession, d: str) -> DataFrame:
    held = graph.bridge(nodes(spark, d, "source_captured_ids")).select(F.col("capture_id").alias("id")).distinct()
    return captures(spark, d, "title").join(held, "id", "left_anti").select("id", "title")


def links_with_names(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "name").select("id", "name")
    s, t = n.withColumnsRenamed({"id": "source", "name": "source_name"}), n.withColumnsRenamed({"id": "target", "name": "target_name"})
    e = links(spark, d).select("id", F.lower("source").alias("source"), F.lower("target").alias("target"))
    return e.join(s, "source", "left").join(t, "target", "left").select("id", "source_name", "target_name")


def links_touching_recent_nodes(spark: SparkSession, d: str) -> DataFrame:
    recent = nodes(spark, d, "created_at").where(F.unix_millis("created_at") >= F.unix_millis(asof()) - 60 * 86_400_000).select("id")
    e = links(spark, d).select("id", F.lower("source").alias("source"), F.lower("target").alias("target"))
    ends = e.select("id", F.explode(F.array("source", "target")).alias("end")).join(recent.withColumnRenamed("id", "end"), "end", "left_semi")
    return ends.select("id").distinct()


def undirected_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


def depth_profile(spark: SparkSession, d: str) -> DataFrame:
    return graph.depth_profile(nodes(spark, d, "source_captured_ids"), _edges(spark, d))


def implicit_pairs(spark: SparkSession, d: str) -> DataFrame:
    newest = records.newest(nodes(spark, d, "created_at"), 60, partition=["scope_id"]).select(F.col("scope_id").alias("grp"), "id")
    return graph.implicit_pairs(newest, _edges(spark, d), 1).drop("grp")


def two_hop_bridges(spark: SparkSession, d: str) -> DataFrame:
    c = records.newest(captures(spark, d, "tags", "created_at"), 40, partition=["scope_id"]).select(F.col("scope_id").alias("grp"), "id", "tags")
    return graph.two_hop_bridges(c, nodes(spark, d, "source_captured_ids"), _edges(spark, d)).drop("grp")


def bfs_distance_from_seeds(spark: SparkSession, d: str) -> DataFrame:
    return graph.distances(_edges(spark, d), _recent_seeds(spark, d).select("id"), 4).select("id", "depth")


def paths_to_seeds(spark: SparkSession, d: str) -> DataFrame:
    found = graph.distances(_edges(spark, d), _recent_seeds(spark, d).select("id"), 4)
    return graph.shortest_paths(found, nodes(spark, d, "name"), 4).select("id", "depth", F.array_join("path", " > ").alias("path"))


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_edges(spark, d))


def ppr_3_iterations(spark: SparkSession, d: str) -> DataFrame:
    r = graph.personalized_pagerank(_edges(spark, d), _recent_seeds(spark, d), iterations=3)
    return r.select("grp", "id", F.round("rank", 9).alias("rank"))


def ppr_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Two-hop bridges of each scope by the rank of their middle node, the ten best."""
    c = records.newest(captures(spark, d, "tags", "created_at"), 40, partition=["scope_id"]).select(F.col("scope_id").alias("grp"), "id", "tags")
    e = cut(_edges(spark, d))
    ways = cut(graph.two_hop_bridges(c, nodes(spark, d, "source_captured_ids"), e))
    held = graph.bridge(nodes(spark, d, "source_captured_ids"))
    seeds = ways.select("capture_a").distinct().join(held.withColumnRenamed("capture_id", "capture_a"), "capture_a").select(F.col("capture_a").alias("grp"), F.col("node_id").alias("id"))
    middles = ways.select(F.col("capture_a").alias("grp"), F.col("mid").alias("id")).distinct()
    rank = graph.component_ranks(e, seeds, middles, iterations=15).select(F.col("grp").alias("capture_a"), F.col("id").alias("mid"), F.round("rank", 9).alias("rank"))
    out = ways.join(rank, ["capture_a", "mid"], "left").fillna(0.0, ["rank"])
    w = Window.partitionBy("grp").orderBy(F.col("rank").desc(), "capture_a", "capture_b")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 10)


def communities_greedy(spark: SparkSession, d: str) -> DataFrame:
    return communities.detect(_edges(spark, d))


def communities_in_rounds(spark: SparkSession, d: str) -> DataFrame:
    return communities.detect_in_rounds(_edges(spark, d))


def community_profile(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return communities.describe(communities.detect(e), nodes(spark, d, "name", "created_at", "source_captured_ids"), e, asof(), 30)


def topic_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return communities.hierarchy(_edges(spark, d)).groupBy("super_topic", "topic").agg(F.count("*").alias("n_nodes"))


def broad_topic_rollup(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame(topic_rows(), "fine string, broad string, pos int")
    return communities.semantic_hierarchy(nodes(spark, d, "name"), labels(spark, d), known)


def cross_topic_edges(spark: SparkSession, d: str) -> DataFrame:
    return topics.cross_topic_edges(_edges(spark, d), _topics(spark, d))


def topic_edge_degree(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_degrees(cross_topic_edges(spark, d))


def capture_topic_vote(spark: SparkSession, d: str) -> DataFrame:
    return topics.capture_votes(nodes(spark, d, "val", "source_captured_ids"), _topics(spark, d), OTHER_TOPIC)


def topic_capture_groups(spark: SparkSession, d: str) -> DataFrame:
    g = topics.topic_groups(captures(spark, d, "created_at"), capture_topic_vote(spark, d))
    return g.select("topic", "n", F.unix_millis("latest").alias("latest_ms"))


def topic_insight(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_insight(nodes(spark, d, "source_captured_ids", "created_at"), _topics(spark, d), asof(), 60)


def topic_top_members(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_top_members(nodes(spark, d, "source_captured_ids"), _topics(spark, d), graph.degrees(_edges(spark, d)))


def degree_by_name(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees_by_name(links(spark, d), nodes(spark, d, "name"))


def topic_kind_histogram(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_kinds(nodes(spark, d, "kind"), _topics(spark, d))


def related_topics(spark: SparkSession, d: str) -> DataFrame:
    return topics.related_topics(cross_topic_edges(spark, d))


def drill_down_topic(spark: SparkSession, d: str) -> DataFrame:
    """The topics beside the largest one, with the number of links to each."""
    t = _topics(spark, d)
    first = t.where(F.col("topic") != OTHER_TOPIC).groupBy("topic").count().orderBy(F.col("count").desc(), "topic").limit(1).head()
    return topics.drill_down(_edges(spark, d), t, first["topic"] if first else "")[1]


def node_links(spark: SparkSession, d: str) -> DataFrame:
    """The links at the node with the most links."""
    n = nodes(spark, d, "source_captured_ids")
    e = links(spark, d)
    hub = graph.degrees(_edges(spark, d)).orderBy(F.col("degree").desc(), "id").limit(1).head()
    return views.node_detail(hub["id"] if hub else "", n, e, captures(spark, d, "title", "created_at"))[0].select("id", F.lower("source").alias("source"), F.lower("target").alias("target"))


def node_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The captures that the node with the most links and those links name, the first eight of them."""
    hub = graph.degrees(_edges(spark, d)).orderBy(F.col("degree").desc(), "id").limit(1).head()
    return views.node_detail(hub["id"] if hub else "", nodes(spark, d, "source_captured_ids"), links(spark, d), captures(spark, d, "title", "created_at"))[1].select("id", "title")


def kind_filter_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by kind on the display's list, others as unknown."""
    return nodes(spark, d, "kind").groupBy(views.known_kind("kind").alias("kind")).agg(F.count("*").alias("n"))


def recent_sub_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a span of time, both ends included, with their size by the links among themselves."""
    at = lambda t: F.lit(t + "+00:00").cast("timestamp")
    shown, _ = views.sub_graph(nodes(spark, d, "kind", "created_at"), _edges(spark, d), since=at("2025-01-01 00:00:00"), until=at("2025-12-31 23:59:59.999"))
    return shown.select("id", "size")


def nodes_without_topic(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d, "name").select("id").join(_topics(spark, d), "id", "left_anti")


def topic_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _topics(spark, d).groupBy("topic").agg(topics.cluster_signature(F.collect_list("id")).alias("signature"))


def topic_view_edges(spark: SparkSession, d: str) -> DataFrame:
    e = cross_topic_edges(spark, d).select(F.lit("all").alias("view"), F.col("topic_a").alias("a"), F.col("topic_b").alias("b"), "n")
    return topics.strong_edges(e, ["view"])


def kind_ranks(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d, "kind").groupBy("kind").agg(F.max(kind_priority("kind")).alias("priority"), F.count("*").alias("n"))


def link_merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    m = records.merged_links(links(spark, d))
    return m.select("scope_id", "source", "target", "relation_type", F.array_join("evidence", ",").alias("evidence"), "confidence", "n_rows")


def dangling_reference_repair(spark: SparkSession, d: str) -> DataFrame:
    r = records.existing_refs(nodes(spark, d, "source_captured_ids"), "source_captured_ids", captures(spark, d))
    return r.select("id", F.array_join("kept", ",").alias("kept"), "n_dropped")


def deleted_refs_removed(spark: SparkSession, d: str) -> DataFrame:
    from loamgraph.runtime import table

    gone = table(spark, d, "deleted_captures").select("id")
    n = records.without_refs(nodes(spark, d, "source_captured_ids"), "source_captured_ids", gone)
    return n.select("id", F.size("source_captured_ids").alias("n_left"))


def alias_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Entities as an extractor would name them (each node's aliases) resolved against the nodes of their scope."""
    n = nodes(spark, d, "name", "aliases")
    asked = n.where(F.size("aliases") > 0).select("scope_id", F.col("id").alias("key"), F.element_at("aliases", 1).alias("name"), F.slice("aliases", 2, F.size("aliases")).alias("aliases"))
    return records.alias_matches(asked, n).select("key", "node_id")


def latest_snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    c = captures(spark, d, "title")
    changed = c.where(F.col("graph_status") != "completed").withColumn("graph_status", F.lit("completed"))
    return records.merge_snapshot(c, changed).groupBy("graph_status").agg(F.count("*").alias("n"))


def insert_ignore_duplicates(spark: SparkSession, d: str) -> DataFrame:
    c = captures(spark, d, "created_at")
    old, new = c.where(F.unix_millis("created_at") < F.unix_millis(asof()) - 200 * 86_400_000), c.where(F.unix_millis("created_at") >= F.unix_millis(asof()) - 400 * 86_400_000)
    return records.insert_ignoring(old, new, ["id"]).select("id")


def status_timeout_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return records.settled_states(captures(spark, d, "created_at"), asof()).groupBy("state").agg(F.count("*").alias("n"))


_SEEDS = f"seed AS (SELECT DISTINCT cap.scope_id AS grp, node_id AS id FROM bridge JOIN cap ON cap.id = capture_id WHERE cap.created_at >= {ASOF} - INTERVAL 30 DAY)"
_TOPIC = "topic AS (SELECT label.* FROM label WHERE id IN (SELECT id FROM node))"
_CROSS = "cr AS (SELECT least(x.topic, y.topic) AS topic_a, greatest(x.topic, y.topic) AS topic_b, count(*) AS n FROM edge JOIN topic x ON x.id = a JOIN topic y ON y.id = b WHERE x.topic <> y.topic GROUP BY 1, 2)"
_VOTE = "vote AS (SELECT capture_id, topic, votes FROM (SELECT capture_id, topic, count(*) AS votes, sum(val) AS w FROM bridge JOIN node ON node.id = node_id JOIN topic ON topic.id = node_id WHERE topic <> '其他' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY votes DESC, w DESC, topic) = 1)"
_HUB = "hub AS (SELECT src AS id FROM adj GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_NORM = r"""trim(regexp_replace(translate(lower(trim(coalesce({c}, ''))), '，。！？、,.!?;；:"''“”‘’（）()【】[]{{}}<>', repeat(' ', 29)), '[\s\p{{Z}}\x0b\x{{85}}]+', ' ', 'g'))"""
_KNOWN = "known(fine, broad) AS (VALUES " + ", ".join(f"('{f}', '{b}')" for f, b, _ in topic_rows()) + ")"


def _ppr_sql(n: int) -> str:
    ctes = ["deg AS (SELECT src, count(*) AS deg FROM adj GROUP BY src)", "tp AS (SELECT grp, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY grp) AS tp FROM seed)", "r0 AS (SELECT grp, id, tp AS rank FROM tp)"]
    for i in range(1, n + 1):
        ctes.append(f"f{i} AS (SELECT grp, id, sum(v) AS v FROM (SELECT grp, dst AS id, rank * 0.85::DOUBLE / deg AS v FROM r{i - 1} r JOIN adj ON adj.src = r.id JOIN deg ON deg.src = r.id UNION ALL SELECT grp, id, tp * (1 - 0.85::DOUBLE) FROM tp) GROUP BY grp, id)")
        ctes.append(f"r{i} AS (SELECT grp, id, v / sum(v) OVER (PARTITION BY grp) AS rank FROM f{i})")
    return sql(CAP, NODE, EDGE, BRIDGE, _SEEDS, *ctes, query=f"SELECT grp, id, round(rank, 9) AS rank FROM r{n}")


def _ppr_bridges_sql(n: int) -> str:
    """Two-hop bridges of each scope by the rank of their middle node from the first capture's nodes, the ten best."""
    ways = ORACLES["two_hop_bridges"].replace("SELECT capture_a, capture_b, w.node_a AS node_a", "SELECT z.grp, capture_a, capture_b, w.node_a AS node_a")
    ctes = [f"ways AS ({ways})", "seed AS (SELECT DISTINCT capture_a AS grp, node_id AS id FROM ways JOIN bridge ON capture_id = capture_a)"]
    ctes += ["deg AS (SELECT src, count(*) AS deg FROM adj GROUP BY src)", "tp AS MATERIALIZED (SELECT grp, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY grp) AS tp FROM seed)", "r0 AS (SELECT grp, id, tp AS rank FROM tp)"]
    for i in range(1, n + 1):
        ctes.append(f"f{i} AS (SELECT grp, id, sum(v) AS v FROM (SELECT grp, dst AS id, rank * 0.85::DOUBLE / deg AS v FROM r{i - 1} r JOIN adj ON adj.src = r.id JOIN deg ON deg.src = r.id UNION ALL SELECT grp, id, tp * (1 - 0.85::DOUBLE) FROM tp) GROUP BY grp, id)")
        ctes.append(f"r{i} AS MATERIALIZED (SELECT grp, id, v / sum(v) OVER (PARTITION BY grp) AS rank FROM f{i})")
    query = f"SELECT * FROM (SELECT w.*, coalesce(round(rank, 9), 0) AS rank, row_number() OVER (PARTITION BY w.grp ORDER BY coalesce(round(rank, 9), 0) DESC, capture_a, capture_b) AS rn FROM ways w LEFT JOIN r{n} ON r{n}.grp = capture_a AND r{n}.id = mid) WHERE rn <= 10"
    return sql(CAP, NODE, EDGE, BRIDGE, *ctes, query=query)


QUERIES = {
    f.__name__: f
    for f in (
        capture_node_bridge_stats, unlinked_captures, links_with_names, links_touching_recent_nodes, undirected_degree, depth_profile, implicit_pairs, two_hop_bridges, bfs_distance_from_seeds, paths_to_seeds, connected_components,
        ppr_3_iterations, ppr_bridges, communities_greedy, communities_in_rounds, community_profile, topic_hierarchy, broad_topic_rollup, cross_topic_edges, topic_edge_degree, capture_topic_vote, topic_capture_groups, topic_insight, topic_top_members,
        degree_by_name, topic_kind_histogram, related_topics, drill_down_topic, node_links, node_evidence, kind_filter_unknown, recent_sub_graph,
        nodes_without_topic, topic_signatures, topic_view_edges, kind_ranks, link_merge_upsert, dangling_reference_repair, deleted_refs_removed, alias_first_match, latest_snapshot_merge, insert_ignore_duplicates, status_timeout_reconcile,
    )
}
_N_SOURCES = "len(list_distinct(list_filter(src, lambda x: x IS NOT NULL AND x <> '')))"
ORACLES = {
    "capture_node_bridge_stats": sql(NODE, BRIDGE, query="SELECT node_id, count(*) AS n_captures FROM bridge GROUP BY 1"),
    "unlinked_captures": sql(CAP, NODE, BRIDGE, query="SELECT id, title FROM cap WHERE id NOT IN (SELECT capture_id FROM bridge)"),
    "links_with_names": sql(NODE, LINK, query="SELECT link.id, s.name AS source_name, t.name AS target_name FROM link LEFT JOIN node s ON s.id = lower(source) LEFT JOIN node t ON t.id = lower(target)"),
    "links_touching_recent_nodes": sql(NODE, LINK, f"r AS (SELECT id FROM node WHERE created_at >= {ASOF} - INTERVAL 60 DAY)", query="SELECT id FROM link WHERE lower(source) IN (SELECT id FROM r) OR lower(target) IN (SELECT id FROM r)"),
    "undirected_degree": sql(NODE, EDGE, query="SELECT src AS id, count(*) AS degree FROM adj GROUP BY 1"),
    "depth_profile": sql(NODE, EDGE, f"g AS (SELECT node.id, {_N_SOURCES} AS n_sources, count(dst) AS degree FROM node LEFT JOIN adj ON src = node.id GROUP BY node.id, node.src)".replace("ON src =", "ON adj.src =").replace(_N_SOURCES, _N_SOURCES.replace("src", "node.src")), query="SELECT *, CASE WHEN degree >= 3 THEN 'deep' ELSE 'shallow' END AS depth FROM g WHERE degree >= 3 OR (n_sources >= 2 AND degree = 0)"),
    "implicit_pairs": sql(NODE, EDGE, "c AS (SELECT scope_id AS grp, id FROM node QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC NULLS LAST, id) <= 60)", "nr AS (SELECT grp, id, dst AS mid FROM c JOIN adj ON adj.src = c.id)", query="SELECT x.id AS a, y.id AS b, count(DISTINCT x.mid) AS common FROM nr x JOIN nr y ON x.grp = y.grp AND x.mid = y.mid AND x.id < y.id WHERE NOT EXISTS (SELECT 1 FROM edge WHERE edge.a = x.id AND edge.b = y.id) GROUP BY 1, 2"),
    "two_hop_bridges": sql(CAP, NODE, EDGE, BRIDGE, "c AS (SELECT scope_id AS grp, id, list_filter(list_transform(coalesce(tags, []), lambda t: lower(t)), lambda t: true) AS tags FROM cap QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC NULLS LAST, id) <= 40)",
        "h AS (SELECT grp, capture_id, node_id, dst AS mid FROM bridge JOIN c ON c.id = capture_id JOIN adj ON adj.src = node_id)",
        query="""SELECT capture_a, capture_b, w.node_a AS node_a, w.mid AS mid, w.node_b AS node_b FROM (SELECT x.grp, x.capture_id AS capture_a, y.capture_id AS capture_b, min({'node_a': x.node_id, 'mid': x.mid, 'node_b': y.node_id}) AS w
        FROM h x JOIN h y ON x.grp = y.grp AND x.mid = y.mid AND x.capture_id < y.capture_id AND x.node_id <> y.node_id
        WHERE NOT EXISTS (SELECT 1 FROM bridge o WHERE o.capture_id = x.capture_id AND o.node_id = x.mid) AND NOT EXISTS (SELECT 1 FROM bridge o WHERE o.capture_id = y.capture_id AND o.node_id = x.mid) GROUP BY ALL) z
        JOIN c ca ON ca.id = capture_a JOIN c cb ON cb.id = capture_b
        WHERE len(list_intersect(list_filter(ca.tags, lambda t: t IS NOT NULL), list_filter(cb.tags, lambda t: t IS NOT NULL))) = 0 AND NOT (list_contains(list_transform(ca.tags, lambda t: t IS NULL), true) AND list_contains(list_transform(cb.tags, lambda t: t IS NULL), true))"""),
    "bfs_distance_from_seeds": sql(CAP, NODE, EDGE, BRIDGE, _SEEDS, "walk AS (SELECT DISTINCT id, 0 AS depth FROM seed UNION SELECT dst, depth + 1 FROM walk JOIN adj ON adj.src = walk.id WHERE depth < 4)", query="SELECT id, min(depth) AS depth FROM walk GROUP BY id"),
    "paths_to_seeds": sql(CAP, NODE, EDGE, BRIDGE, _SEEDS, "walk AS (SELECT DISTINCT id, 0 AS depth FROM seed UNION SELECT dst, depth + 1 FROM walk JOIN adj ON adj.src = walk.id WHERE depth < 4)", "dd AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)",
        "pv AS (SELECT x.id, min(y.id) AS prev FROM dd x JOIN adj ON adj.src = x.id JOIN dd y ON y.id = adj.dst AND y.depth = x.depth - 1 GROUP BY x.id)", "nm AS (SELECT id, name FROM node)",
        "pa AS (SELECT dd.id, depth, dd.id AS at, name AS path FROM dd JOIN nm USING (id) UNION ALL SELECT pa.id, depth, pv.prev, path || ' > ' || nm.name FROM pa JOIN pv ON pv.id = pa.at JOIN nm ON nm.id = pv.prev)", query="SELECT pa.id, pa.depth, path FROM pa JOIN dd e ON e.id = pa.at WHERE e.depth = 0"),
    "topic_view_edges": sql(NODE, EDGE, LABEL, _TOPIC, _CROSS, "e AS (SELECT 'all' AS view, topic_a AS a, topic_b AS b, n, row_number() OVER (ORDER BY n DESC, topic_a, topic_b) AS rn, count(*) OVER () AS total FROM cr)", "v AS (SELECT x, min(rn) AS first FROM (SELECT a AS x, rn FROM e UNION ALL SELECT b, rn FROM e) GROUP BY x)", "k AS (SELECT count(*) AS nodes, greatest(count(*), floor(1.6 * count(*) + 0.5)) AS keep FROM v)",
        query="SELECT view, a, b, n FROM e, k WHERE total <= 2 * nodes OR rn <= keep OR rn IN (SELECT first FROM v)"),
    "connected_components": sql(NODE, EDGE, "reach AS (SELECT src AS id, src AS component FROM adj UNION SELECT adj.dst, component FROM reach JOIN adj ON adj.src = reach.id)", query="SELECT id, min(component) AS component FROM reach GROUP BY id"),
    "ppr_3_iterations": _ppr_sql(3),
    "broad_topic_rollup": sql(NODE, LABEL, _KNOWN, query="SELECT coalesce(broad, '其他') AS broad, CASE WHEN broad IS NULL THEN '其他' ELSE topic END AS fine, count(*) AS n_nodes FROM node LEFT JOIN label ON label.id = node.id LEFT JOIN known ON fine = topic GROUP BY 1, 2"),
    "cross_topic_edges": sql(NODE, EDGE, LABEL, _TOPIC, _CROSS, query="SELECT * FROM cr"),
    "topic_edge_degree": sql(NODE, EDGE, LABEL, _TOPIC, _CROSS, query="SELECT topic, count(*) AS n_topics, sum(n)::BIGINT AS n_links FROM (SELECT topic_a AS topic, n FROM cr UNION ALL SELECT topic_b, n FROM cr) GROUP BY 1"),
    "capture_topic_vote": sql(NODE, LABEL, _TOPIC, BRIDGE, _VOTE, query="SELECT * FROM vote"),
    "topic_capture_groups": sql(CAP, NODE, LABEL, _TOPIC, BRIDGE, _VOTE, query="SELECT topic, count(*) AS n, epoch_ms(max(created_at)) AS latest_ms FROM cap LEFT JOIN vote ON capture_id = id GROUP BY 1"),
    "topic_insight": sql(NODE, LABEL, _TOPIC, BRIDGE, query=f"SELECT topic, count(DISTINCT node.id) AS n_nodes, count(DISTINCT capture_id) AS n_captures, count(DISTINCT node.id) FILTER (WHERE created_at >= {ASOF} - INTERVAL 60 DAY) AS n_new FROM node JOIN topic ON topic.id = node.id LEFT JOIN bridge ON node_id = node.id GROUP BY 1"),
    "topic_top_members": sql(NODE, EDGE, LABEL, _TOPIC, "g AS (SELECT src, count(*) AS degree FROM adj GROUP BY src)", "m AS (SELECT node.id, topic, len(list_distinct(node.src)) + CASE WHEN list_contains(list_transform(node.src, lambda x: x IS NULL), true) THEN 1 ELSE 0 END AS n, coalesce(degree, 0) AS degree FROM node JOIN topic ON topic.id = node.id LEFT JOIN g ON g.src = node.id)",
        "tops AS (SELECT topic FROM m GROUP BY 1 ORDER BY count(*) DESC, topic LIMIT 6)", query="SELECT topic, id, rn FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY n DESC, degree DESC, id) AS rn FROM m WHERE topic IN (SELECT topic FROM tops)) WHERE rn <= 4"),
    "degree_by_name": sql(NODE, LINK, query="SELECT name, count(*) AS degree FROM (SELECT lower(source) AS id FROM link UNION ALL SELECT lower(target) FROM link) e JOIN node USING (id) GROUP BY name"),
    "topic_kind_histogram": sql(NODE, LABEL, _TOPIC, query="SELECT topic, kind, n, rn FROM (SELECT topic, kind, count(*) AS n, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, kind) AS rn FROM node JOIN topic USING (id) GROUP BY 1, 2) WHERE rn <= 5"),
    "related_topics": sql(NODE, EDGE, LABEL, _TOPIC, _CROSS, query="SELECT topic, related, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, related) AS rn FROM (SELECT topic_a AS topic, topic_b AS related, n FROM cr UNION ALL SELECT topic_b, topic_a, n FROM cr)) WHERE rn <= 3"),
    "drill_down_topic": sql(NODE, EDGE, LABEL, _TOPIC, _CROSS, "top AS (SELECT topic FROM topic WHERE topic <> '其他' GROUP BY 1 ORDER BY count(*) DESC, topic LIMIT 1)", query="SELECT CASE WHEN topic_a = top.topic THEN topic_b ELSE topic_a END AS topic, n FROM cr, top WHERE topic_a = top.topic OR topic_b = top.topic"),
    "node_links": sql(NODE, EDGE, LINK, _HUB, query="SELECT link.id, lower(source) AS source, lower(target) AS target FROM link, hub WHERE lower(source) = hub.id OR lower(target) = hub.id"),
    "node_evidence": sql(CAP, NODE, EDGE, LINK, _HUB, "named AS (SELECT 0 AS src, generate_subscripts(n.src, 1) AS pos, unnest(n.src) AS c FROM node n JOIN hub ON hub.id = n.id UNION ALL SELECT 1, generate_subscripts(evidence_captured_ids, 1), unnest(evidence_captured_ids) FROM link, hub WHERE lower(source) = hub.id OR lower(target) = hub.id)",
        "firsts AS (SELECT lower(c) AS id FROM named WHERE c IS NOT NULL AND c <> '' GROUP BY 1 ORDER BY min({'s': src, 'p': pos}), id LIMIT 8)", query="SELECT id, title FROM cap WHERE id IN (SELECT id FROM firsts)"),
    "kind_filter_unknown": sql(NODE, query="SELECT CASE WHEN kind IN ('person', 'event', 'object', 'concept', 'view', 'conclusion', 'todo', 'question', 'time', 'location', 'organization', 'role') THEN kind ELSE 'unknown' END AS kind, count(*) AS n FROM node GROUP BY 1"),
    "recent_sub_graph": sql(NODE, EDGE, "shown AS (SELECT id FROM node WHERE created_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND created_at <= TIMESTAMPTZ '2025-12-31 23:59:59.999+00')", query="SELECT id, least(14, 6 + count(dst))::BIGINT AS size FROM shown LEFT JOIN (SELECT * FROM adj WHERE dst IN (SELECT id FROM shown)) x ON x.src = shown.id GROUP BY id"),
    "alias_first_match": sql(NODE, f"asked AS (SELECT scope_id, id AS key, generate_subscripts(aliases, 1) AS pos, {_NORM.format(c='unnest(aliases)')} AS n FROM node)", f"known AS (SELECT scope_id, id AS node_id, 0 AS prio, {_NORM.format(c='name')} AS n FROM node UNION ALL SELECT scope_id, id, 1, {_NORM.format(c='unnest(aliases)')} FROM node)",
        query="SELECT key, node_id FROM (SELECT key, node_id, row_number() OVER (PARTITION BY a.scope_id, key ORDER BY pos, prio, node_id) AS rn FROM asked a JOIN known k ON k.scope_id = a.scope_id AND k.n = a.n WHERE a.n <> '') WHERE rn = 1"),
    "nodes_without_topic": sql(NODE, LABEL, query="SELECT id FROM node WHERE id NOT IN (SELECT id FROM label)"),
    "topic_signatures": sql(NODE, LABEL, _TOPIC, query="SELECT topic, sha1(string_agg(id, '|' ORDER BY id)) AS signature FROM topic GROUP BY 1"),
    "kind_ranks": sql(NODE, query="SELECT kind, CASE kind WHEN 'person' THEN 10 WHEN 'event' THEN 9 WHEN 'object' THEN 8 WHEN 'concept' THEN 7 WHEN 'view' THEN 6 WHEN 'conclusion' THEN 6 WHEN 'todo' THEN 6 WHEN 'question' THEN 6 WHEN 'time' THEN 5 WHEN 'location' THEN 5 ELSE 0 END AS priority, count(*) AS n FROM node GROUP BY kind"),
    "link_merge_upsert": sql(LINK, "x AS (SELECT coalesce(lower(user_id), '00000000-0000-0000-0000-000000000000') AS scope_id, lower(source) AS source, lower(target) AS target, coalesce(relation_type, 'related_to') AS relation_type, confidence, coalesce(evidence_captured_ids, []) AS ev FROM link WHERE source IS NOT NULL AND target IS NOT NULL AND lower(source) <> lower(target))",
        query="SELECT scope_id, source, target, relation_type, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list(ev)), lambda e: trim(e)), lambda e: e IS NOT NULL AND e <> ''))), ',') AS evidence, max(confidence) AS confidence, count(*) AS n_rows FROM x GROUP BY 1, 2, 3, 4"),
    "dangling_reference_repair": sql(CAP, NODE, "r AS (SELECT id, unnest(src) AS c, generate_subscripts(src, 1) AS pos FROM node)", query="SELECT id, coalesce(string_agg(c, ',' ORDER BY pos) FILTER (WHERE lower(c) IN (SELECT id FROM cap)), '') AS kept, count(*) FILTER (WHERE c IS NULL OR lower(c) NOT IN (SELECT id FROM cap)) AS n_dropped FROM r GROUP BY id HAVING n_dropped > 0"),
    "deleted_refs_removed": sql(NODE, "gone AS (SELECT list(DISTINCT lower(id)) AS ids FROM deleted_captures)", query="SELECT id, CASE WHEN len(list_filter(src, lambda x: x IS NOT NULL AND list_contains(ids, lower(x)))) = 0 THEN len(src) ELSE len(list_distinct(list_filter(src, lambda x: x IS NOT NULL AND NOT list_contains(ids, lower(x))))) + CASE WHEN len(list_filter(src, lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END END AS n_left FROM node, gone"),
    "latest_snapshot_merge": sql(CAP, query="SELECT CASE WHEN graph_status IS NOT NULL THEN 'completed' END AS graph_status, count(*) AS n FROM cap GROUP BY 1"),
    "insert_ignore_duplicates": sql(CAP, query=f"SELECT id FROM cap WHERE created_at >= {ASOF} - INTERVAL 200 DAY"),
    "status_timeout_reconcile": sql(CAP, query=f"SELECT CASE WHEN processing_status IS NULL THEN 'pending' WHEN processing_status <> 'failed' AND embedding_status = 'completed' AND graph_status = 'completed' THEN 'completed' WHEN processing_status = 'processing' AND coalesce(processed_at, created_at) < {ASOF} - INTERVAL 3 MINUTE THEN 'failed' ELSE processing_status END AS state, count(*) AS n FROM cap GROUP BY 1"),
}
ORACLES["ppr_bridges"] = _ppr_bridges_sql(15)
