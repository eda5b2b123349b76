"""Scans and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamgraph.functions.scores import valid_vector
from loamgraph.functions.text import contains_text, is_supported_file, mime_of, size_text
from loamgraph.operators import records, search
from loamgraph.queries.common import ASOF, CAP, DIM, LINK, NODE, ZERO, asof, sql
from loamgraph.sources.tables import captures, links, nodes


HAS_VECTOR = "embedding IS NOT NULL"


def _query(df: DataFrame) -> DataFrame:
    """The vector of the record with the smallest id, as a table of one row."""
    return df.where(valid_vector("embedding", DIM)).agg(F.min(F.struct("id", "embedding"))["embedding"].alias("q"))


def semantic_search_topk(spark: SparkSession, d: str) -> DataFrame:
    c = captures(spark, d, "embedding", "title", where=HAS_VECTOR)
    return search.vector_search(c, _query(c), 20, 0.3, DIM).select("id", "title", "similarity", "tier")


def node_search_scoped(spark: SparkSession, d: str) -> DataFrame:
    mine = nodes(spark, d, "name", "kind", "embedding", where=F.col("scope_id") == ZERO)
    return search.vector_search(mine, _query(nodes(spark, d, "embedding", where=HAS_VECTOR)), 20, 0.1, DIM).select("id", "name", "similarity", "tier")


def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = captures(spark, d, "embedding", "tags", "created_at", where=HAS_VECTOR).where(valid_vector("embedding", DIM))
    return search.similar_pairs(c, ["scope_id"], threshold=0.7)


def nearest_same_kind(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "kind", "embedding", "created_at", where=HAS_VECTOR).where(valid_vector("embedding", DIM))
    new = F.unix_millis("created_at") >= F.unix_millis(asof()) - 30 * 86_400_000
    return search.nearest_match(n.where(new).select("scope_id", "kind", "id", "embedding"), n.where(~new).select("scope_id", "kind", "id", "embedding"), ["scope_id", "kind"], 0.3)


def capture_to_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "name", "embedding", where=HAS_VECTOR)
    return search.vector_search(n, _query(captures(spark, d, "embedding", where=HAS_VECTOR)), 5, 0.2, DIM).select("id", "name", "similarity")


def pinned_recent_order(spark: SparkSession, d: str) -> DataFrame:
    c = captures(spark, d, "is_pinned", "created_at", "title")
    order = [F.coalesce("is_pinned", F.lit(False)).desc(), F.col("created_at").desc_nulls_last(), F.col("id")]
    return c.orderBy(*order).select("id", F.coalesce("is_pinned", F.lit(False)).alias("pinned"), "title")


def recent_per_scope(spark: SparkSession, d: str) -> DataFrame:
    since = F.lit("2025-06-01 00:00:00+00:00").cast("timestamp")
    c = captures(spark, d, "created_at", "title", where=(F.col("created_at") >= since) & (F.col("created_at") < asof()))
    return records.newest(c, 40, partition=["scope_id"]).select("scope_id", "id", "title")


def unsettled_captures(spark: SparkSession, d: str) -> DataFrame:
    return records.unsettled(captures(spark, d, "title")).select("id", "processing_status", "embedding_status", "graph_status")


def delta_since_watermark(spark: SparkSession, d: str) -> DataFrame:
    late = records.after_watermark(F.lit("2025-12-01 00:00:00+00:00").cast("timestamp"))
    return captures(spark, d, "created_at", where=late).select("id", F.unix_millis("created_at").alias("created_ms"))


def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return captures(spark, d, "type", where=F.col("embedding").isNull()).groupBy("type").agg(F.count("*").alias("n"))


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return captures(spark, d, "title", "content").where(contains_text("sleep", "title", "content")).select("id", "title")


def node_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "name", "kind", "aliases").withColumn("al", F.concat_ws(" ", "aliases"))
    return n.where(contains_text("plan", "name", "kind", "al")).select("id", "name", "kind")


def mime_from_extension(spark: SparkSession, d: str) -> DataFrame:
    c = captures(spark, d, "file_name", "mime_type", "type", "file_size").where(F.col("file_name").isNotNull())
    ok = is_supported_file("type", "mime_type", "file_name") & (F.coalesce("file_size", F.lit(0)) <= 10 * 1024 * 1024)
    return c.select("id", mime_of("file_name").alias("mime"), ok.alias("accepted"))


def storage_usage(spark: SparkSession, d: str) -> DataFrame:
    c = captures(spark, d, "file_size", "type")
    u = c.groupBy("type").agg(F.sum(F.when(F.col("file_size") > 0, F.col("file_size"))).alias("bytes"), F.count_if(F.col("file_size") > 0).alias("n_files"))
    return u.select("type", F.coalesce("bytes", F.lit(0)).alias("bytes"), "n_files", size_text("bytes").alias("size"))


def source_previews(spark: SparkSession, d: str) -> DataFrame:
    return search.previews(nodes(spark, d, "source_captured_ids"), "source_captured_ids", captures(spark, d, "summary", "content", "title"))


def neighbour_previews(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "name")
    return search.neighbour_names(n, links(spark, d), n)


_UNIT = "len({e}) = 64 AND list_inner_product({e}::DOUBLE[], {e}::DOUBLE[]) > 0"
_Q = "q AS (SELECT arg_min(embedding, id)::DOUBLE[] AS q FROM {t} WHERE " + _UNIT.format(e="embedding") + ")"
_SIM = "round(list_cosine_similarity(embedding::DOUBLE[], q), 6)"
_TIER = "CASE WHEN similarity >= 0.8 THEN 'high' WHEN similarity >= 0.5 THEN 'medium' ELSE 'low' END AS tier"

QUERIES = {
    f.__name__: f
    for f in (
        semantic_search_topk, node_search_scoped, similar_pairs, nearest_same_kind, capture_to_nodes, pinned_recent_order, recent_per_scope, unsettled_captures, delta_since_watermark,
        missing_embeddings, keyword_search, node_keyword_search, mime_from_extension, storage_usage, source_previews, neighbour_previews,
    )
}
ORACLES = {
    "semantic_search_topk": sql(CAP, _Q.format(t="cap"), query=f"SELECT id, title, similarity, {_TIER} FROM (SELECT id, title, {_SIM} AS similarity FROM cap, q WHERE {_UNIT.format(e='embedding')}) WHERE similarity > 0.3 ORDER BY similarity DESC, id LIMIT 20"),
    "node_search_scoped": sql(NODE, _Q.format(t="node"), query=f"SELECT id, name, similarity, {_TIER} FROM (SELECT id, name, {_SIM} AS similarity FROM node, q WHERE scope_id = '00000000-0000-0000-0000-000000000000' AND {_UNIT.format(e='embedding')}) WHERE similarity > 0.1 ORDER BY similarity DESC, id LIMIT 20"),
    "similar_pairs": sql(CAP, f"""p AS (SELECT scope_id, id, embedding::DOUBLE[] AS e, list_transform(coalesce(tags, []), lambda t: lower(t)) AS tags FROM cap WHERE {_UNIT.format(e='embedding')}
        QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC NULLS LAST, id) <= 20)""", query="""SELECT scope_id, id_a, id_b, similarity FROM (
        SELECT x.scope_id, x.id AS id_a, y.id AS id_b, round(list_cosine_similarity(x.e, y.e), 6) AS similarity FROM p x JOIN p y ON x.scope_id = y.scope_id AND x.id < y.id
        WHERE NOT list_has_any(list_filter(x.tags, lambda t: t IS NOT NULL), list_filter(y.tags, lambda t: t IS NOT NULL))) WHERE similarity >= 0.7
        QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY similarity DESC, id_a, id_b) <= 10"""),
    "nearest_same_kind": sql(NODE, f"v AS (SELECT *, created_at >= {ASOF} - INTERVAL 30 DAY AS new FROM node WHERE {_UNIT.format(e='embedding')})", query="""SELECT new_id, known_id, similarity FROM (
        SELECT x.id AS new_id, y.id AS known_id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity FROM v x JOIN v y ON x.scope_id = y.scope_id AND x.kind = y.kind WHERE x.new AND NOT y.new)
        WHERE similarity > 0.3 QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY similarity DESC, known_id) = 1"""),
    "capture_to_nodes": sql(CAP, NODE, _Q.format(t="cap"), query=f"SELECT id, name, similarity FROM (SELECT id, name, {_SIM} AS similarity FROM node, q WHERE {_UNIT.format(e='embedding')}) WHERE similarity > 0.2 ORDER BY similarity DESC, id LIMIT 5"),
    "pinned_recent_order": sql(CAP, query="SELECT id, coalesce(is_pinned, false) AS pinned, title FROM cap ORDER BY coalesce(is_pinned, false) DESC, created_at DESC NULLS LAST, id"),
    "recent_per_scope": sql(CAP, query=f"SELECT scope_id, id, title FROM cap WHERE created_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00' AND created_at < {ASOF} QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC, id) <= 40"),
    "unsettled_captures": sql(CAP, query="SELECT id, processing_status, embedding_status, graph_status FROM cap WHERE coalesce(processing_status, '') <> 'completed' OR coalesce(embedding_status, '') <> 'completed' OR coalesce(graph_status, '') <> 'completed'"),
    "delta_since_watermark": sql(CAP, query="SELECT id, epoch_ms(created_at) AS created_ms FROM cap WHERE epoch_ms(created_at) > epoch_ms(TIMESTAMPTZ '2025-12-01 00:00:00+00') - 1500"),
    "missing_embeddings": sql(CAP, query="SELECT type, count(*) AS n FROM cap WHERE embedding IS NULL GROUP BY type"),
    "keyword_search": sql(CAP, query="SELECT id, title FROM cap WHERE contains(lower(coalesce(title, '')), 'sleep') OR contains(lower(coalesce(content, '')), 'sleep')"),
    "node_keyword_search": sql(NODE, query="SELECT id, name, kind FROM node WHERE contains(lower(coalesce(name, '')), 'plan') OR contains(lower(kind), 'plan') OR contains(lower(array_to_string(aliases, ' ')), 'plan')"),
    "mime_from_extension": sql(CAP, query="""SELECT id, CASE ending WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'md' THEN 'text/markdown' WHEN 'txt' THEN 'text/plain' ELSE '' END AS mime,
        CASE type WHEN 'photo' THEN coalesce(mime_type, '') LIKE 'image/%' WHEN 'audio' THEN coalesce(mime_type, '') LIKE 'audio/%' WHEN 'import' THEN ending IN ('pdf', 'doc', 'docx', 'txt', 'md') ELSE false END AND coalesce(file_size, 0) <= 10485760 AS accepted
        FROM (SELECT *, lower(regexp_extract(file_name, '([^.]+)$', 1)) AS ending FROM cap WHERE file_name IS NOT NULL)"""),
    "storage_usage": sql(CAP, query="""SELECT type, bytes, n_files, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024.0) WHEN bytes < 1073741824 THEN printf('%.1f MB', bytes / 1048576.0) ELSE printf('%.1f GB', bytes / 1073741824.0) END AS size
        FROM (SELECT type, coalesce(sum(file_size) FILTER (WHERE file_size > 0), 0)::BIGINT AS bytes, count(*) FILTER (WHERE file_size > 0) AS n_files FROM cap GROUP BY type)"""),
    "neighbour_previews": sql(NODE, LINK, query="""SELECT id, name, rn FROM (SELECT l.s AS id, n.name, row_number() OVER (PARTITION BY l.s ORDER BY n.name, n.id) AS rn
        FROM (SELECT DISTINCT lower(source) AS s, lower(target) AS t FROM link WHERE lower(source) <> lower(target)) l JOIN node n ON n.id = l.t WHERE l.s IN (SELECT id FROM node)) WHERE rn <= 3"""),
    "source_previews": sql(NODE, CAP, query="""SELECT id, list(text ORDER BY pos)[1:2] AS previews FROM (
        SELECT h.id, h.pos, substr(coalesce(nullif(summary, ''), nullif(content, ''), title), 1, 120) AS text FROM (SELECT id, unnest(src) AS r, generate_subscripts(src, 1) AS pos FROM node) h JOIN cap ON cap.id = lower(h.r)) WHERE text IS NOT NULL GROUP BY id"""),
}
