"""Keyed changes of the tables, backups, and look-ups of rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamgraph.operators import records
from loamgraph.plans import backup
from loamgraph.providers import missing_vectors
from loamgraph.queries.common import CAP, LABEL, LINK, NODE, ZERO, asof, sql
from loamgraph.runtime import scratch_path, table
from loamgraph.sources import tables as sources
from loamgraph.sources.tables import captures, labels, links, nodes


def capture_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first capture by id of the shared scope, looked up by its id."""
    first = captures(spark, d, where="user_id IS NULL").agg(F.min("id")).head()[0] or ""
    return records.point(captures(spark, d, "title", "type", where=F.lower("id") == first), "id", first, ZERO).select("id", "title", "type")


def missing_vector_scan(spark: SparkSession, d: str) -> DataFrame:
    """The five oldest captures without a vector: one run of the backfill."""
    return missing_vectors(captures(spark, d, "embedding", "created_at", where="embedding IS NULL"), 5).select("id")


def captures_as_first_written(spark: SparkSession, d: str) -> DataFrame:
    out = records.started(captures(spark, d, "title", "content", "type"), asof())
    return out.select("id", "title", F.size("tags").alias("n_tags"), "summary", "processing_status", "graph_status", "embedding_status", F.unix_millis("created_at").alias("created_ms"))


def updated_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Deleted captures unpinned and retitled where they are still there."""
    gone = table(spark, d, "deleted_captures").select(F.lower("id").alias("id"))
    out = records.update_where(captures(spark, d, "title", "is_pinned"), gone, "id", {"title": F.concat(F.lit("[gone] "), F.coalesce("title", F.lit(""))), "is_pinned": F.lit(False)})
    return out.select("id", "title", "is_pinned")


def deleted_by_list(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "deleted_captures").select(F.lower("id").alias("id"))
    return records.delete_where(captures(spark, d, "title"), gone, "id").select("id", "title")


def topic_cache_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Labels of new nodes replaced by their kind: delete, then insert by key."""
    old = labels(spark, d)
    new = nodes(spark, d, "kind", "created_at").where(F.col("created_at") >= F.lit("2025-10-01 00:00:00+00:00").cast("timestamp"))
    return records.replace_by_key(old, new.select(F.col("id").alias("cluster_key"), F.col("kind").alias("name")), ["cluster_key"])


def name_cache_insert(spark: SparkSession, d: str) -> DataFrame:
    """Nodes' names added to the label cache where it has no row of their key."""
    return records.insert_ignoring(labels(spark, d), nodes(spark, d, "name").select(F.col("id").alias("cluster_key"), "name"), ["cluster_key"])


def vectors_updated_from_values(spark: SparkSession, d: str) -> DataFrame:
    """Missing vectors of nodes set from a table of values, one a row."""
    n = nodes(spark, d, "embedding", "val")
    values = n.where(F.col("embedding").isNull()).select("id", F.array_repeat(F.col("val").cast("float"), 3).alias("embedding"))
    return records.updated_from(n, values, "id", ["embedding"]).select("id", F.size("embedding").alias("n"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


def links_seeded_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Links between the alphabetically first nodes' names, wanted in every scope that has both."""
    n = nodes(spark, d, "name")
    few = [r[0] for r in n.where("trim(name) <> ''").groupBy(F.lower(F.trim("name")).alias("n")).count().orderBy("n").limit(30).collect()]
    wanted = spark.createDataFrame([(a.upper(), f" {b} ", "related_to") for a, b in zip(few, few[1:])], "source_name string, target_name string, relation_type string")
    return records.seeded_links(links(spark, d), n, wanted)


def dump_verified(spark: SparkSession, d: str) -> DataFrame:
    """The tables dumped to files and counted again."""
    path = scratch_path(spark, "dump")
    backup.dump({n: table(spark, d, n) for n in backup.TABLES}, path)
    return backup.verified(spark, path)


def dump_restored_twice(spark: SparkSession, d: str) -> DataFrame:
    """One scope's rows dumped, changed, and restored two times over: every table is as it was."""
    whole = {n: table(spark, d, n).drop("embedding") for n in backup.TABLES}
    user = whole["captured_info"].agg(F.min("user_id")).head()[0]
    path = scratch_path(spark, "dump")
    backup.dump({n: t.where(F.col("user_id") == user) for n, t in whole.items()}, path)
    now = {n: t.where((F.col("user_id") != user) | F.col("user_id").isNull()).unionByName(t.where(F.col("user_id") == user).limit(1)) for n, t in whole.items()}
    for _ in range(2):
        now = backup.restored_from_dump(now, path)
    out = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.countDistinct("id").alias("n_ids")) for n, t in now.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def backup_document_restored(spark: SparkSession, d: str) -> DataFrame:
    """The shared scope written as one backup document, read again and restored over half of its rows: what is inserted and skipped."""
    own = {n: sources.CLEAN[n](table(spark, d, n)).where(F.col("user_id").isNull()) for n in backup.TABLES}
    path = scratch_path(spark, "document")
    backup.document(own, "2025-12-31T00:00:00Z").coalesce(1).write.text(path)
    half = {n: t.where(F.col("id") < "8") for n, t in own.items()}
    return backup.restored(half, sources.read_backup(spark, path), None)[1]


def scope_wiped(spark: SparkSession, d: str) -> DataFrame:
    """Rows left of each table once the user with the most captures is deleted."""
    user = table(spark, d, "captured_info").where("user_id IS NOT NULL").groupBy("user_id").count().orderBy(F.col("count").desc(), "user_id").limit(1).agg(F.min("user_id")).head()[0]
    left = backup.wiped({n: table(spark, d, n) for n in (*backup.TABLES, "topic_labels")}, user or "")
    out = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def labelled_entities(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as JSON lines with nested labels, read as an annotated data set is: entities by label."""
    path = scratch_path(spark, "labelled")
    n = nodes(spark, d, "name", "kind").where("name <> ''")
    nested = F.create_map(F.col("kind"), F.create_map(F.col("name"), F.array(F.array(F.lit(0), F.length("name")))))
    n.select(F.col("name").alias("text"), nested.alias("label")).write.json(path)
    return sources.read_labelled_json(spark, path).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("n_entities"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nodes written as CSV and read again with their schema."""
    path = scratch_path(spark, "csv")
    sources.write_csv(nodes(spark, d).select("id", "scope_id", "name", "kind", "aliases", "source_captured_ids", "val"), path)
    back = sources.read_csv_columns(spark, path, "knowledge_nodes", ["id", "scope_id", "name", "kind", "aliases", "source_captured_ids", "val"])
    return back.select("id", "name", "kind", F.size("aliases").alias("n_aliases"), F.size("source_captured_ids").alias("n_sources"), "val")


def merged_new_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes made since October merged into the older ones by name, alias and vector."""
    n = nodes(spark, d, "name", "kind", "aliases", "source_captured_ids", "created_at", "embedding").where(F.col("name").isNotNull())
    new = F.coalesce(F.col("created_at") >= F.lit("2025-10-01 00:00:00+00:00").cast("timestamp"), F.lit(False))
    old, fresh = n.where(~new), n.where(new)
    columns = ["scope_id", "id", "name", "kind", "aliases", "source_captured_ids"]
    merged = records.merged_nodes(old.select(*columns), fresh.select(*columns).withColumnRenamed("id", "key"), (fresh.where("size(embedding) = 64").select(F.col("id").alias("key"), "embedding"), old.where("size(embedding) = 64").select("id", "embedding")))
    return merged.select("scope_id", "id", "name", "kind", F.size("aliases").alias("n_aliases"), F.size("source_captured_ids").alias("n_sources"))


_USER = "usr AS (SELECT min(user_id) AS u FROM captured_info)"
_GONE = "gone AS (SELECT DISTINCT lower(id) AS id FROM deleted_captures WHERE id IS NOT NULL)"
_UNION = " UNION ALL ".join
QUERIES = {
    f.__name__: f
    for f in (
        capture_point_lookup, missing_vector_scan, captures_as_first_written, updated_by_key, deleted_by_list, topic_cache_rewrite, name_cache_insert, vectors_updated_from_values, links_seeded_by_name,
        dump_verified, dump_restored_twice, backup_document_restored, scope_wiped, labelled_entities, csv_round_trip, merged_new_nodes,
    )
}
ORACLES = {
    "capture_point_lookup": sql(CAP, query=f"SELECT id, title, type FROM cap WHERE id = (SELECT min(id) FROM cap WHERE scope_id = '{ZERO}') AND scope_id = '{ZERO}'"),
    "missing_vector_scan": sql(CAP, query="SELECT id FROM cap WHERE embedding IS NULL ORDER BY created_at NULLS FIRST, id LIMIT 5"),
    "captures_as_first_written": sql(CAP, query="SELECT id, coalesce(nullif(trim(title), ''), nullif(substr(trim(content), 1, 30), ''), 'Untitled') AS title, 0 AS n_tags, '' AS summary, 'processing' AS processing_status, 'pending' AS graph_status, 'pending' AS embedding_status, epoch_ms(TIMESTAMPTZ '2025-12-31 00:00:00+00') AS created_ms FROM cap"),
    "updated_by_key": sql(CAP, _GONE, query="SELECT id, CASE WHEN id IN (SELECT id FROM gone) THEN '[gone] ' || coalesce(title, '') ELSE title END AS title, CASE WHEN id IN (SELECT id FROM gone) THEN false ELSE is_pinned END AS is_pinned FROM cap"),
    "deleted_by_list": sql(CAP, _GONE, query="SELECT id, title FROM cap WHERE id NOT IN (SELECT id FROM gone)"),
    "topic_cache_rewrite": sql(NODE, LABEL, "new AS (SELECT id AS cluster_key, kind AS name FROM node WHERE created_at >= TIMESTAMPTZ '2025-10-01 00:00:00+00')", query="SELECT id AS cluster_key, topic AS name FROM label WHERE id NOT IN (SELECT cluster_key FROM new) UNION ALL SELECT * FROM new"),
    "name_cache_insert": sql(NODE, LABEL, query="SELECT id AS cluster_key, name FROM node WHERE id NOT IN (SELECT id FROM label)"),
    "vectors_updated_from_values": sql(NODE, query="SELECT id, CASE WHEN embedding IS NULL THEN 3 ELSE len(embedding) END::INTEGER AS n, round(CASE WHEN embedding IS NULL THEN val ELSE embedding[1] END::DOUBLE, 5) AS first FROM node"),
    "links_seeded_by_name": sql(NODE, "few AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM (SELECT DISTINCT lower(trim(name)) AS n FROM node WHERE trim(name) <> '') ORDER BY n LIMIT 30)", "w AS (SELECT x.n AS sn, y.n AS tn FROM few x JOIN few y ON y.k = x.k + 1)", "named AS (SELECT scope_id, lower(trim(name)) AS n, min(id) AS id FROM node GROUP BY 1, 2)",
        query="SELECT s.scope_id, s.id AS source, t.id AS target, 'related_to' AS relation_type FROM w JOIN named s ON s.n = lower(upper(sn)) JOIN named t ON t.n = tn AND t.scope_id = s.scope_id WHERE NOT EXISTS (SELECT 1 FROM knowledge_links l WHERE lower(l.source) = s.id AND lower(l.target) = t.id)"),
    "dump_verified": _UNION(f"SELECT '{n}' AS name, count(*) AS expected, count(*) AS found FROM {n}" for n in backup.TABLES),
    "dump_restored_twice": _UNION(f"SELECT '{n}' AS name, count(*) AS n, count(DISTINCT id) AS n_ids FROM {n}" for n in backup.TABLES),
    "backup_document_restored": _UNION(f"SELECT '{n}' AS name, count(*) FILTER (WHERE id >= '8') AS inserted, count(*) FILTER (WHERE id < '8') AS skipped FROM (SELECT DISTINCT lower(id) AS id FROM {n} WHERE id IS NOT NULL AND user_id IS NULL)" for n in backup.TABLES),
    "scope_wiped": "WITH usr AS (SELECT user_id AS u FROM captured_info WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) " + _UNION(f"SELECT '{n}' AS name, count(*) AS n FROM {n}, usr WHERE {c} IS DISTINCT FROM u" for n, c in (*((t, "user_id") for t in backup.TABLES), ("topic_labels", "scope_id"))),
    "labelled_entities": sql(NODE, query="SELECT kind AS label, count(*) AS n, count(DISTINCT name) AS n_entities FROM node WHERE name <> '' GROUP BY 1"),
    "csv_round_trip": sql(NODE, query="SELECT id, nullif(name, '') AS name, kind, len(aliases)::INTEGER AS n_aliases, len(src)::INTEGER AS n_sources, val FROM node"),
}
