"""Queries on references to missing records (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamgraph.operators.references import orphan_references, orphan_report, references
from loamgraph.runtime import table


def _misses(spark: SparkSession, d: str) -> DataFrame:
    captures, nodes, links = (table(spark, d, t) for t in ("captured_info", "knowledge_nodes", "knowledge_links"))
    refs = references(nodes, "nodes.source_captured_ids", "id", "source_captured_ids", "created_at", "captured_info")
    for column, parent in (("evidence_captured_ids", "captured_info"), ("source", "knowledge_nodes"), ("target", "knowledge_nodes")):
        refs = refs.unionByName(references(links, f"links.{column}", "id", column, "created_at", parent))
    parents = captures.select(F.lit("captured_info").alias("parent"), F.col("id").alias("key")).unionByName(
        nodes.select(F.lit("knowledge_nodes").alias("parent"), F.col("id").alias("key"))
    )
    return orphan_references(refs, parents)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _misses(spark, d).select("ref_field", "record_id", "ref_id")


def p6_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_misses(spark, d))


_REFS = """
WITH refs AS (
    SELECT 'nodes.source_captured_ids' AS ref_field, lower(id) AS record_id, unnest(source_captured_ids) AS ref_id, created_at FROM knowledge_nodes
    UNION ALL SELECT 'links.evidence_captured_ids', lower(id), unnest(evidence_captured_ids), created_at FROM knowledge_links
    UNION ALL SELECT 'links.source', lower(id), source, created_at FROM knowledge_links
    UNION ALL SELECT 'links.target', lower(id), target, created_at FROM knowledge_links
), orphans AS (
    SELECT ref_field, record_id, ref_id, min(created_at) AS created_at FROM refs
    WHERE ref_id IS NOT NULL AND ref_id <> '' AND NOT EXISTS (
        SELECT 1 FROM (
            SELECT 'c' AS p, lower(id) AS k FROM captured_info UNION SELECT 'n', lower(id) FROM knowledge_nodes
        ) t WHERE t.p = CASE WHEN ref_field IN ('links.source', 'links.target') THEN 'n' ELSE 'c' END AND t.k = lower(ref_id))
    GROUP BY ref_field, record_id, ref_id
)
"""

QUERIES = {"p6_found": p6_found, "p6_orphan_report": p6_orphan_report}
ORACLES = {
    "p6_found": _REFS + "SELECT ref_field, record_id, ref_id FROM orphans",
    "p6_orphan_report": _REFS
    + """SELECT ref_field, strftime(created_at, '%Y-%m') AS month, count(*) AS n_orphans, count(DISTINCT ref_id) AS n_ids,
    count(DISTINCT record_id) AS n_records FROM orphans GROUP BY 1, 2""",
}
