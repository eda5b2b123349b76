"""From captures to the graph: ask an extractor, read its answer, resolve, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loamgraph.operators import extraction, records
from loamgraph.runtime import cut
from loamgraph.providers import Answerer, Embedder, answered, embedded
from loamgraph.functions.text import embedding_text, or_empty


def ingested(captures: DataFrame, nodes: DataFrame, links: DataFrame, extractor: Answerer) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and links with the captures' extracted ones merged in, and ``(id, graph_status, error)`` of the captures.

    captures: ``(id, scope_id, content)``. Running it again over the same captures changes nothing more.
    """
    # a model may answer otherwise when asked again, so its answers are written
    answers = cut(answered(captures.withColumn("content", or_empty("content")), "content", extractor))
    graphs = extraction.parsed_graphs(answers.withColumnRenamed("id", "capture_id"))
    got = extraction.extracted_nodes(graphs)
    with_scope = got.join(captures.select(F.col("id").alias("capture_id"), "scope_id"), "capture_id")
    keyed = with_scope.select("scope_id", F.concat_ws(":", "capture_id", "key").alias("key"), "name", "kind", "aliases", F.array("capture_id").alias("source_captured_ids"))
    base = nodes.select("scope_id", "id", "name", "kind", "aliases", "source_captured_ids")
    merged = records.merged_nodes(base, keyed)
    ids = records.alias_matches(keyed.select("scope_id", "key", "name", "aliases"), merged).select("key", "node_id")
    ends = extraction.extracted_links(graphs, got).join(captures.select(F.col("id").alias("capture_id"), "scope_id"), "capture_id")
    s = ids.withColumnsRenamed({"key": "sk", "node_id": "source_id"})
    t = ids.withColumnsRenamed({"key": "tk", "node_id": "target_id"})
    new = (
        ends.withColumn("sk", F.concat_ws(":", "capture_id", "source")).withColumn("tk", F.concat_ws(":", "capture_id", "target")).join(s, "sk").join(t, "tk")
        .select("scope_id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation_type", F.array("capture_id").alias("evidence_captured_ids"))
    )
    rows = links.select(F.col("user_id"), "source", "target", "relation_type", "evidence_captured_ids", "confidence", "created_at", "updated_at")
    added = new.select(F.col("scope_id").alias("user_id"), "source", "target", "relation_type", "evidence_captured_ids", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    status = answers.select("id", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("graph_status"), "error")
    return merged, records.merged_links(rows.unionByName(added)), status


def backfilled(captures: DataFrame, provider: Embedder, batch: int | None = 5) -> DataFrame:
    """``(id, embedding, error)`` for captures without a vector, oldest first."""
    from loamgraph.providers import missing_vectors

    todo = missing_vectors(captures, batch)
    text = embedding_text(or_empty("title"), or_empty("summary"), or_empty("content"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    return embedded(todo.withColumn("_text", text), "_text", provider)


def processed(captures: DataFrame, nodes: DataFrame, links: DataFrame, analyst: Answerer, extractor: Answerer, embedder: Embedder, asof: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Captures, nodes and links after every unsettled capture went through its steps: facts, then the graph, then the vector.

    captures: the table's columns with ``scope_id``. A step that is completed is not done again, so a second run is the retry of what failed; a later
    step is only tried where the facts are there. Failures stand in the step's status and, for the facts, in ``processing_error``.
    """
    todo = cut(records.unsettled(captures))
    first = todo.where(F.coalesce("processing_status", F.lit("")) != "completed")
    answers = cut(answered(first.withColumn("_text", F.concat_ws("\n", or_empty("title"), or_empty("content"))), "_text", analyst))
    facts = extraction.extracted_facts(answers.withColumnRenamed("id", "capture_id")).withColumnRenamed("capture_id", "id")
    told = answers.select("id", F.col("error").alias("_error")).join(facts.select("id", F.col("title").alias("_t"), F.col("summary").alias("_s"), F.col("keywords").alias("_k")), "id").withColumn("_asked", F.lit(True))
    ok = F.col("_asked") & F.col("_error").isNull()
    done = todo.join(told, "id", "left").withColumns(
        {
            "processing_status": F.when(ok, "completed").when(F.col("_asked"), "failed").otherwise(F.col("processing_status")),
            "processing_error": F.when(F.col("_asked"), F.col("_error")).otherwise(F.col("processing_error")),
            "processed_at": F.when(ok, asof).otherwise(F.col("processed_at")),
            "title": F.when(ok, F.coalesce(F.nullif("_t", F.lit("")), "title")).otherwise(F.col("title")),
            "summary": F.when(ok, F.coalesce(F.nullif("_s", F.lit("")), "summary")).otherwise(F.col("summary")),
            "tags": F.when(ok & (F.size("_k") > 0), F.col("_k")).otherwise(F.col("tags")),
        }
    )
    done = cut(done.select(*todo.columns))
    ready = done.where("processing_status = 'completed'")
    merged, linked, graphs = ingested(ready.where("coalesce(graph_status, '') <> 'completed'").select("id", "scope_id", "content"), nodes, links, extractor)
    text = embedding_text(or_empty("title"), or_empty("summary"), or_empty("content"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    vectors = cut(embedded(ready.where("coalesce(embedding_status, '') <> 'completed'").withColumn("_text", text), "_text", embedder))
    steps = vectors.select("id", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("_e"), F.col("embedding").alias("_v"))
    out = done.join(graphs.select("id", F.col("graph_status").alias("_g")), "id", "left").join(steps, "id", "left")
    out = out.withColumns({"graph_status": F.coalesce("_g", "graph_status"), "embedding_status": F.coalesce("_e", "embedding_status"), "embedding": F.coalesce("_v", "embedding")}).select(*todo.columns)
    return captures.join(todo.select("id"), "id", "left_anti").select(*todo.columns).unionByName(out), merged, linked
