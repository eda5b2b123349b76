"""Backup, restore and export."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamgraph.functions.text import normalize_name, or_empty
from loamgraph.operators.records import insert_ignoring
from loamgraph.sources.tables import SCHEMAS

TABLES = ("captured_info", "knowledge_nodes", "knowledge_links")
VERSION = 1


def dump(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Each table as JSON lines in a folder of its own, and a manifest of the counts, which are returned."""
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").json(os.path.join(path, name))
        counts[name] = df.sparkSession.read.schema(df.schema).json(os.path.join(path, name)).count()
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(list(counts.items()), "name string, n bigint").coalesce(1).write.mode("overwrite").json(os.path.join(path, "manifest"))
    return counts


def verified(spark: SparkSession, path: str) -> DataFrame:
    """``(name, expected, found)`` of a dump's tables."""
    manifest = spark.read.schema("name string, n bigint").json(os.path.join(path, "manifest"))
    rows = [(r["name"], r["n"], spark.read.json(os.path.join(path, r["name"])).count() if r["n"] else 0) for r in manifest.collect()]
    return spark.createDataFrame(rows, "name string, expected bigint, found bigint")


def document(tables: dict[str, DataFrame], exported_at: str, attachments: DataFrame | None = None, most_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """One backup document as JSON text, for a user's data: it gathers a whole scope in a row, as the format wants; use :func:`dump` for more.

    attachments: ``(path, content)``; files above ``most_bytes`` are left out.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = [tables[n].agg(F.collect_list(F.struct(*tables[n].columns)).alias(n)) for n in TABLES]
    files = attachments.where(F.length("content") <= most_bytes) if attachments is not None else spark.createDataFrame([], "path string, content binary")
    parts.append(files.agg(F.collect_list(F.struct("path", F.base64("content").alias("data"))).alias("attachments")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    counts = F.struct(*[F.size(n).alias(n) for n in TABLES])
    return out.select(F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(exported_at).alias("exported_at"), counts.alias("counts"), *TABLES, "attachments")).alias("document"))


def restored(existing: dict[str, DataFrame], backup: dict[str, DataFrame], user_id: str | None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rows of a backup that are to be added to a user's tables, and ``(name, inserted, skipped)``.

    The rows become the user's, vectors are left out (they are made anew) and normalised names are worked out again.
    """
    new, counts = {}, []
    for name in TABLES:
        rows = backup[name].withColumn("user_id", F.lit(user_id).cast("string"))
        if "embedding" in rows.columns:
            rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
        if "normalized_name" in rows.columns:
            rows = rows.withColumn("normalized_name", normalize_name("name"))
        if "scope_id" in rows.columns:
            rows = rows.withColumn("scope_id", F.coalesce("user_id", F.lit("00000000-0000-0000-0000-000000000000")))
        new[name] = insert_ignoring(existing[name], rows, ["id"])
        counts.append(new[name].agg(F.lit(name).alias("name"), F.count("*").alias("inserted")).crossJoin(rows.agg(F.count("*").alias("n"))).select("name", "inserted", (F.col("n") - F.col("inserted")).alias("skipped")))
    report = counts[0]
    for c in counts[1:]:
        report = report.unionByName(c)
    return new, report


def markdown(captures: DataFrame) -> DataFrame:
    """``(id, created_at, value)``: a section for each capture; # at the start of a line is escaped in its text."""
    text = F.regexp_replace(F.coalesce(F.nullif("content", F.lit("")), F.nullif("summary", F.lit("")), F.lit("")), r"(?m)^#", r"\\#")
    head = F.concat(F.lit("## "), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")))
    facts = F.concat_ws(" · ", F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.nullif(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", "), F.lit("")))
    return captures.select("id", "created_at", F.concat_ws("\n\n", head, facts, F.nullif(text, F.lit("")), F.nullif(or_empty("note"), F.lit(""))).alias("value"))


def wiped(tables: dict[str, DataFrame], user_id: str) -> dict[str, DataFrame]:
    """The tables without a user's rows; links first, then nodes, labels and captures, so that no reference outlives its row."""
    order = ("knowledge_links", "knowledge_nodes", "topic_labels", "captured_info")
    column = {"topic_labels": "scope_id"}
    return {n: tables[n].where(~F.coalesce(F.col(column.get(n, "user_id")) == user_id, F.lit(False))) for n in order if n in tables}


def restored_from_dump(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """The tables with the rows of the scopes in a dump replaced by the dump's; doing it again changes nothing more."""
    spark = next(iter(tables.values())).sparkSession
    out = {}
    for name, df in tables.items():
        rows = spark.read.schema(df.schema).json(os.path.join(path, name))
        users = rows.select(F.coalesce("user_id", F.lit("")).alias("_u")).distinct()
        out[name] = df.withColumn("_u", F.coalesce("user_id", F.lit(""))).join(users, "_u", "left_anti").select(*df.columns).unionByName(rows)
    return out


def read_dump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.schema(SCHEMAS[n]).json(os.path.join(path, n)) for n in TABLES}
