"""Readers of the engine's tables in the formats that they come in."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loamgraph.functions.text import mime_of
from loamgraph.operators.records import latest, scope_of
from loamgraph.runtime import table
from loamgraph.schemas import CAPTURES, LABELS, LINKS, NODES

#: Rows as a backup takes them: one an id, ids in lower case.
CLEAN = {n: (lambda df: df.where(F.col("id").isNotNull()).withColumn("id", F.lower("id")).dropDuplicates(["id"])) for n in ("captured_info", "knowledge_nodes", "knowledge_links")}
SCHEMAS = {"captured_info": CAPTURES, "knowledge_nodes": NODES, "knowledge_links": LINKS, "topic_labels": LABELS}


def captures(spark: SparkSession, d: str, *columns: str, where: Column | str | None = None) -> DataFrame:
    """The latest state of each capture, with its scope; only ``columns`` are read where given.

    where: a condition on what all rows of a record agree in (its times, scope, type, tags or vector). It is put before the rows of a
    record are united, so that it reaches the scan.
    """
    df = table(spark, d, "captured_info")
    if where is not None:
        df = df.where(where)
    order = [F.col("processed_at").desc_nulls_last(), F.col("processing_status"), F.col("embedding_status"), F.col("graph_status")]
    if columns:
        df = df.select(*dict.fromkeys(["id", "user_id", *columns, "processed_at", "processing_status", "embedding_status", "graph_status"]))
    return latest(df, "id", *order).withColumn("id", F.lower("id")).withColumn("scope_id", scope_of("user_id"))


def nodes(spark: SparkSession, d: str, *columns: str, where: Column | str | None = None) -> DataFrame:
    """Each node once, with the defaults that a reader expects: concept, 10, no aliases and no sources.

    where: as of :func:`captures`, on the values as stored.
    """
    df = table(spark, d, "knowledge_nodes")
    if where is not None:
        df = df.where(where)
    keep = list(dict.fromkeys(["id", "scope_id", *(columns or ("name", "kind", "val", "aliases", "source_captured_ids", "created_at", "updated_at"))]))
    df = df.select(*keep).where(F.col("id").isNotNull()).withColumn("id", F.lower("id")).dropDuplicates(["id"])
    none = F.array().cast("array<string>")
    defaults = {"kind": F.lit("concept"), "val": F.lit(10), "aliases": none, "source_captured_ids": none}
    return df.withColumns({c: F.coalesce(c, v) for c, v in defaults.items() if c in keep})


def links(spark: SparkSession, d: str) -> DataFrame:
    """Each link row once."""
    return table(spark, d, "knowledge_links").where(F.col("id").isNotNull()).withColumn("id", F.lower("id")).dropDuplicates(["id"])


def labels(spark: SparkSession, d: str) -> DataFrame:
    """The newest topic of each node of a scope: ``(cluster_key, name)`` in lower-case keys; the smaller name where equally new."""
    df = table(spark, d, "topic_labels").where(F.col("cluster_key").isNotNull())
    return df.groupBy(F.lower("cluster_key").alias("cluster_key")).agg(F.max(F.struct("created_at", "name"))["name"].alias("name"))


def read_json_table(spark: SparkSession, path: str, name: str, multi_line: bool = False) -> DataFrame:
    """A table from JSON lines, or a JSON array, with its fixed schema; wrong fields become null."""
    return spark.read.schema(SCHEMAS[name]).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)


def read_table(spark: SparkSession, path: str, name: str, source: str = "parquet", **options) -> DataFrame:
    """A table with its fixed schema from any format that Spark reads by path: parquet, orc, json, csv, text-like ones with options.

    CSV holds arrays as JSON text, and a header unless an option says otherwise; what cannot be read becomes null.
    """
    if source == "csv":
        return read_csv_columns(spark, path, name, SCHEMAS[name].names, **options)
    return spark.read.format(source).schema(SCHEMAS[name]).options(**options).load(path)


def read_csv_columns(spark: SparkSession, path: str, name: str, columns: list[str], **options) -> DataFrame:
    """Some columns of a table, in the order of the file, as :func:`read_table` reads them."""
    fields = {f.name: f for f in SCHEMAS[name]}
    flat = T.StructType([T.StructField(c, T.StringType() if isinstance(fields[c].dataType, T.ArrayType) else fields[c].dataType) for c in columns])
    raw = spark.read.format("csv").schema(flat).options(**{"header": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE"} | options).load(path)
    return raw.select(*[F.from_json(c, fields[c].dataType.simpleString()).alias(c) if isinstance(fields[c].dataType, T.ArrayType) else F.col(c) for c in columns])


def write_csv(df: DataFrame, path: str) -> None:
    """A table as :func:`read_table` reads it from CSV."""
    out = df.select(*[F.to_json(c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes])
    out.write.mode("overwrite").options(header=True, escape='"').csv(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, **options) -> DataFrame:
    """A table of a database, read in ``parts`` at once where a numeric key and its bounds are given; filters and columns are pushed to it."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def read_labelled_json(spark: SparkSession, path: str) -> DataFrame:
    """``(text, label, entity)`` of JSON lines ``{text, label: {kind: {entity: positions}}}``."""
    raw = spark.read.schema("text string, label string").json(path)
    return raw.select("text", F.explode(F.from_json("label", "map<string, map<string, string>>")).alias("label", "found")).select("text", "label", F.explode(F.map_keys("found")).alias("entity"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(path, mime, size, text)`` of files; text and Markdown are decoded, PDF and DOCX where their readers are installed, else null.

    A file that cannot be read gives '' and never fails the job.
    """
    schema = "path string, mime string, size bigint, text string"

    def run(frames):
        for pdf in frames:
            pdf["text"] = [_text_of(m, bytes(c)) for m, c in zip(pdf["mime"], pdf["content"])]
            yield pdf[["path", "mime", "size", "text"]]

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", mime_of("path").alias("mime"), F.col("length").alias("size"), "content").mapInPandas(run, schema)


def _text_of(mime: str, content: bytes) -> str | None:
    try:
        if mime == "application/pdf":
            import io

            import pypdf

            return "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages)
        if mime.endswith("wordprocessingml.document"):
            import io
            import re
            import zipfile

            xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8")
            xml = re.sub(r"<w:(?:br|cr)\b[^>]*>", "\n", re.sub(r"<w:tab\b[^>]*>", "\t", re.sub(r"</w:p>", "\n", xml)))
            return html.unescape(re.sub(r"<[^>]+>", "", xml))
        return content.decode("utf-8", errors="replace")
    except ImportError:
        return None
    except Exception:  # noqa: BLE001
        return ""


def read_backup(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a backup document; ValueError where its version or a table is missing."""
    document = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("exported_at", T.StringType()), *[T.StructField(n, T.ArrayType(SCHEMAS[n])) for n in ("captured_info", "knowledge_nodes", "knowledge_links")]])
    raw = spark.read.schema(document).option("multiLine", True).json(path)
    head = raw.select("version", *[F.col(n).isNotNull().alias(n) for n in ("captured_info", "knowledge_nodes", "knowledge_links")]).head()
    if head is None or head["version"] is None:
        raise ValueError("no backup document")
    missing = [n for n in ("captured_info", "knowledge_nodes", "knowledge_links") if not head[n]]
    if missing:
        raise ValueError(f"the backup lacks {', '.join(missing)}")
    return {n: raw.select(F.inline(n)) for n in ("captured_info", "knowledge_nodes", "knowledge_links")}
