"""Scans and keyed changes of tables: views of one tenant, the latest state of a record, merges, clean-up of references.

Plain Parquet has no update; every change is a new DataFrame to be written in the old one's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loamgraph.functions.text import normalize_name, unique_strings
from loamgraph.functions.scores import kind_priority
from loamgraph.runtime import ZERO_SCOPE, free_name


def scope_of(user: Column | str) -> Column:
    """The scope of a user: their id, or the shared one."""
    return F.coalesce(F.lower(F.col(user) if isinstance(user, str) else user), F.lit(ZERO_SCOPE))


def scoped(df: DataFrame, scope_id: str | None, user_col: str = "user_id") -> DataFrame:
    """Rows of one tenant; None stands for rows without a user. On a table as it is read the predicate reaches the scan."""
    return df.where(F.col(user_col).isNull() if scope_id is None else F.col(user_col) == scope_id)


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key, the first by ``order``, which has to be total for a stable result. Rows without a key go."""
    w, rn = Window.partitionBy(F.lower(F.col(key))).orderBy(*order), free_name(df, "_rn")
    return df.where(F.col(key).isNotNull()).withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)


def newest(df: DataFrame, n: int, by: str = "created_at", key: str = "id", partition: list[str] | None = None) -> DataFrame:
    """The n newest rows, or n of each partition; the smaller key first where times are equal."""
    order = [F.col(by).desc_nulls_last(), F.col(key)]
    if not partition:
        return df.orderBy(*order).limit(n)
    rn = free_name(df, "_rn")
    return df.withColumn(rn, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(rn) <= n).drop(rn)


def between(df: DataFrame, since: Column | None, until: Column | None, by: str = "created_at", closed: bool = False) -> DataFrame:
    """Rows from ``since`` to before ``until``, or to ``until`` where closed."""
    if since is not None:
        df = df.where(F.col(by) >= since)
    if until is not None:
        df = df.where(F.col(by) <= until if closed else F.col(by) < until)
    return df


def changed_since(df: DataFrame, watermark: Column, look_back_ms: int = 1500, by: str = "created_at") -> DataFrame:
    """The delta of an incremental pull: rows after the watermark less a look-back."""
    return df.where(after_watermark(watermark, look_back_ms, by))


def after_watermark(watermark: Column, look_back_ms: int = 1500, by: str = "created_at") -> Column:
    """Whether a row is later, to the millisecond, than the watermark less the look-back; a comparison of the column as it is."""
    return F.col(by) >= F.timestamp_millis(F.unix_millis(watermark) - look_back_ms + 1)


def unsettled(df: DataFrame, columns=("processing_status", "embedding_status", "graph_status")) -> DataFrame:
    """Rows of which any step is not completed; a null step counts as not."""
    out = F.lit(False)
    for c in columns:
        out = out | (F.coalesce(F.col(c), F.lit("")) != "completed")
    return df.where(out)


def merge_snapshot(snapshot: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """The delta's row where it has the key, else the snapshot's: one shuffle, no join."""
    src = free_name(snapshot.limit(0).unionByName(delta.limit(0), allowMissingColumns=True), "_src")
    both = snapshot.withColumn(src, F.lit(1)).unionByName(delta.withColumn(src, F.lit(0)), allowMissingColumns=True)
    rn = free_name(both, "_rn")
    return both.withColumn(rn, F.row_number().over(Window.partitionBy(key).orderBy(src))).where(F.col(rn) == 1).drop(rn, src)


def update_where(df: DataFrame, ids: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Columns set to ``values`` in the rows whose key is in ``ids``."""
    mark = free_name(df, "_hit")
    out = df.join(ids.select(F.col(key)).distinct().withColumn(mark, F.lit(True)), key, "left")
    return out.withColumns({c: F.when(F.col(mark), v).otherwise(F.col(c)) for c, v in values.items()}).select(*df.columns)


def updated_from(df: DataFrame, values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with the columns of the rows that ``values (key, columns)`` names set to its values, row by row; its nulls leave the old value.

    Of several rows of a key in ``values`` the one with the smallest values counts.
    """
    new = {c: free_name(df, f"_{c}") for c in columns}
    one = values.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(n) for c, n in new.items()])
    return df.join(one, key, "left").withColumns({c: F.coalesce(n, c) for c, n in new.items()}).select(*df.columns)


def started(rows: DataFrame, asof: Column, processing: str = "processing") -> DataFrame:
    """Captures as they are first written: no summary and no tags yet, steps in their first state, a title from the text where it has none.

    rows: ``(id, user_id, type, title, content)`` and whatever else.
    """
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.substring(F.trim("content"), 1, 30), F.lit("")), F.lit("Untitled"))
    first = {"title": title, "tags": F.array().cast("array<string>"), "summary": F.lit(""), "processing_status": F.lit(processing), "graph_status": F.lit("pending"), "embedding_status": F.lit("pending"), "created_at": asof}
    return rows.withColumns(first)


def point(df: DataFrame, key: str, value: str, scope_id: str | None = None, scope_col: str = "scope_id") -> DataFrame:
    """The row of a key, in a scope where given."""
    out = df.where(F.col(key) == value)
    return out if scope_id is None else out.where(F.col(scope_col) == scope_id)


def seeded_links(links: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(scope_id, source, target, relation_type)`` for links wanted by name ``(source_name, target_name, relation_type)`` that are not there yet.

    Names are matched trimmed and in lower case, within each scope that has both; the smaller id stands for nodes of one name.
    """
    named = nodes.groupBy("scope_id", F.lower(F.trim("name")).alias("n")).agg(F.min("id").alias("id"))
    s, t = named.select("scope_id", F.col("n").alias("sn"), F.col("id").alias("source")), named.select("scope_id", F.col("n").alias("tn"), F.col("id").alias("target"))
    asked = wanted.select(F.lower(F.trim("source_name")).alias("sn"), F.lower(F.trim("target_name")).alias("tn"), "relation_type").distinct()
    out = asked.join(s, "sn").join(t, ["scope_id", "tn"]).select("scope_id", "source", "target", "relation_type").dropDuplicates(["source", "target"])
    return out.join(links.select(F.lower("source").alias("source"), F.lower("target").alias("target")).distinct(), ["source", "target"], "left_anti").select("scope_id", "source", "target", "relation_type")


def delete_where(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def insert_ignoring(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``rows`` that ``df`` has no key of, one a key."""
    return rows.dropDuplicates(keys).join(df.select(*keys).distinct(), keys, "left_anti")


def replace_by_key(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the rows of the keys in ``rows`` replaced by these (delete, then insert)."""
    return df.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def without_refs(df: DataFrame, ids_col: str, removed: DataFrame, removed_col: str = "id") -> DataFrame:
    """Ids of ``removed`` taken out of an array column; rows that hold none of them stay as they are.

    The removed ids are joined, not collected, so their number does not matter.
    """
    gone = removed.select(F.lower(removed_col).alias("_ref")).where(F.col("_ref").isNotNull()).distinct()
    held = df.select("id", F.explode(ids_col).alias("_id")).where(F.col("_id").isNotNull()).withColumn("_ref", F.lower("_id"))
    out = free_name(df, "_gone")
    hits = held.join(gone, "_ref", "left_semi").groupBy("id").agg(F.collect_set("_id").alias(out))
    return df.join(hits, "id", "left").withColumn(ids_col, F.when(F.col(out).isNull(), F.col(ids_col)).otherwise(F.array_except(ids_col, out))).select(*df.columns)


def existing_refs(df: DataFrame, ids_col: str, parents: DataFrame, parent_col: str = "id") -> DataFrame:
    """``(id, kept, n_dropped)`` of the rows with references to no parent: the rest, in order, and how many went.

    Empty and null references count as going to no parent.
    """
    known = parents.select(F.lower(parent_col).alias("_ref")).where(F.col("_ref").isNotNull()).distinct().withColumn("_ok", F.lit(True))
    held = df.select("id", F.posexplode(ids_col).alias("_pos", "_id")).withColumn("_ref", F.lower("_id"))
    checked = held.join(known, "_ref", "left")
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("_pos", "_id")))), lambda x: x["_id"])
    return checked.groupBy("id").agg(kept.alias("kept"), F.count(F.when(F.col("_ok").isNull(), 1)).cast("long").alias("n_dropped")).where("n_dropped > 0")


def alias_matches(extracted: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(scope_id, key, node_id)``: the node that an extracted entity is, by name or alias.

    extracted: ``(scope_id, key, name, aliases)``. The first of its name and aliases that any node has wins; a node's
    own name goes before an alias, then the smaller id. Names are compared normalised; entities without a match are left out.
    """
    asked = extracted.select("scope_id", "key", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "n")).withColumn("n", normalize_name("n")).where("n <> ''")
    known = nodes.select("scope_id", F.col("id").alias("node_id"), F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "n")).withColumn("n", normalize_name("n")).where("n <> ''")
    known = known.groupBy("scope_id", "n").agg(F.min(F.struct((F.col("at") > 0).cast("int").alias("prio"), "node_id")).alias("m"))
    return asked.join(known, ["scope_id", "n"]).groupBy("scope_id", "key").agg(F.min(F.struct("pos", "m")).alias("best")).select("scope_id", "key", F.col("best.m.node_id").alias("node_id"))


def merged_links(links: DataFrame) -> DataFrame:
    """One link a scope, source, target and type: evidence united, the highest confidence, the first and last time.

    Self links and links without an end go; a null type is 'related_to'. Ends are compared without letter case.
    """
    ends = links.where(F.col("source").isNotNull() & F.col("target").isNotNull()).select(
        scope_of("user_id").alias("scope_id"), F.lower("source").alias("source"), F.lower("target").alias("target"), F.coalesce("relation_type", F.lit("related_to")).alias("relation_type"),
        unique_strings("evidence_captured_ids").alias("evidence"), "confidence", "created_at", "updated_at",
    )
    return (
        ends.where("source <> target")
        .groupBy("scope_id", "source", "target", "relation_type")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"),
            F.max("confidence").alias("confidence"),
            F.min("created_at").alias("created_at"),
            F.max(F.coalesce("updated_at", "created_at")).alias("updated_at"),
            F.count("*").alias("n_rows"),
        )
    )


def merged_nodes(existing: DataFrame, extracted: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None, threshold: float = 0.85) -> DataFrame:
    """Nodes after the extracted ones are merged in: matched ones get new aliases, sources and, if it ranks higher, the kind.

    existing: ``(scope_id, id, name, kind, aliases, source_captured_ids)``; extracted: the same with ``key`` for id.
    An entity that no name or alias matches is, where ``vectors`` are given, the node of its scope with the most similar vector above the
    threshold, of the same kind or where either kind is not known: ``(key, embedding)`` of the extracted and ``(id, embedding)`` of the
    existing. What is left becomes nodes with their key as id, one a normalised name.
    """
    hits = alias_matches(extracted.select("scope_id", "key", "name", "aliases"), existing)
    if vectors is not None:
        from loamgraph.operators.search import nearest_match

        todo = extracted.join(hits, ["scope_id", "key"], "left_anti").join(vectors[0], "key").select("scope_id", "kind", F.col("key").alias("id"), "embedding")
        close = nearest_match(todo, existing.join(vectors[1], "id").select("scope_id", "kind", "id", "embedding"), ["scope_id"], threshold, lenient="kind")
        hits = hits.unionByName(close.join(extracted.select("scope_id", F.col("key").alias("new_id")), "new_id").select("scope_id", F.col("new_id").alias("key"), F.col("known_id").alias("node_id")))
    with_id = extracted.join(hits, ["scope_id", "key"], "left").withColumn("norm", normalize_name("name"))
    new_id = F.coalesce("node_id", F.min("key").over(Window.partitionBy("scope_id", "norm")))
    rows = existing.withColumn("src", F.lit(0)).unionByName(with_id.withColumn("id", new_id).withColumn("src", F.lit(1)).select(*existing.columns, "src"))
    first = F.struct("src", "name")
    return rows.groupBy("scope_id", "id").agg(
        F.min(first)["name"].alias("name"),
        F.max(F.struct(kind_priority("kind"), -F.col("src"), "kind"))["kind"].alias("kind"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(unique_strings("aliases"), F.when(F.col("src") == 1, F.array("name")).otherwise(F.array().cast("array<string>"))))))).alias("aliases"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(unique_strings("source_captured_ids"))))).alias("source_captured_ids"),
    )


def settled_states(df: DataFrame, asof: Column, timeout_minutes: int = 3) -> DataFrame:
    """``state`` of a capture: completed once both steps are, failed if processing has shown no progress in time."""
    done = (F.col("embedding_status") == "completed") & (F.col("graph_status") == "completed")
    stuck = (F.col("processing_status") == "processing") & (F.unix_millis(F.coalesce("processed_at", "created_at")) < F.unix_millis(asof) - timeout_minutes * 60_000)
    return df.withColumn("state", F.when(F.col("processing_status").isNull(), "pending").when((F.col("processing_status") != "failed") & done, "completed").when(stuck, "failed").otherwise(F.col("processing_status")))
