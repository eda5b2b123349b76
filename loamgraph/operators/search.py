"""Vector search by brute force over one scan, and similar records among few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loamgraph.functions.scores import cosine, tier, valid_vector
from loamgraph.runtime import broadcast_if, cut

#: Rows of either side that are compared in one task.
BLOCK_ROWS = 4_096


def vector_search(df: DataFrame, query: DataFrame, k: int = 20, threshold: float = 0.3, dim: int | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The k rows most similar to the one vector in ``query (q)``, above the threshold, with similarity (6 decimals) and tier.

    The query is a table of one row, so the join with it adds no rows; rows without a vector or with one of another
    length are left out. The limit is taken by each task first.
    """
    rows = df.where(valid_vector(vector_col, dim)) if dim else df.where(F.col(vector_col).isNotNull())
    one = query.select(F.col("q")).limit(1)
    scored = rows.crossJoin(F.broadcast(one)).withColumn("similarity", F.round(cosine(vector_col, "q"), 6)).drop("q")
    return scored.where(F.col("similarity") > threshold).orderBy(F.col("similarity").desc(), id_col).limit(min(k, 50)).withColumn("tier", tier("similarity"))


def similar_pairs(df: DataFrame, partition: list[str], threshold: float = 0.7, k: int = 10, pool: int = 20, exclude_shared_tags: bool = True) -> DataFrame:
    """The k most similar pairs among the ``pool`` newest rows with a vector of each partition.

    df: ``(partition, id, tags, created_at, embedding)``. Pairs with a tag in common, without letter case, are left out where asked.
    The pool is a part of the feature and bounds the pairs of a partition.
    """
    w = Window.partitionBy(*partition).orderBy(F.col("created_at").desc_nulls_last(), "id")
    low = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t))
    p = df.where(F.col("embedding").isNotNull()).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= pool).select(*partition, "id", "embedding", low.alias("tags"))
    a, b = p.withColumnsRenamed({"id": "id_a", "embedding": "ea", "tags": "ta"}), p.withColumnsRenamed({"id": "id_b", "embedding": "eb", "tags": "tb"})
    both = a.join(b, partition).where(F.col("id_a") < F.col("id_b"))
    if exclude_shared_tags:
        both = both.where(~F.arrays_overlap("ta", "tb") | (F.size("ta") == 0) | (F.size("tb") == 0))
    scored = both.withColumn("similarity", F.round(cosine("ea", "eb"), 6)).where(F.col("similarity") >= threshold)
    best = Window.partitionBy(*partition).orderBy(F.col("similarity").desc(), "id_a", "id_b")
    return scored.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).select(*partition, "id_a", "id_b", "similarity")


def nearest_match(new: DataFrame, known: DataFrame, keys: list[str], threshold: float = 0.85, lenient: str | None = None) -> DataFrame:
    """For each new row the known row with the same keys and the highest cosine above the threshold.

    new, known: ``(keys, id, embedding)``; lenient: a column that has to be equal only where both sides know it. A new row without a
    match is left out; the smaller id wins ties. Both sides are cut into blocks by a hash of the id and compared block by block with one matrix
    product, so that a crowded key is many tasks of bounded size.
    """
    import numpy as np
    import pyarrow as pa

    extra = [lenient] if lenient else []
    sides = [d.where(F.col("embedding").isNotNull()).select(*keys, *extra, "id", F.col("embedding").cast("array<double>").alias("embedding")) for d in (new, known)]
    n = [d.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(c)) for d, c in zip(sides, ("nx", "ny"))]
    blocks = cut(n[0].join(n[1], keys))
    blocks = broadcast_if(blocks, blocks.count())
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c).cast("long")).cast("int")
    fresh = lambda d: d.select(*[F.col(c).alias(c) for c in d.columns])  # noqa: E731  # both sides may come from one table
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x = sides[0].join(blocks, keys).withColumn("_i", part("nx")).withColumn("_j", every("ny")).drop("nx", "ny")
    y = sides[1].join(blocks, keys).withColumn("_j", part("ny")).withColumn("_i", every("nx")).drop("nx", "ny")
    schema = T.StructType([T.StructField("new_id", new.schema["id"].dataType), T.StructField("known_id", known.schema["id"].dataType), T.StructField("similarity", T.DoubleType())])

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(a) and len(b):
            dims = np.array([len(v) for v in a["embedding"].to_pylist()]), np.array([len(v) for v in b["embedding"].to_pylist()])
            for dim in set(dims[0]) & set(dims[1]):
                p, q = a.filter(pa.array(dims[0] == dim)), b.filter(pa.array(dims[1] == dim))
                u, v = (t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for t in (p, q))
                norms = [np.sqrt((m * m).sum(1)) for m in (u, v)]
                u, v = (m / np.where(k > 0, k, 1)[:, None] for m, k in zip((u, v), norms))
                s = np.where((norms[0][:, None] > 0) & (norms[1][None, :] > 0), np.round(u @ v.T, 6), -2.0)
                if extra:
                    k, m = (np.array(t[lenient].to_pylist(), dtype=object) for t in (p, q))
                    s[(k[:, None] != m[None, :]) & (k != None)[:, None] & (m != None)[None, :]] = -2.0  # noqa: E711
                ids = np.array(q["id"].to_pylist(), dtype=object)
                order = np.argsort(ids, kind="stable")
                best = order[s[:, order].argmax(1)]
                ok = np.flatnonzero(s[np.arange(len(s)), best] > threshold)
                out[0] += np.array(p["id"].to_pylist(), dtype=object)[ok].tolist()
                out[1] += ids[best[ok]].tolist()
                out[2] += s[ok, best[ok]].tolist()
        return pa.table({f.name: pa.array(c, t) for f, c, t in zip(schema, out, (a.schema.field("id").type, b.schema.field("id").type, pa.float64()))})

    group = [*keys, "_i", "_j"]
    scored = fresh(x).groupBy(*group).cogroup(fresh(y).groupBy(*group)).applyInArrow(compare, schema)
    best = scored.groupBy("new_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "known_id")).alias("b"))
    return best.select("new_id", F.col("b.known_id").alias("known_id"), (-F.col("b.s")).alias("similarity"))


def previews(hits: DataFrame, ids_col: str, captures: DataFrame, per_hit: int = 2, chars: int = 120) -> DataFrame:
    """``(id, previews)``: the first texts of the captures that a hit names, in order of the ids."""
    named = hits.select("id", F.posexplode(ids_col).alias("pos", "ref")).withColumn("ref", F.lower("ref"))
    text = captures.select(F.lower("id").alias("ref"), F.substring(F.coalesce(F.nullif("summary", F.lit("")), F.nullif("content", F.lit("")), "title"), 1, chars).alias("text")).where(F.col("text").isNotNull())
    return named.join(text, "ref").groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), 1, per_hit).alias("previews"))


def neighbour_names(hits: DataFrame, links: DataFrame, nodes: DataFrame, per_hit: int = 3, most: int | None = None) -> DataFrame:
    """``(id, name, rn)``: up to ``per_hit`` names of the nodes that a hit links to, in order of name; ``most`` for all hits, first names first."""
    to = links.select(F.lower("source").alias("id"), F.lower("target").alias("to")).where("id <> to").distinct()
    named = hits.select("id").join(to, "id").join(nodes.select(F.col("id").alias("to"), "name"), "to")
    w = Window.partitionBy("id").orderBy("name", "to")
    out = named.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_hit).select("id", "name", "rn")
    return out if most is None else out.orderBy("rn", "id").limit(most)


def reason(similarity: Column, summary: Column, tags: Column) -> Column:
    """Tier, percentage and the fields that a hit has."""
    fields = F.array_compact(F.array(F.lit("title"), F.when(F.length(summary) > 0, F.lit("summary")), F.when(F.size(tags) > 0, F.lit("tags"))))
    return F.format_string("%s (%d%%) - %s", tier(similarity), F.floor(similarity * 100 + 0.5).cast("int"), F.concat_ws(", ", fields))
