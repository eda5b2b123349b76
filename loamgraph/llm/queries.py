"""Registered queries of the training-data operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamgraph.llm import clusters, cooccurrence, encoding, leakage, lookalikes, neighbours, personal, tokens, variants, vectors
from loamgraph.runtime import table

#: Length of the embeddings and the cosine from which records count as similar.
DIM, SIMILAR = 64, 0.82


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    captures = vectors.vector_rows(table(spark, d, "captured_info"), "id", "embedding", DIM, "capture")
    return captures.unionByName(vectors.vector_rows(table(spark, d, "knowledge_nodes"), "id", "embedding", DIM, "node"))


# ---- p1: similarity clusters


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    members = clusters.pivot_clusters(_vectors(spark, d), SIMILAR, DIM, rounds=clusters.ROUNDS)
    named = members.groupBy("kind", "pivot").agg(F.min("id").alias("cluster_id"), F.count("*").alias("size"))
    return members.join(named, ["kind", "pivot"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    whole = _clusters(spark, d).where(F.col("isolated") & (F.col("size") >= 4))
    return whole.select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), "cluster_id")


def p1_cluster_report(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster of similar records with its size and most typical members."""
    found = _clusters(spark, d).select("kind", "id", "cluster_id")
    return clusters.describe(found, _vectors(spark, d), DIM).withColumnRenamed("kind", "record_kind")


# ---- p2: texts that look the same


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    names = lookalikes.alike_records(table(spark, d, "knowledge_nodes"), "id", "scope_id", "name")
    stored = table(spark, d, "captured_info").select(F.lit(0).alias("scope"), F.explode("tags").alias("tag")).where("tag <> ''")
    tags = lookalikes.alike(stored, "scope", "tag")
    return names.select(F.lit("name").alias("field"), "key_a", "key_b").unionByName(tags.select(F.lit("tag").alias("field"), F.col("a").alias("key_a"), F.col("b").alias("key_b")))


def p2_canonical_names(spark: SparkSession, d: str) -> DataFrame:
    """Every node's name in the consistent form."""
    nodes = table(spark, d, "knowledge_nodes").select("id", "name")
    return lookalikes.canonical_texts(nodes, "name").select("id", "name", "canonical")


def p2_tag_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct tag with its consistent form and the number of tags that share it."""
    stored = table(spark, d, "captured_info").select(F.lit(0).alias("scope"), F.explode("tags").alias("tag")).where("tag <> ''")
    return lookalikes.forms_of(stored, "scope", "tag").select(F.col("text").alias("tag"), "canonical", "n_alike")


# ---- p3: personal information


def _names(captures: DataFrame, spark: SparkSession, d: str) -> personal.Names:
    texts = captures.select(F.explode(F.array("content", "note")).alias("text")).where(F.col("text").isNotNull())
    return personal.learn_names(texts, table(spark, d, "person_names"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    captures = table(spark, d, "captured_info").select("id", "content", "note")
    found = personal.personal_entities(captures, "id", ["content", "note"], _names(captures, spark, d))
    return found.select(F.lower("id").alias("capture_id"), "field", "pii_type", "nth").distinct()


def p3_sanitised(spark: SparkSession, d: str) -> DataFrame:
    """The captures' texts with typed placeholders in the place of personal information."""
    captures = table(spark, d, "captured_info").select("id", "content", "note")
    return personal.sanitised(captures, ["content", "note"], _names(captures, spark, d))


def p3_disclosing_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms that tell of which personal information they stand beside, with the number of such entities and the most bits."""
    captures = table(spark, d, "captured_info").select("content", "note")
    found = personal.disclosing_terms(captures, ["content", "note"], _names(captures, spark, d))
    return found.groupBy("term", "pii_type").agg(F.count("*").alias("n_entities"), F.max("bits").alias("bits"))


# ---- p4: variant spellings


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.pairs(variants.same_entities(table(spark, d, "knowledge_nodes")))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """The records of entities with more than one: a row for each record, with its spelling and the number of the entity's records."""
    nodes = table(spark, d, "knowledge_nodes")
    e = variants.same_entities(nodes)
    sizes = e.groupBy("scope", "kind", "entity").agg(F.countDistinct("id").alias("n_records")).where("n_records > 1")
    names = nodes.select(F.lower("id").alias("id"), "name").distinct()
    return e.join(sizes, ["scope", "kind", "entity"]).join(names, "id").select("scope", "kind", "entity", "id", "name", "n_records").distinct()


# ---- p5: items that appear together


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.clean_baskets(table(spark, d, "captured_info"), "id", "tags")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.PairTable(spark).apply(cooccurrence.first_load(_baskets(spark, d)))
    return pairs.scores(least=5, lift=6).select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"))


def p5_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """The counts of all pairs after two deliveries: captures made before 2025, then the rest, for which the table is opened again."""
    rows = table(spark, d, "captured_info").select("id", "tags", "created_at")
    early = cooccurrence.clean_baskets(rows.where("created_at < timestamp'2025-01-01'"), "id", "tags")
    path = cooccurrence.PairTable(spark).apply(cooccurrence.first_load(early)).path
    held = cooccurrence.PairTable(spark, path).apply(cooccurrence.changes_between(early, cooccurrence.clean_baskets(rows, "id", "tags")))
    s = held.scores()
    return s.select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


_TAGS = """
WITH t AS (SELECT DISTINCT lower(id) AS id, unnest(tags) AS tag FROM captured_info WHERE id IS NOT NULL),
u AS (SELECT DISTINCT id, tag FROM t WHERE tag IS NOT NULL AND tag <> ''),
n AS (SELECT tag, count(*) AS n FROM u GROUP BY tag),
total AS (SELECT count(DISTINCT id) AS n FROM u),
ab AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS n_ab FROM u x JOIN u y ON x.id = y.id AND x.tag < y.tag GROUP BY 1, 2)
SELECT tag_a, tag_b {columns} FROM ab JOIN n a ON a.tag = tag_a JOIN n b ON b.tag = tag_b, total {where}
"""

# ---- p7: most similar vectors


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.pairs(neighbours.nearest(_vectors(spark, d), 5, SIMILAR, DIM))
    return found.select(F.col("kind").alias("record_kind"), "id_a", "id_b")


_VALID = """
WITH r AS (
    SELECT DISTINCT 'capture' AS kind, lower(id) AS id, embedding::DOUBLE[] AS e FROM captured_info WHERE len(embedding) = 64
    UNION SELECT DISTINCT 'node', lower(id), embedding::DOUBLE[] FROM knowledge_nodes WHERE len(embedding) = 64
), v AS (SELECT kind, id, e::DOUBLE[64] AS e FROM r WHERE id IS NOT NULL AND list_inner_product(e, e) > 0),
s AS (
    SELECT x.kind, x.id AS a, y.id AS b, array_cosine_similarity(x.e, y.e) AS cos FROM v x JOIN v y ON x.kind = y.kind AND x.id <> y.id
    WHERE array_cosine_similarity(x.e, y.e) >= 0.8199
)
"""
_NEAREST = (
    _VALID
    + """, top AS (SELECT * FROM s WHERE round(cos, 6) >= 0.82 QUALIFY row_number() OVER (PARTITION BY kind, a ORDER BY round(cos, 6) DESC, b) <= 5)
SELECT DISTINCT kind AS record_kind, least(a, b) AS id_a, greatest(a, b) AS id_b FROM top"""
)
_CLIQUES = (
    _VALID
    + """, near AS (SELECT kind, a, b FROM s WHERE cos >= 0.82 UNION ALL SELECT kind, id, id FROM v),
around AS (SELECT kind, a, min(b) AS cluster_id, list_sort(list(b)) AS members FROM near GROUP BY kind, a),
same AS (SELECT kind, cluster_id, members FROM around GROUP BY ALL HAVING count(*) = len(members) AND len(members) >= 4)
SELECT kind AS record_kind, unnest(members) AS record_id, cluster_id FROM same"""
)

# ---- p8: encoding with a public tokenizer


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"), os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.tiktoken"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents decoded from their ids; equal to the text, with null texts empty."""
    path = os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.tiktoken")
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, d, "documents"), path), path)


# ---- p9: evaluation texts in the corpus


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with the leaked passages cut out."""
    return leakage.without_leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items"))


def _words_sql(columns: str, source: str) -> str:
    spaced = r"regexp_replace(lower(text), '(\p{Han})', ' \1 ', 'g')"
    return rf"SELECT {columns}, regexp_extract_all({spaced}, '[\p{{L}}\p{{N}}]+') AS w FROM {source}"


_LEAKS = f"""
WITH i AS ({_words_sql("item_id, CASE WHEN lang LIKE 'zh%' THEN 24 ELSE 10 END AS k", "eval_items")}),
d AS ({_words_sql("doc_id", "documents")}),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
dw AS (
    SELECT DISTINCT doc_id, 10 AS k, array_to_string(w[p:p + 9], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 8)) AS p FROM d)
    UNION ALL SELECT DISTINCT doc_id, 24, array_to_string(w[p:p + 23], ' ') FROM (SELECT *, unnest(range(1, len(w) - 22)) AS p FROM d)
)
SELECT DISTINCT item_id, doc_id FROM iw JOIN dw USING (k, s)
"""

# ---- p10: garbled text


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_ids(table(spark, d, "documents"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with the original text, as far as it can be had."""
    return encoding.garbled_texts(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_cluster_report": p1_cluster_report,
    "p2_found": p2_found,
    "p2_canonical_names": p2_canonical_names,
    "p2_tag_forms": p2_tag_forms,
    "p3_found": p3_found,
    "p3_sanitised": p3_sanitised,
    "p3_disclosing_terms": p3_disclosing_terms,
    "p4_found": p4_found,
    "p4_entities": p4_entities,
    "p5_found": p5_found,
    "p5_pair_scores": p5_pair_scores,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p8_round_trip": p8_round_trip,
    "p9_found": p9_found,
    "p9_clean": p9_clean,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}
ORACLES = {
    "p1_found": _CLIQUES,
    "p7_found": _NEAREST,
    "p5_found": _TAGS.format(columns="", where="WHERE n_ab >= 5 AND n_ab * total.n >= 6 * a.n * b.n"),
    "p5_pair_scores": _TAGS.format(columns=", n_ab, a.n AS n_a, b.n AS n_b, round(n_ab::DOUBLE * total.n / (a.n::DOUBLE * b.n), 6) AS lift", where=""),
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": _LEAKS,
}
