"""Column expressions over whole tables: dates, texts, vectors, colours, answers, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loamgraph.functions import dates, scores, text
from loamgraph.operators import evaluation, extraction, topics
from loamgraph.queries.common import CAP, LABEL, NODE, sql
from loamgraph.runtime import table
from loamgraph.schemas import KIND_COLOR, topic_rows
from loamgraph.sources.tables import captures, labels, nodes


def request_date_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The first and last moment of the dates that a request may give: a day, a moment, or no date."""
    c = captures(spark, d, "created_at")
    said = F.when(F.substring("id", 1, 1) < "6", F.date_format("created_at", "yyyy-MM-dd")).when(F.substring("id", 1, 1) < "c", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    out = c.select("id", said.alias("said"))
    return out.select("id", F.unix_millis(dates.day_start("said")).alias("since_ms"), F.unix_millis(dates.day_end("said")).alias("until_ms"))


def assembled_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates put together from numbers, many of which the calendar does not have."""
    n = table(spark, d, "documents").select("doc_id")
    year, month, day = (F.pmod("doc_id", F.lit(7)) + 2020).cast("string"), (F.pmod("doc_id", F.lit(14))).cast("string"), F.pmod("doc_id", F.lit(33)).cast("string")
    return n.select("doc_id", dates.assembled_date(year, month, day, "2021-01-01", "2025-12-31").alias("date"))


def capture_embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    c = captures(spark, d, "title", "summary", "content", "tags")
    t = text.embedding_text(text.or_empty("title"), text.or_empty("summary"), text.or_empty("content"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    return c.select("id", F.md5(t).alias("digest"), F.length(t).alias("n"))


def node_embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "name", "normalized_name", "kind", "aliases")
    t = text.node_embedding_text(F.col("name"), F.col("normalized_name"), F.col("kind"), F.col("aliases"))
    return n.select("id", F.md5(t).alias("digest"), F.length(t).alias("n"))


def clipped_texts(spark: SparkSession, d: str) -> DataFrame:
    c = captures(spark, d, "title", "content")
    return c.select("id", text.clip("title", 10).alias("title"), F.length(text.clip("content", 60)).alias("n"))


def norm_variants(spark: SparkSession, d: str) -> DataFrame:
    """The three normal forms of a name that are in use, and whether they agree."""
    n = nodes(spark, d, "name")
    a, b, c = text.normalize_name("name"), text.trimmed_norm("name"), text.spaced_norm("name")
    return n.select("id", b.alias("trimmed"), c.alias("spaced"), ((a == b) & (b == c)).alias("agree"))


def parsed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as JSON and read again, and given another length."""
    n = nodes(spark, d, "embedding").withColumn("json", F.when(F.substring("id", 1, 1) < "c", F.to_json("embedding")).otherwise("[1, oops"))
    return n.select("id", F.size(scores.parse_vector("json")).alias("n"), scores.resized_vector("embedding", 64).isNotNull().alias("kept"))


def topic_looks(spark: SparkSession, d: str) -> DataFrame:
    """Each fine topic's members, its radius and its colour."""
    fine = spark.createDataFrame([(f, i, b) for i, (f, _, b) in enumerate(topic_rows())], "name string, number int, broad int")
    n = labels(spark, d).groupBy("name").agg(F.count("*").alias("members"))
    return n.join(F.broadcast(fine), "name").select("name", "members", F.round(scores.topic_radius("members"), 6).alias("radius"), scores.topic_color("number", "broad").alias("color"))


def node_looks(spark: SparkSession, d: str) -> DataFrame:
    """Nodes' radius by weight and the colour of their kind in three shades."""
    n = nodes(spark, d, "kind", "val").select("kind", "val").distinct()
    color = scores.kind_color("kind")
    return n.select("kind", "val", F.round(scores.member_radius("val"), 6).alias("radius"), scores.kind_size("kind").alias("size"), *[scores.tinted(color, light).alias(f"tint_{light}") for light in (30, 50, 80)])


def encoded_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes in base64, and back."""
    c = captures(spark, d, "note").where("note IS NOT NULL")
    b = F.regexp_replace(F.base64(F.encode("note", "UTF-8")), r"\s", "")
    return c.select("id", b.alias("base64"), (F.decode(F.unbase64(b), "UTF-8") == F.col("note")).alias("same"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties as JSON: as they are, behind talk, and cut off, read by the tolerant parser."""
    e = table(spark, d, "events").select("event_id", "props")
    broken = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("Here it is: ```"), "props", F.lit("``` done"))).when(F.pmod("event_id", F.lit(3)) == 1, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return e.select("event_id", text.parsed_json(broken, "struct<k:bigint>")["k"].alias("k"))


def extraction_scores(spark: SparkSession, d: str) -> DataFrame:
    """Nodes' names looked for among the aliases that they go by: a quality report by kind."""
    n = nodes(spark, d, "name", "kind", "aliases").where("kind IN ('person', 'organization') AND name <> ''")
    case = F.concat_ws("-", "kind", "id")
    expected = n.select(case.alias("case_id"), "name", F.lit(True).alias("wanted"))
    found = n.select(case.alias("case_id"), F.explode("aliases").alias("name")).where("name <> ''").distinct()
    return evaluation.verdicts(evaluation.extraction_quality(expected, found))


def extraction_recall(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "name", "kind", "aliases").where("kind IN ('person', 'organization') AND name <> ''")
    expected = n.select(F.col("id").alias("case_id"), "name", (F.col("kind") == "person").alias("wanted"))
    found = n.select(F.col("id").alias("case_id"), F.explode("aliases").alias("name")).where("name <> ''").distinct()
    return evaluation.recall_precision(evaluation.extraction_quality(expected, found))


def judged_scores(spark: SparkSession, d: str) -> DataFrame:
    """Four scores of each document, clamped to whole points, and their mean."""
    n = table(spark, d, "documents").select(*[(F.pmod("doc_id", F.lit(k)) * 1.5 - 1).alias(f"s{k}") for k in (5, 7, 9, 11)])
    return evaluation.mean_scores(n, ["s5", "s7", "s9", "s11"])


def signals_passed(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.signal_ratio(captures(spark, d, "tags").select(F.col("id").alias("signal"), (F.coalesce(F.size("tags"), F.lit(0)) > 0).alias("passed")))


def answered_topics(spark: SparkSession, d: str) -> DataFrame:
    """A model's answers by number, name or id resolved to nodes, in batches by the first character of the id."""
    n = nodes(spark, d, "name").where("trim(name) <> ''").withColumn("batch", F.substring("id", 1, 2))
    n = n.withColumn("pos", F.row_number().over(Window.partitionBy("batch").orderBy("id")) - 1)
    key = F.when(F.col("pos") % 3 == 0, F.col("pos").cast("string")).when(F.col("pos") % 3 == 1, F.concat(F.lit(" "), F.upper("name"))).otherwise(F.col("id"))
    topic = F.when(F.col("pos") % 5 == 0, F.lit("睡眠")).when(F.col("pos") % 5 == 1, F.lit("no topic")).otherwise("写作")
    entry = F.struct("pos", F.concat(F.lit('"'), F.regexp_replace(key, r'(["\\])', r"\\$1"), F.lit('": "'), topic, F.lit('"')).alias("e"))
    said = n.groupBy("batch").agg(F.concat(F.lit("Sure: {"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), ", "), F.lit("} as asked")).alias("answer"))
    got = topics.resolved_answers(said, n.select("batch", F.col("pos").cast("int").alias("pos"), "id", "name"), [r[0] for r in topic_rows()])
    return got.groupBy("topic").agg(F.count("*").alias("n"))


def extracted_graph_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and links as an extractor would answer them, cleaned: what is left of each capture's graph."""
    n = nodes(spark, d, "name", "kind", "source_captured_ids").where("name <> ''")
    rows = n.select(F.explode("source_captured_ids").alias("capture_id"), "name", F.upper("kind").alias("kind"), "id")
    rows = rows.where("capture_id <> ''").withColumn("capture_id", F.lower("capture_id")).distinct()
    node = F.struct("id", F.concat(F.lit(" "), "name").alias("name"), "kind", F.array(F.lit("")).alias("aliases"))
    own = rows.groupBy("capture_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    link = lambda i: F.struct(F.col("nodes")[0]["id"].alias("source"), F.element_at("nodes", i)["id"].alias("target"), F.lit("knows").alias("type"))
    answer = F.to_json(F.struct("nodes", F.array(link(-1), link(-1), link(1)).alias("links")))
    graphs = extraction.parsed_graphs(own.select("capture_id", F.concat(F.lit("```json "), answer, F.lit(" ```")).alias("answer")))
    kept = extraction.extracted_nodes(graphs)
    ends = extraction.extracted_links(graphs, kept)
    a = kept.groupBy("kind").agg(F.count("*").alias("n"))
    return a.unionByName(ends.groupBy(F.col("relation_type").alias("kind")).agg(F.count("*").alias("n")))


_DATE = "CASE WHEN substr(id, 1, 1) < '6' THEN {a} WHEN substr(id, 1, 1) < 'c' THEN {b} END"
_MS = "epoch_ms(date_trunc('{u}', created_at AT TIME ZONE 'UTC'))"
_EXTRACT = "q AS (SELECT id, kind, name, list_distinct(list_filter(aliases, lambda a: a <> '')) AS found FROM node WHERE kind IN ('person', 'organization') AND name <> '')"
_OVERLAP = "len(list_filter(found, lambda f: length(f) >= 2 AND length(name) >= 2 AND (contains(f, name) OR contains(name, f)))) > 0"
_RADIUS = "greatest(9.0, least(24.0, 7 + 19 * sqrt(least(CASE WHEN members > 0 THEN members ELSE 3 END, 400) / 400.0)))"
QUERIES = {
    f.__name__: f
    for f in (
        request_date_bounds, assembled_dates, capture_embedding_texts, node_embedding_texts, clipped_texts, norm_variants, parsed_vectors, topic_looks, node_looks, encoded_notes, event_properties, extraction_scores,
        extraction_recall, judged_scores, signals_passed, answered_topics, extracted_graph_sizes,
    )
}


def _tint(light: int) -> str:
    shade = "CASE kind " + " ".join(f"WHEN '{k}' THEN {{{k}}}" for k in KIND_COLOR) + " ELSE {other} END"
    white, dark = min(1, (light - 50) / 55) if light > 50 else 0, light / 50 if light < 50 else 1
    value = lambda c: "'rgb(" + ", ".join(str(int(int(c[i : i + 2], 16) * dark + (255 - int(c[i : i + 2], 16)) * white + 0.5)) for i in (1, 3, 5)) + ")'"
    return shade.format(other=value("#3B82F6"), **{k: value(v) for k, v in KIND_COLOR.items()}) + f" AS tint_{light}"


ORACLES = {
    "request_date_bounds": sql(CAP, query=f"SELECT id, {_DATE.format(a=_MS.format(u='day'), b=_MS.format(u='second'))} AS since_ms, {_DATE.format(a=_MS.format(u='day') + ' + 86399999', b=_MS.format(u='second'))} AS until_ms FROM cap"),
    "assembled_dates": "SELECT doc_id, CASE WHEN t BETWEEN '2021-01-01' AND '2025-12-31' THEN t END AS date FROM (SELECT doc_id, strftime(try_cast((doc_id % 7 + 2020) || '-' || (doc_id % 14) || '-' || (doc_id % 33) AS DATE), '%Y-%m-%d') AS t FROM documents)",
    "capture_embedding_texts": sql(CAP, "t AS (SELECT id, substr(concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(summary), ''), nullif(trim(content), ''), nullif(trim(array_to_string(coalesce(tags, []), ' ')), '')), 1, 8000) AS t FROM cap)", query="SELECT id, md5(t) AS digest, length(t) AS n FROM t"),
    "node_embedding_texts": sql("nn AS (SELECT lower(id) AS id, any_value(name) AS name, any_value(normalized_name) AS norm, coalesce(any_value(kind), 'concept') AS kind, coalesce(any_value(aliases), []) AS aliases FROM knowledge_nodes WHERE id IS NOT NULL GROUP BY 1)",
        "t AS (SELECT id, substr(concat_ws(chr(10), nullif(trim(name), ''), CASE WHEN coalesce(norm, '') <> coalesce(name, '') THEN nullif(trim(norm), '') END, nullif(trim(kind), ''), nullif(trim(array_to_string(aliases, ', ')), '')), 1, 8000) AS t FROM nn)", query="SELECT id, md5(t) AS digest, length(t) AS n FROM t"),
    "clipped_texts": sql(CAP, query="SELECT id, CASE WHEN length(title) > 10 THEN substr(title, 1, 10) || '…' ELSE coalesce(title, '') END AS title, CASE WHEN length(content) > 60 THEN 61 ELSE length(coalesce(content, '')) END::INTEGER AS n FROM cap"),
    "parsed_vectors": sql(NODE, query="SELECT id, CASE WHEN substr(id, 1, 1) < 'c' THEN len(embedding) END::INTEGER AS n, embedding IS NOT NULL AND len(embedding) = 64 AS kept FROM node"),
    "topic_looks": sql(LABEL, "fine(name, number, broad) AS (VALUES " + ", ".join(f"('{f}', {i}, {b})" for i, (f, _, b) in enumerate(topic_rows())) + ")", "m AS (SELECT topic AS name, count(*) AS members FROM label GROUP BY 1)",
        query=f"SELECT name, members, round({_RADIUS}, 6) AS radius, 'hsl(' || printf('%.1f', (broad * 137.50776405003785::DOUBLE) % 360) || ', 65%, ' || (44 + number % 3 * 10) || '%)' AS color FROM m JOIN fine USING (name)"),
    "node_looks": sql(NODE, query="SELECT DISTINCT kind, val, round(greatest(7.0, least(14.0, 4 + sqrt(CASE WHEN val <> 0 THEN val ELSE 6 END) * 1.9)), 6) AS radius, CASE kind WHEN 'person' THEN 18 WHEN 'event' THEN 16 WHEN 'todo' THEN 16 WHEN 'question' THEN 14 WHEN 'conclusion' THEN 14 WHEN 'view' THEN 13 WHEN 'concept' THEN 12 WHEN 'object' THEN 12 WHEN 'location' THEN 11 ELSE 10 END AS size, " + ", ".join(_tint(n) for n in (30, 50, 80)) + " FROM node"),
    "encoded_notes": sql(CAP, query="SELECT id, to_base64(encode(note)) AS base64, true AS same FROM cap WHERE note IS NOT NULL"),
    "event_properties": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "extraction_scores": sql(NODE, _EXTRACT, f"v AS (SELECT kind AS category, {_OVERLAP} AS hit FROM q)", query="SELECT category, count(*) FILTER (WHERE hit) AS passed, 0::BIGINT AS partial, count(*) FILTER (WHERE NOT hit) AS failed FROM v GROUP BY 1"),
    "extraction_recall": sql(NODE, _EXTRACT, f"v AS (SELECT kind = 'person' AS wanted, {_OVERLAP} AS hit, list_contains(found, name) AS same, len(found) AS n FROM q)", query="SELECT round(count(*) FILTER (WHERE wanted AND hit) / count(*) FILTER (WHERE wanted), 6) AS recall, round((sum(n) - count(*) FILTER (WHERE NOT wanted AND same)) / sum(n), 6) AS precision FROM v"),
    "judged_scores": "SELECT round(avg((" + " + ".join(f"greatest(0, least(10, floor(doc_id % {k} * 1.5 - 1 + 0.5)))" for k in (5, 7, 9, 11)) + ") / 4), 6) AS mean_score FROM documents",
    "signals_passed": sql(CAP, query="SELECT count(*) AS n, count(*) FILTER (WHERE len(tags) > 0) AS n_passed, round(count(*) FILTER (WHERE len(tags) > 0) / count(*), 6) AS ratio FROM cap"),
    "norm_variants": sql(NODE, query=r"SELECT id, lower(trim(name)) AS trimmed, regexp_replace(lower(trim(name)), '[\s\x0b]+', ' ', 'g') AS spaced, trim(regexp_replace(translate(lower(trim(coalesce(name, ''))), '，。！？、,.!?;；:" + '"' + r"''“”‘’（）()【】[]{}<>', repeat(' ', 29)), '[\s\p{Z}\x0b\x{85}]+', ' ', 'g')) = lower(trim(name)) AND regexp_replace(lower(trim(name)), '[\s\x0b]+', ' ', 'g') = lower(trim(name)) AS agree FROM node"),
}
