"""Periods, themes, windows and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamgraph.functions.scores import direction_rank
from loamgraph.functions.text import days_ago_text, has_signal, is_noise_capture, is_trivial_name, normalize_name
from loamgraph.operators import records, retrieval, trends
from loamgraph.queries.common import ASOF, CAP, LINK, NODE, asof, noise_sql, sql, trivial_sql
from loamgraph.runtime import table
from loamgraph.sources.tables import captures, links, nodes


def tag_frequency(spark: SparkSession, d: str) -> DataFrame:
    return trends.tag_frequency(captures(spark, d, "tags"))


def tag_frequency_with_blanks(spark: SparkSession, d: str) -> DataFrame:
    return trends.tag_frequency(captures(spark, d, "tags"), blanks=True)


def recent_older_split(spark: SparkSession, d: str) -> DataFrame:
    c = captures(spark, d, "created_at").withColumn("period", trends.period_of("created_at", asof(), 30))
    return c.where(F.col("period").isNotNull()).groupBy("scope_id", "period").agg(F.count("*").alias("n"))


def theme_directions_by_scope(spark: SparkSession, d: str) -> DataFrame:
    return trends.theme_directions(captures(spark, d, "tags", "created_at"), asof(), 30, 30, ["scope_id"])


def theme_quota_pick(spark: SparkSession, d: str) -> DataFrame:
    t = trends.theme_directions(captures(spark, d, "tags", "created_at"), asof(), 30, 30, ["scope_id"])
    return trends.theme_quota(t, ["scope_id"], {"up": 3, "new": 3, "down": 4}).select("scope_id", "name", "direction", "total", "rn")


def period_activity_change(spark: SparkSession, d: str) -> DataFrame:
    return trends.period_changes({"captures": captures(spark, d, "created_at"), "nodes": nodes(spark, d, "created_at"), "links": links(spark, d)}, asof(), 30)


def weekly_timeline_top_tags(spark: SparkSession, d: str) -> DataFrame:
    return trends.weekly_timeline(captures(spark, d, "tags", "created_at"), asof())


def kind_facets_with_total(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "kind").rollup("kind").agg(F.count("*").alias("n"), F.grouping("kind").alias("g"))
    return n.select(F.when(F.col("g") == 1, "all").otherwise(F.col("kind")).alias("kind"), "n")


def hub_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The five nodes that most captures are named for, among those whose name says something."""
    n = nodes(spark, d, "name", "source_captured_ids").select("id", "name", F.size("source_captured_ids").alias("n_sources"))
    return n.where((F.col("n_sources") > 0) & ~is_trivial_name("name")).orderBy(F.col("n_sources").desc(), "id").limit(5)


def theme_order(spark: SparkSession, d: str) -> DataFrame:
    """The themes of the last month with their place: rising, new, falling, steady, then by uses."""
    t = trends.theme_directions(captures(spark, d, "tags", "created_at"), asof(), 30, 30)
    w = records.Window.orderBy(direction_rank("direction"), F.col("total").desc(), "name")
    return t.withColumn("place", F.row_number().over(w)).select("name", "direction", "total", "place")


def kind_month_cube(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by kind and month with all sub-totals, and about how many names each has."""
    n = nodes(spark, d, "kind", "name", "created_at").withColumn("month", F.date_format("created_at", "yyyy-MM"))
    return n.cube("kind", "month").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"), F.grouping_id().cast("int").alias("level"))


def signal_gate(spark: SparkSession, d: str) -> DataFrame:
    return captures(spark, d, "content", "summary", "tags").groupBy("scope_id").agg(F.count_if(has_signal("content", "summary", "tags")).alias("n_signal"), F.count("*").alias("n"))


def high_water_mark(spark: SparkSession, d: str) -> DataFrame:
    return captures(spark, d, "created_at").groupBy("scope_id").agg(F.unix_millis(F.max("created_at")).alias("watermark_ms"))


def days_ago(spark: SparkSession, d: str) -> DataFrame:
    return captures(spark, d, "created_at").groupBy(days_ago_text("created_at", asof()).alias("ago")).agg(F.count("*").alias("n"))


def fixed_window_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    e = trends.fixed_windows(table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), ["user_id"], "ts", 6 * 3600, 2)
    return e.select("event_id", "user_id", "window_start", "nth", "allowed")


def nearest_rank_quantile(spark: SparkSession, d: str) -> DataFrame:
    return trends.nearest_rank(nodes(spark, d, "kind", "val"), ["kind"], "val", 0.85)


def sliding_week_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts")).groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return e.select(F.unix_seconds("w.start").alias("start_s"), "n")


def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d, "name").select("id", normalize_name("name").alias("norm"))


def noise_flags(spark: SparkSession, d: str) -> DataFrame:
    return captures(spark, d, "title", "summary", "content", "tags").select("id", is_noise_capture("title", "summary", "content", "tags").alias("noise"))


def trivial_node_names(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d, "name").select("id", "name").where(is_trivial_name("name"))


_ASKED = [("sleep", "sleep debt and night waking"), ("memo", "间隔重复 记忆"), ("plan", "Plan 计划 budget-sheet"), ("none", "qqqqq zzzzz")]


def bm25_corpus_score(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame(_ASKED, "query string, q_text string")
    s = retrieval.bm25(table(spark, d, "documents").select("doc_id", "text"), q)
    return s.select("query", F.round("score", 4).alias("score"))


def bm25_top_documents(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame(_ASKED, "query string, q_text string")
    s = retrieval.bm25(table(spark, d, "documents").select("doc_id", "text"), q, per_document=True)
    s = s.withColumn("score", F.round("score", 6))
    w = records.Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
    return s.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 10).select("query", "doc_id", "score", "rn")


_TAG = "tag AS (SELECT id, scope_id, created_at, t FROM (SELECT id, scope_id, created_at, unnest(tags) AS t FROM cap) WHERE t IS NOT NULL)"
_WINDOWS = f"""w AS (SELECT scope_id, t AS name, count(*) FILTER (WHERE created_at >= {ASOF} - INTERVAL 30 DAY AND created_at < {ASOF}) AS recent,
    count(*) FILTER (WHERE created_at < {ASOF} - INTERVAL 30 DAY AND created_at >= {ASOF} - INTERVAL 60 DAY) AS older FROM tag WHERE trim(t) <> '' GROUP BY ALL),
dirs AS (SELECT scope_id, name, recent, older, recent + older AS total, CASE WHEN older = 0 AND recent > 0 THEN 'new' WHEN recent = 0 AND older > 0 THEN 'down' WHEN recent >= older + 1 AND recent * 2 >= older * 3 THEN 'up'
    WHEN older >= recent + 1 AND older * 2 >= recent * 3 THEN 'down' ELSE 'stable' END AS direction FROM w WHERE recent + older >= 2)"""
_PERIOD = "SELECT '{m}' AS measure, count(*) FILTER (WHERE created_at >= " + ASOF + " - INTERVAL 30 DAY AND created_at < " + ASOF + ") AS now, count(*) FILTER (WHERE created_at < " + ASOF + " - INTERVAL 30 DAY AND created_at >= " + ASOF + " - INTERVAL 60 DAY) AS before FROM {t}"
_HAN = "list_filter(string_split(regexp_replace(coalesce({c}, ''), '[^一-鿿]', '', 'g'), ''), lambda x: x <> '')"
_TERMS = (
    "list_concat(list_concat({h}, list_transform(range(1, greatest(len({h}), 1)), lambda i: ({h})[i] || ({h})[i + 1])), regexp_extract_all(lower(coalesce({c}, '')), '[a-z][a-z0-9-]+'))"
)


def _terms(c: str) -> str:
    return _TERMS.format(h=_HAN.format(c=c), c=c)


_BM25 = (
    "WITH doc AS (SELECT doc_id, " + _terms("text") + " AS w FROM documents), asked AS (SELECT DISTINCT query, unnest(w) AS term FROM (SELECT query, " + _terms("q_text") + " AS w FROM (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in _ASKED)
    + """) t(query, q_text))), size AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM doc),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM doc) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score FROM tf JOIN df USING (term) JOIN asked USING (term), size GROUP BY query, doc_id)
"""
)

QUERIES = {
    f.__name__: f
    for f in (
        tag_frequency, tag_frequency_with_blanks, recent_older_split, theme_directions_by_scope, theme_quota_pick, period_activity_change, weekly_timeline_top_tags, kind_facets_with_total, high_water_mark, days_ago,
        fixed_window_rate_limit, nearest_rank_quantile, sliding_week_counts, normalize_names, noise_flags, trivial_node_names, bm25_corpus_score, bm25_top_documents,
        hub_nodes, theme_order, kind_month_cube, signal_gate,
    )
}
ORACLES = {
    "tag_frequency": sql(CAP, _TAG, query="SELECT t AS tag, count(*) AS n FROM tag WHERE trim(t) <> '' GROUP BY 1"),
    "tag_frequency_with_blanks": sql(CAP, _TAG, query="SELECT t AS tag, count(*) AS n FROM tag GROUP BY 1"),
    "recent_older_split": sql(CAP, query=f"SELECT scope_id, CASE WHEN created_at >= {ASOF} - INTERVAL 30 DAY THEN 'recent' ELSE 'older' END AS period, count(*) AS n FROM cap WHERE created_at < {ASOF} GROUP BY 1, 2"),
    "theme_directions_by_scope": sql(CAP, _TAG, _WINDOWS, query="SELECT * FROM dirs"),
    "theme_quota_pick": sql(CAP, _TAG, _WINDOWS, query="SELECT scope_id, name, direction, total, rn FROM (SELECT *, row_number() OVER (PARTITION BY scope_id, direction ORDER BY total DESC, name) AS rn FROM dirs) WHERE rn <= CASE direction WHEN 'up' THEN 3 WHEN 'new' THEN 3 WHEN 'down' THEN 4 ELSE 0 END"),
    "period_activity_change": sql(CAP, NODE, LINK, "p AS (" + " UNION ALL ".join(_PERIOD.format(m=m, t=t) for m, t in (("captures", "cap"), ("nodes", "node"), ("links", "link"))) + ")", "c AS (SELECT *, CASE WHEN before > 0 THEN floor((now - before) * 100.0 / before + 0.5)::BIGINT END AS percent FROM p)", query="SELECT *, CASE WHEN percent >= 30 THEN 'up' WHEN percent <= -30 THEN 'down' WHEN percent IS NOT NULL THEN 'stable' WHEN now > 0 THEN 'new' END AS change FROM c"),
    "weekly_timeline_top_tags": sql(CAP, f"x AS (SELECT *, CAST(floor((epoch_ms({ASOF}) - 1 - epoch_ms(created_at)) / 604800000.0) AS INTEGER) AS week FROM cap)", "n AS (SELECT week, count(*) AS n FROM x WHERE week BETWEEN 0 AND 3 GROUP BY week)",
        "g AS (SELECT week, t, count(*) AS n FROM (SELECT week, unnest(tags) AS t FROM x WHERE week BETWEEN 0 AND 3) WHERE t IS NOT NULL AND trim(t) <> '' GROUP BY week, t)",
        "f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY week ORDER BY n DESC, t) <= 3)",
        query="SELECT n.week, n.n, coalesce(string_agg(f.t || '(' || f.n || ')', ', ' ORDER BY f.n DESC, f.t), '') AS top_tags FROM n LEFT JOIN f ON f.week = n.week GROUP BY n.week, n.n"),
    "kind_facets_with_total": sql(NODE, query="SELECT CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, count(*) AS n FROM node GROUP BY ROLLUP (kind)"),
    "high_water_mark": sql(CAP, query="SELECT scope_id, epoch_ms(max(created_at)) AS watermark_ms FROM cap GROUP BY 1"),
    "days_ago": sql(CAP, f"d AS (SELECT greatest(floor((epoch_ms({ASOF}) - epoch_ms(created_at)) / 86400000.0 + 0.5), 0)::BIGINT AS d FROM cap)", query="SELECT CASE WHEN d IS NULL THEN '' WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' ELSE d || ' days ago' END AS ago, count(*) AS n FROM d GROUP BY 1"),
    "fixed_window_rate_limit": "SELECT event_id, user_id, window_start, nth, nth <= 2 AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) AS nth FROM (SELECT event_id, user_id, ts, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS window_start FROM events))",
    "nearest_rank_quantile": sql(NODE, query="SELECT kind, list_sort(list(val))[CAST(floor((count(val) - 1) * 0.85) AS BIGINT) + 1] AS quantile FROM node GROUP BY kind"),
    "sliding_week_counts": "SELECT start_s, count(*) AS n FROM (SELECT unnest(range(day - 6 * 86400, day + 1, 86400)) AS start_s FROM (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS day FROM events)) GROUP BY 1",
    "normalize_names": sql(NODE, query=r"SELECT id, trim(regexp_replace(translate(lower(trim(name)), '，。！？、,.!?;；:\"''“”‘’（）()【】[]{}<>', repeat(' ', 29)), '[\s\p{Z}\x0b\x{85}]+', ' ', 'g')) AS norm FROM node".replace('\\"', '"')),
    "noise_flags": sql(CAP, query=f"SELECT id, {noise_sql('cap')} AS noise FROM cap"),
    "trivial_node_names": sql(NODE, query=f"SELECT id, name FROM node WHERE {trivial_sql('name')}"),
    "hub_nodes": sql(NODE, query=f"SELECT id, name, len(src)::INTEGER AS n_sources FROM node WHERE len(src) > 0 AND NOT {trivial_sql('name')} ORDER BY len(src) DESC, id LIMIT 5"),
    "theme_order": sql(CAP, _TAG, _WINDOWS.replace("scope_id, t AS name", "t AS name").replace("SELECT scope_id, name", "SELECT name"), query="SELECT name, direction, total, row_number() OVER (ORDER BY CASE direction WHEN 'up' THEN 0 WHEN 'new' THEN 1 WHEN 'down' THEN 2 ELSE 3 END, total DESC, name) AS place FROM dirs"),
    "kind_month_cube": sql(NODE, query="SELECT kind, strftime(created_at, '%Y-%m') AS month, count(*) AS n, count(DISTINCT name) AS n_names, grouping_id(kind, strftime(created_at, '%Y-%m'))::INTEGER AS level FROM node GROUP BY CUBE (kind, strftime(created_at, '%Y-%m'))"),
    "signal_gate": sql(CAP, query="SELECT scope_id, count(*) FILTER (WHERE coalesce(len(tags), 0) > 0 OR greatest(length(coalesce(content, '')), length(coalesce(summary, ''))) >= 24) AS n_signal, count(*) AS n FROM cap GROUP BY 1"),
    "bm25_corpus_score": _BM25 + "SELECT query, round(sum(score), 4) AS score FROM s GROUP BY query",
    "bm25_top_documents": _BM25 + "SELECT query, doc_id, score, rn FROM (SELECT query, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc_id) AS rn FROM s) WHERE rn <= 10",
}
