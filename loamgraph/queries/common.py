"""What the registered queries share: the day they look back from, and their tables in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph.functions import text

ASOF_TEXT = "2025-12-31 00:00:00"
DIM = 64


def asof():
    return F.lit(ASOF_TEXT + "+00:00").cast("timestamp")


ASOF = f"TIMESTAMPTZ '{ASOF_TEXT}+00'"
ZERO = "00000000-0000-0000-0000-000000000000"
# the latest state of each capture, each node and each link once, the newest label of a node
CAP = f"""cap AS (SELECT * REPLACE (lower(id) AS id), coalesce(lower(user_id), '{ZERO}') AS scope_id FROM captured_info WHERE id IS NOT NULL QUALIFY
    row_number() OVER (PARTITION BY lower(id) ORDER BY processed_at DESC NULLS LAST, processing_status, embedding_status, graph_status) = 1)"""
NODE = """node AS (SELECT lower(id) AS id, scope_id, any_value(name) AS name, coalesce(any_value(kind), 'concept') AS kind, coalesce(any_value(val), 10) AS val,
    coalesce(any_value(aliases), []) AS aliases, coalesce(any_value(source_captured_ids), []) AS src, any_value(embedding) AS embedding, min(created_at) AS created_at
    FROM knowledge_nodes WHERE id IS NOT NULL GROUP BY lower(id), scope_id)"""
LINK = "link AS (SELECT DISTINCT ON (lower(id)) * REPLACE (lower(id) AS id) FROM knowledge_links WHERE id IS NOT NULL)"
EDGE = """edge AS (SELECT DISTINCT least(lower(source), lower(target)) AS a, greatest(lower(source), lower(target)) AS b FROM knowledge_links
    WHERE lower(source) <> lower(target) AND lower(source) IN (SELECT id FROM node) AND lower(target) IN (SELECT id FROM node)),
adj AS (SELECT a AS src, b AS dst FROM edge UNION ALL SELECT b, a FROM edge)"""
LABEL = "label AS (SELECT lower(cluster_key) AS id, arg_max(name, {'t': created_at, 'n': name}) AS topic FROM topic_labels WHERE cluster_key IS NOT NULL GROUP BY 1)"
BRIDGE = "bridge AS (SELECT DISTINCT id AS node_id, lower(c) AS capture_id FROM (SELECT id, unnest(src) AS c FROM node) WHERE c IS NOT NULL AND c <> '')"


def sql(*ctes: str, query: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + query


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def noise_sql(t: str) -> str:
    """Whether a capture of the alias ``t`` is noise."""
    title, summary, content = (f"coalesce({t}.{c}, '')" for c in ("title", "summary", "content"))
    whole = f"trim(lower({title} || ' ' || {summary} || ' ' || {content}))"
    words = " OR ".join(f"contains({whole}, {_quoted(w)})" for w in text.NOISE_WORDS)
    titles = " OR ".join(f"regexp_matches({title}, {_quoted(p)})" for p in text.NOISE_TITLES)
    facts = _quoted(text.FILE_FACTS)
    rest = rf"length(regexp_replace(regexp_replace({content}, {facts}, ''), '[\s\p{{P}}\p{{N}}A-Za-z]', '', 'g'))"
    body = rf"length(regexp_replace({summary} || ' ' || {content}, '[\s，。、！？；：,.!?;:\"“”‘’（）()\-—…\dA-Za-z]', '', 'g'))"
    return f"({whole} = '' OR {words} OR {titles} OR (regexp_matches({content}, {facts}) AND {rest} <= 10) OR (coalesce(len({t}.tags), 0) = 0 AND {body} > 0 AND {body} <= 10))"


def trivial_sql(name: str) -> str:
    """Whether a node's name says nothing."""
    s = f"trim(coalesce({name}, ''))"
    left = s
    for n in sorted({len(w) for w in text.STOP_WORDS}, reverse=True):
        left = f"regexp_replace({left}, {_quoted('|'.join(w for w in dict.fromkeys(text.STOP_WORDS) if len(w) == n))}, '', 'g')"
    left = f"regexp_replace({left}, {_quoted(PUNCTUATION)}, '', 'g')"
    left = f"regexp_replace({left}, {_quoted('|'.join(text.VAGUE_WORDS))}, '', 'g')"
    left = rf"length(regexp_replace({left}, '[^一-鿿\p{{L}}]', '', 'g'))"
    inside = _quoted("|".join(text.TIME_INSIDE))
    return rf"({s} = '' OR {s} IN ({', '.join(_quoted(w) for w in text.STOP_WORDS + text.VAGUE_WORDS)}) OR regexp_matches({s}, '^[一-鿿]$') OR regexp_matches({s}, '^[\s\p{{P}}`~$^+=<>|]+$') OR regexp_matches({s}, {_quoted('^(?:' + '|'.join(text.TIME_NAMES) + ')$')}) OR regexp_matches({s}, {inside}) OR {left} <= 1)"


PUNCTUATION = r"""[\d.,;:!?，。；：！？、…—\-·'\"“”‘’【】《》（）()\[\]{}<>+\s]+"""
