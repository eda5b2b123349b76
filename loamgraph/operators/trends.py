"""Counts over periods and what changed between them. Times are relative to ``asof``, never to the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loamgraph.functions.scores import change_word, direction, direction_rank, percent_change

_DAY = 86_400_000


def tag_rows(captures: DataFrame, *keep: str, blanks: bool = False) -> DataFrame:
    """A row for each tag of a capture; blank ones only where asked, null ones never."""
    rows = captures.select(*keep, F.explode("tags").alias("tag")).where(F.col("tag").isNotNull())
    return rows if blanks else rows.where(F.trim("tag") != "")


def tag_frequency(captures: DataFrame, by: list[str] | None = None, blanks: bool = False) -> DataFrame:
    by = by or []
    return tag_rows(captures, *by, blanks=blanks).groupBy(*by, "tag").agg(F.count("*").alias("n"))


def age_days(at: str, asof: Column) -> Column:
    return (F.unix_millis(asof) - F.unix_millis(at)) / F.lit(float(_DAY))


def period_of(at: str, asof: Column, days: int, before_days: int | None = None) -> Column:
    """'recent' from ``days`` before asof on, 'older' before that (as far back as ``before_days``); null for null and what is out of both."""
    since = F.unix_millis(asof) - days * _DAY
    t = F.unix_millis(at)
    older = t < since if before_days is None else (t < since) & (t >= since - before_days * _DAY)
    return F.when((t >= since) & (t < F.unix_millis(asof)), "recent").when(older, "older")


def theme_directions(captures: DataFrame, asof: Column, days: int = 7, before_days: int | None = 7, by: list[str] | None = None, min_total: int = 2) -> DataFrame:
    """``(by, name, recent, older, total, direction)`` of each tag: its uses in the recent and the older window, in one aggregation."""
    by = by or []
    rows = captures.withColumn("period", period_of("created_at", asof, days, before_days)).where(F.col("period").isNotNull())
    counted = tag_rows(rows, *by, "period").groupBy(*by, F.col("tag").alias("name")).agg(F.count_if(F.col("period") == "recent").alias("recent"), F.count_if(F.col("period") == "older").alias("older"))
    out = counted.withColumn("total", F.col("recent") + F.col("older")).where(F.col("total") >= min_total)
    return out.withColumn("direction", direction("recent", "older"))


def theme_quota(directions: DataFrame, by: list[str], quota: dict[str, int]) -> DataFrame:
    """The themes with the most uses of each direction, as many as its quota."""
    w = Window.partitionBy(*by, "direction").orderBy(F.col("total").desc(), "name")
    most = F.coalesce(*[F.when(F.col("direction") == d, n) for d, n in quota.items()], F.lit(0))
    return directions.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def ordered(directions: DataFrame) -> DataFrame:
    return directions.orderBy(direction_rank("direction"), F.col("total").desc(), "name")


def period_changes(tables: dict[str, DataFrame], asof: Column, days: int = 7) -> DataFrame:
    """``(measure, now, before, percent, change)``: rows of each table in the last ``days`` and in as many before."""
    parts = []
    for name, df in tables.items():
        p = period_of("created_at", asof, days, days)
        parts.append(df.agg(F.count_if(p == "recent").alias("now"), F.count_if(p == "older").alias("before")).select(F.lit(name).alias("measure"), "now", "before"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("percent", percent_change("now", "before"))
    return out.withColumn("change", change_word(F.col("percent"), F.col("now")))


def weekly_timeline(captures: DataFrame, asof: Column, weeks: int = 4, top: int = 3) -> DataFrame:
    """``(week, n, top_tags)`` of the last weeks, 0 the latest; top_tags as 'tag(n)' in order, '' without any."""
    week = F.floor((F.unix_millis(asof) - 1 - F.unix_millis("created_at")) / F.lit(7.0 * _DAY)).cast("int")
    rows = captures.withColumn("week", week).where((F.col("week") >= 0) & (F.col("week") < weeks))
    sizes = rows.groupBy("week").agg(F.count("*").alias("n"))
    w = Window.partitionBy("week").orderBy(F.col("n").desc(), "tag")
    best = tag_frequency(rows, ["week"]).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
    text = F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat("tag", F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("t")))), lambda x: x["t"]))
    return sizes.join(best.groupBy("week").agg(text.alias("top_tags")), "week", "left").select("week", "n", F.coalesce("top_tags", F.lit("")).alias("top_tags"))


def fixed_windows(events: DataFrame, key: list[str], at: str, seconds: int, limit: int) -> DataFrame:
    """Each event with its window (a multiple of the length since the epoch), its number in it, and whether the limit allows it."""
    start = F.floor(F.unix_seconds(at) / F.lit(seconds)) * seconds
    w = Window.partitionBy(*key, "window_start").orderBy(at, "event_id")
    return events.withColumn("window_start", start.cast("long")).withColumn("nth", F.row_number().over(w)).withColumn("allowed", F.col("nth") <= limit)


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """``(by, quantile)``: the value at place ``floor((n - 1) * q)`` of the sorted ones; nulls do not count.

    Values are ranked by a window, so a group of any size is sorted outside memory.
    """
    rows = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(*by)
    ranked = rows.withColumn("rn", F.row_number().over(w.orderBy(value))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("rn") == F.floor((F.col("n") - 1) * F.lit(q)) + 1).select(*by, F.col(value).alias("quantile"))
