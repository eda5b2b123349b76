"""Quality of extraction and answers as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loamgraph.functions.scores import clamp_score, color_distance


def overlaps(a: str, b: str) -> F.Column:
    """Whether either of two names of two characters and more contains the other."""
    return (F.length(a) >= 2) & (F.length(b) >= 2) & (F.contains(F.col(a), F.col(b)) | F.contains(F.col(b), F.col(a)))


def extraction_quality(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``(case_id, n_expected, n_hit, n_found, n_wrong)``.

    expected: ``(case_id, name, wanted)`` with wanted false for names that must not come out; found: ``(case_id, name)``.
    A wanted name is hit by a found one that contains it or is contained; a forbidden one only by itself.
    """
    both = expected.withColumnRenamed("name", "e").join(found.select("case_id", F.col("name").alias("f")), "case_id", "left")
    hit = F.when(F.col("wanted"), overlaps("e", "f")).otherwise(F.col("e") == F.col("f"))
    each = both.groupBy("case_id", "e", "wanted").agg(F.max(F.coalesce(hit, F.lit(False))).alias("hit"))
    n = found.groupBy("case_id").agg(F.countDistinct("name").alias("n_found"))
    out = each.groupBy("case_id").agg(F.count_if("wanted").alias("n_expected"), F.count_if(F.col("wanted") & F.col("hit")).alias("n_hit"), F.count_if(~F.col("wanted") & F.col("hit")).alias("n_wrong"))
    return out.join(n, "case_id", "left").fillna(0, ["n_found"])


def verdicts(cases: DataFrame) -> DataFrame:
    """Cases ``(case_id, n_expected, n_hit, n_wrong)`` counted as passed, partial or failed by the part of the id before the dash."""
    v = F.when((F.col("n_wrong") == 0) & (F.col("n_hit") == F.col("n_expected")), "passed").when(F.col("n_hit") > 0, "partial").otherwise("failed")
    return cases.select(F.split("case_id", "-")[0].alias("category"), v.alias("verdict")).groupBy("category").pivot("verdict", ["passed", "partial", "failed"]).count().fillna(0)


def mean_scores(scores: DataFrame, columns: list[str]) -> DataFrame:
    """The unweighted mean of judged scores, each clamped to 0..10."""
    return scores.agg(F.round(F.avg(sum((clamp_score(c) for c in columns), F.lit(0)) / len(columns)), 6).alias("mean_score"))


def signal_ratio(signals: DataFrame) -> DataFrame:
    """``(n, n_passed, ratio)`` of checks ``(signal, passed)``; null ratio without any."""
    return signals.agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed")).withColumn("ratio", F.round(F.col("n_passed") / F.nullif("n", F.lit(0)), 6))


def recall_precision(quality: DataFrame) -> DataFrame:
    """``(recall, precision)`` over all cases of :func:`extraction_quality`: hits among the expected, and found ones that are not forbidden."""
    total = quality.agg(*[F.sum(c).alias(c) for c in ("n_expected", "n_hit", "n_found", "n_wrong")])
    return total.select(F.round(F.col("n_hit") / F.nullif("n_expected", F.lit(0)), 6).alias("recall"), F.round((F.col("n_found") - F.col("n_wrong")) / F.nullif("n_found", F.lit(0)), 6).alias("precision"))


def color_spread(colors: DataFrame) -> DataFrame:
    """Least and median distance between the colours ``(name, color)`` of a palette, and how many share one."""
    a, b = colors.withColumnsRenamed({"name": "na", "color": "ca"}), colors.withColumnsRenamed({"name": "nb", "color": "cb"})
    pairs = a.join(b, F.col("na") < F.col("nb")).select(color_distance("ca", "cb").alias("d"))
    return pairs.agg(F.round(F.min("d"), 6).alias("least"), F.round(F.percentile("d", 0.5), 6).alias("median"), F.count_if(F.col("d") == 0).alias("n_same"))
