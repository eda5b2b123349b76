"""Column expressions on vectors, counts and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loamgraph.schemas import KIND_COLOR, KIND_PRIORITY, KIND_SIZE


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays in double precision; 0 for other lengths or a zero vector, null for null."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def valid_vector(c: str, dim: int) -> Column:
    """Whether a column holds ``dim`` numbers that are not all zero."""
    return (F.size(c) == dim) & F.exists(c, lambda x: x != 0)


def parse_vector(c: Column | str) -> Column:
    """A vector written as JSON; null where it is none."""
    return F.from_json(F.col(c) if isinstance(c, str) else c, "array<float>")


def tier(similarity: Column | str) -> Column:
    s = F.col(similarity) if isinstance(similarity, str) else similarity
    return F.when(s >= 0.8, "high").when(s >= 0.5, "medium").otherwise("low")


def direction(recent: Column | str, older: Column | str, min_recent: int = 0) -> Column:
    """new, up, down or stable: half as much again and at least one more make a change."""
    r, o = (F.col(c) if isinstance(c, str) else c for c in (recent, older))
    return (
        F.when((o == 0) & (r > 0), "new")
        .when((r == 0) & (o > 0), "down")
        .when((r >= min_recent) & (r >= o + 1) & (r * 2 >= o * 3), "up")
        .when((o >= r + 1) & (o * 2 >= r * 3), "down")
        .otherwise("stable")
    )


def direction_rank(d: Column | str) -> Column:
    d = F.col(d) if isinstance(d, str) else d
    return F.when(d == "up", 0).when(d == "new", 1).when(d == "down", 2).otherwise(3)


def percent_change(now: Column | str, before: Column | str) -> Column:
    """Rounded percentage, halves up; null where there was nothing before."""
    n, b = (F.col(c) if isinstance(c, str) else c for c in (now, before))
    return F.when(b > 0, F.floor((n - b) * F.lit(100.0) / F.nullif(b, F.lit(0)) + 0.5).cast("long"))


def change_word(percent: Column, now: Column) -> Column:
    return F.when(percent >= 30, "up").when(percent <= -30, "down").when(percent.isNotNull(), "stable").when(now > 0, "new")


def evolution(n: Column | str, recent: Column | str, older: Column | str) -> Column:
    """growing where recent members are 60 % and more, shrinking where there are none and at least two older ones."""
    n, r, o = (F.col(c) if isinstance(c, str) else c for c in (n, recent, older))
    return F.when((n > 0) & (r >= 1) & (r * 10 >= n * 6), "growing").when((r == 0) & (o >= 2), "shrinking").otherwise("stable")


def _lookup(kind: Column | str, values: dict, default) -> Column:
    kind, out = F.col(kind) if isinstance(kind, str) else kind, F.lit(default)
    for k, v in values.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def kind_priority(kind: Column | str) -> Column:
    return _lookup(kind, KIND_PRIORITY, 0)


def kind_size(kind: Column | str) -> Column:
    return _lookup(kind, KIND_SIZE, 10)


def kind_color(kind: Column | str) -> Column:
    return _lookup(kind, KIND_COLOR, "#3B82F6")


def keyword_signal(bm25: Column | str) -> Column:
    return F.least(F.lit(1.0), (F.col(bm25) if isinstance(bm25, str) else bm25) / 50.0)


def candidate_score(semantic: Column, keyword: Column, graph: Column, base: Column) -> Column:
    return 0.4 * semantic + 0.3 * keyword + 0.3 * graph + 0.3 * base


def clamp_score(c: Column | str) -> Column:
    """Rounded to whole points from 0 to 10."""
    return F.greatest(F.lit(0), F.least(F.lit(10), F.floor((F.col(c) if isinstance(c, str) else c) + 0.5)))


def hue(number: Column | str) -> Column:
    """A hue for the n-th topic: multiples of the golden angle."""
    return F.pmod((F.col(number) if isinstance(number, str) else number) * 137.50776405003785, F.lit(360.0))


def hex_channels(color: Column | str) -> Column:
    """Red, green and blue of '#RRGGBB'."""
    c = F.col(color) if isinstance(color, str) else color
    return F.array(*[F.conv(F.substring(c, i, 2), 16, 10).cast("int") for i in (2, 4, 6)])


def color_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(hex_channels(a), hex_channels(b), lambda x, y: ((x - y) * (x - y)).cast("double")), F.lit(0.0), lambda s, v: s + v))


def topic_radius(members: Column | str) -> Column:
    """Radius of a topic on screen by its members, 9 to 24; unknown and no members count as three."""
    m = F.col(members) if isinstance(members, str) else members
    m = F.when(m > 0, m).otherwise(3)
    return F.greatest(F.lit(9.0), F.least(F.lit(24.0), 7 + 19 * F.sqrt(F.least(m, F.lit(400)) / F.lit(400.0))))


def member_radius(val: Column | str) -> Column:
    """Radius of a node on screen by its weight, 7 to 14; no weight counts as six."""
    v = F.col(val) if isinstance(val, str) else val
    v = F.when(v != 0, v).otherwise(6)
    return F.greatest(F.lit(7.0), F.least(F.lit(14.0), 4 + F.sqrt(v) * 1.9))


def topic_color(number: Column | str, broad: Column | str) -> Column:
    """Colour of the n-th fine topic of a broad one: the broad topic's hue, lightness in three steps."""
    n = F.col(number) if isinstance(number, str) else number
    return F.concat(F.lit("hsl("), F.format_string("%.1f", hue(broad)), F.lit(", 65%, "), (44 + F.abs(n % 3) * 10).cast("string"), F.lit("%)"))


def tinted(color: Column | str, lightness: Column | int) -> Column:
    """'#RRGGBB' drawn towards white above a lightness of 50 and towards black below it, as 'rgb(r, g, b)'."""
    light = F.lit(lightness) if isinstance(lightness, int) else lightness
    white = F.when(light > 50, F.least(F.lit(1.0), (light - 50) / F.lit(55.0))).otherwise(0.0)
    dark = F.when(light < 50, F.greatest(F.lit(0.0), light / F.lit(50.0))).otherwise(1.0)
    channels = F.transform(hex_channels(color), lambda c: F.floor(c * dark + (255 - c) * white + 0.5).cast("int"))
    return F.concat(F.lit("rgb("), F.array_join(F.transform(channels, lambda c: c.cast("string")), ", "), F.lit(")"))


def resized_vector(c: Column | str, dim: int) -> Column:
    """The vector where it has the length; a column that is given another length drops the values it has."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.size(c) == dim, c)
