"""Column expressions on dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def day_start(c: Column | str) -> Column:
    """A date of ten characters or a timestamp in text; null where it is none."""
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c)


def day_end(c: Column | str) -> Column:
    """As :func:`day_start`, a bare date as its last millisecond."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) == 10, F.try_to_timestamp(c) + F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND")).otherwise(F.try_to_timestamp(c))


def assembled_date(year: Column, month: Column, day: Column, least: str | None = None, most: str | None = None) -> Column:
    """``yyyy-MM-dd`` of three texts if the calendar has that day and it lies within the bounds; else null."""
    digits = year.rlike(r"^\d{4}$") & month.rlike(r"^\d{1,2}$") & day.rlike(r"^\d{1,2}$")
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    ok = digits & F.try_to_date(text, "yyyy-MM-dd").isNotNull()
    if least:
        ok = ok & (text >= least)
    if most:
        ok = ok & (text <= most)
    return F.when(ok, text)
