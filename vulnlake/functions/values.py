"""Array, map, JSON, date and string helpers (A*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_MARK = "[未获取"  # fixed value: prefix of an evidence note that says why evidence is missing


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch, for either timestamp type."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def json_or(doc: str | Column, *paths: str, default: str | None = None) -> Column:
    """First non-null of several JSON paths, else the default."""
    found = [F.get_json_object(_c(doc), p) for p in paths]
    return F.coalesce(*found, F.lit(default))


def filled_evidence(evidence: str | Column) -> Column:
    """Evidence entries that hold a value rather than a note about its absence."""
    return F.map_filter(_c(evidence), lambda k, v: (F.length(v) > 0) & ~v.startswith(MISSING_MARK))


def add_once(arr: str | Column, value: str | Column) -> Column:
    v = F.lit(value) if isinstance(value, str) else value
    return F.array_union(F.coalesce(_c(arr), F.array().cast("array<string>")), F.array(v))


def short_list(arr: str | Column, n: int) -> Column:
    """Flatten one level, drop repeats, sort, keep the first n (a display field)."""
    return F.slice(F.sort_array(F.array_distinct(F.flatten(_c(arr)))), 1, n)


def quoted(text: str | Column) -> Column:
    return F.concat(F.lit("'"), F.replace(_c(text), F.lit("'"), F.lit("''")), F.lit("'"))


def older_than(ts: str | Column, now: Column, years: int) -> Column:
    return F.add_months(_c(ts).cast("date"), 12 * years) < now.cast("date")


def iso(ts: str | Column) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage rounded to ``digits``; null when the whole is zero."""
    return F.round(part * 100.0 / F.nullif(whole, F.lit(0)), digits)
