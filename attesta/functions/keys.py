"""Canonical document numbers, blanks and times as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CANONICAL = "R1-[0-9]{4}-[0-9]{4,}"


def is_blank(c: Column) -> Column:
    """Null, empty or only spaces; never null itself."""
    return F.coalesce(F.trim(c) == "", F.lit(True))


def canonical_no(c: Column) -> Column:
    """The number `R1-<year>-<serial>` in upper case without what stands around it, else null."""
    return F.nullif(F.regexp_extract(F.upper(c), CANONICAL, 0), F.lit(""))


def key_of(c: Column) -> Column:
    """The canonical number; a value that isn't blank and holds none stays as it is, trimmed and in upper case. Blanks give null."""
    return F.coalesce(canonical_no(c), F.nullif(F.upper(F.trim(c)), F.lit("")))


def utc_month(ts: Column) -> Column:
    """YYYY-MM of an instant in UTC, whatever time zone the session has."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM")


def instant_text(c: Column) -> Column:
    """ISO 8601 text as microseconds since the epoch, as text; without an offset it is UTC. What can't be read stays as it is, trimmed; blanks give ''."""
    t = F.trim(c)
    zoned = F.when(t.rlike(r"(?i)(Z|[+-][0-9]{2}(:?[0-9]{2})?)$") & t.contains(":"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.coalesce(F.unix_micros(zoned.try_cast("timestamp")).cast("string"), t, F.lit(""))
