"""Timestamps of source records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2})?$"


def parse_iso(c: Column) -> Column:
    """RFC 3339 with an offset, or a local time with optional fraction; anything else is null."""
    t = F.trim(c)
    return F.when(t.rlike(_ISO), t.try_cast("timestamp"))


def epoch_ts(value: Column, unit: str = "auto") -> Column:
    """Timestamp of a positive epoch number; unit s, ms, or auto (over 1e11 is milliseconds)."""
    n = value.try_cast("double")
    seconds = {"s": n, "ms": n / 1000, "auto": F.when(n > 1e11, n / 1000).otherwise(n)}[unit]
    return F.when(n > 0, F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")))


def any_ts(value: Column) -> Column:
    """An epoch number or an ISO string, whichever the text is."""
    return F.coalesce(epoch_ts(value), parse_iso(value))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch as a double, with microseconds."""
    return F.unix_micros(ts) / 1_000_000
