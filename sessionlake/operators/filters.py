"""Predicates over sessions. Each is a Column, so that plain comparisons reach the scan."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_RELATIVE = re.compile(r"([<>])?(\d+)(m|h|d|w|mo|y)")
UNIT_SECONDS = {"m": 60, "h": 3600, "d": 86400, "w": 7 * 86400, "mo": 30 * 86400, "y": 365 * 86400}
#: A longer span lies before every timestamp, and is no filter.
_MOST_SECONDS = 60_000_000_000


def agent_filter(include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column | None:
    """Membership; excluded agents never match; no values, no filter."""
    parts = []
    if include:
        parts.append(F.col("agent").isin([a.lower() for a in include]))
    if exclude:
        parts.append(~F.col("agent").isin([a.lower() for a in exclude]))
    return all_of(*parts)


def dir_filter(include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column | None:
    """Case-insensitive literal substring: any of `include` and none of `exclude`."""
    low = F.lower("directory")
    parts = []
    if include:
        parts.append(reduce(lambda a, b: a | b, [F.contains(low, F.lit(v.lower())) for v in include]))
    parts += [~F.contains(low, F.lit(v.lower())) for v in exclude]
    return all_of(*parts)


def date_filter(value: str, as_of: dt.datetime, negated: bool = False) -> Column | None:
    """today, yesterday, week, month, or [<>]<number><unit>; null for anything else or an overflow.

    today has no upper end; yesterday is the civil day in the session's time
    zone; <n is not older than n (also without a sign), >n is older.
    """
    if value.startswith("!"):
        value, negated = value[1:], True
    word, ts = value.strip().lower(), F.col("timestamp")
    now = F.lit(as_of).cast("timestamp")
    midnight = F.to_date(now).cast("timestamp")
    found: Column
    if word == "today":
        found = ts >= midnight
    elif word == "yesterday":
        found = (ts >= F.date_sub(F.to_date(now), 1).cast("timestamp")) & (ts < midnight)
    elif word in ("week", "month"):
        found = ts >= now - F.make_dt_interval(F.lit(7 if word == "week" else 30))
    elif (m := _RELATIVE.fullmatch(word)) and (seconds := int(m[2]) * UNIT_SECONDS[m[3]]) <= _MOST_SECONDS:
        cutoff = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)).cast("decimal(18,6)"))
        found = ts < cutoff if m[1] == ">" else ts >= cutoff
    else:
        return None
    return ~found if negated else found


def stats_filter(agent: str | None = None, directory: str | None = None) -> Column | None:
    """Agent equality and case-sensitive substring of the directory."""
    return all_of(F.col("agent") == agent if agent else None, F.contains("directory", F.lit(directory)) if directory else None)


def all_of(*parts: Column | None) -> Column | None:
    """Conjunction of the filters that there are; None if there is none."""
    some = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, some) if some else None


def apply(df, *parts: Column | None):
    found = all_of(*parts)
    return df if found is None else df.where(found)


def filter_matches(value: Column, include: Column, exclude: Column, substring: bool = False) -> Column:
    """For filters that are array columns: no exclude matches, and an include does or there is none."""

    def one(needle: Column) -> Column:
        return F.contains(F.lower(value), F.lower(needle)) if substring else value == needle

    return ~F.exists(exclude, one) & ((F.size(include) == 0) | F.exists(include, one))


def query_validity(value: Column, keyword: Column, agents: Sequence[str]) -> Column:
    """Whether each comma value of a typed filter is one the search knows; any directory is."""
    pieces = F.filter(F.transform(F.split(value, ","), lambda v: F.trim(F.regexp_replace(F.trim(v), "^!", ""))), lambda v: v != "")
    known = F.forall(pieces, lambda v: F.lower(v).isin(list(agents)))
    dated = F.forall(pieces, lambda v: F.lower(v).isin("today", "yesterday", "week", "month") | F.lower(v).rlike(r"^[<>]?\d+(m|h|d|w|mo|y)$"))
    return (F.size(pieces) > 0) & F.when(keyword == "agent", known).when(keyword == "date", dated).otherwise(F.lit(True))
