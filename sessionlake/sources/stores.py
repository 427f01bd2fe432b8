"""Landed stores: tables of agents that keep their sessions in a database, and what tells that a session changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.times import epoch_seconds, epoch_ts
from sessionlake.operators.refresh import semi_changed
from sessionlake.sources import agents


def _seconds(unit: str) -> Callable[[Column], Column]:
    return lambda c: epoch_seconds(epoch_ts(c, unit))


@dataclass(frozen=True)
class Store:
    """A store's tables, in the order in which `parse` takes them; the first one says which sessions there are.

    keys: each table's column that names the session; times: columns that
    say when a row was made or changed, where a table has them; seconds: such a
    value as epoch seconds; there: which rows of the first table are sessions;
    torn: ids of sessions that cannot be read as they are, and stay as they were;
    `parse` then takes them as `torn`.
    """

    agent: str
    keys: tuple[str, ...]
    times: tuple[str, ...]
    seconds: Callable[[Column], Column]
    parse: Callable[..., tuple[DataFrame, DataFrame]]
    there: str = "true"
    torn: Callable[..., DataFrame] | None = None

    def listing(self, tables: tuple[DataFrame, ...]) -> DataFrame:
        """(key, mtime, size): every session's latest time over all tables, and how many rows it has in them.

        Reads keys and times alone. Rows without a key belong to no session; a
        session without any time has mtime 0.
        """

        def rows(i: int, table: DataFrame) -> DataFrame:
            at = [self.seconds(F.col(c)) for c in self.times if c in table.columns]
            latest = F.greatest(*at) if len(at) > 1 else at[0] if at else F.lit(None).cast("double")
            own = F.coalesce(F.expr(self.there), F.lit(False)) if i == 0 else F.lit(False)
            return table.select(F.col(self.keys[i]).cast("string").alias("key"), latest.alias("at"), own.alias("own"))

        every = reduce(DataFrame.unionByName, [rows(i, t) for i, t in enumerate(tables)]).where("key is not null")
        found = every.groupBy("key").agg(F.coalesce(F.max("at"), F.lit(0.0)).alias("mtime"), F.count("*").alias("size"), F.bool_or("own").alias("own"))
        return found.where("own").select("key", "mtime", "size")

    def of(self, tables: tuple[DataFrame, ...], changed: DataFrame) -> tuple[DataFrame, ...]:
        """The rows of some sessions (key) in every table."""
        return tuple(semi_changed(t.withColumn("__key", F.col(k).cast("string")), changed.select(F.col("key").alias("__key")), ["__key"]).drop("__key") for t, k in zip(tables, self.keys, strict=True))


STORES: dict[str, Store] = {
    s.agent: s
    for s in (
        Store("crush", ("id", "session_id"), ("created_at", "updated_at"), _seconds("auto"), agents.ingest_crush, "message_count > 0", lambda _, messages: agents.crush_torn(messages)),
        Store("cursor", ("session_id", "session_id"), ("mtime",), lambda c: c.cast("double"), agents.ingest_cursor),
        Store("opencode", ("id", "session_id", "session_id"), ("time_created", "time_updated"), _seconds("ms"), agents.ingest_opencode),
    )
}
