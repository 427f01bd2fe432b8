"""Keeping the sessions table current: lookups, change detection, plans, the session log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionlake.model import SESSION_COLUMNS, SESSIONS, agent_dim

TOLERANCE = 0.001
KEY = ["agent", "id"]


# -- joins with metadata -------------------------------------------------------


def enrich(sessions: DataFrame, lookup: DataFrame) -> DataFrame:
    """Titles, directories and markers of `lookup` (agent, id, title, directory, mtime) over a session's own; the later marker counts."""
    side = lookup.select(*KEY, F.col("title").alias("__t"), F.col("directory").alias("__d"), F.col("mtime").alias("__m"))
    both = sessions.join(side, KEY, "left")
    return both.withColumns({
        "title": F.coalesce(F.when(F.col("__t").rlike(r"\S"), F.col("__t")), "title"),
        "directory": F.coalesce(F.nullif("__d", F.lit("")), "directory"),
        "mtime": F.greatest("mtime", "__m"),
    }).select(sessions.columns)


def latest_lookup(log: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Last valid entry of each key by line_no; a deleted one removes the key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("line_no"))
    return log.where("valid").withColumn("__n", F.row_number().over(w)).where("__n = 1 and not deleted").drop("__n")


def sessions_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Left join of stored sessions with messages (message_count > 0), one row per session, texts in created order."""
    kept = sessions.where("message_count > 0")
    m = messages.select("session_id", "role", "text", "created_at", "seq")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("created_at", "seq", "text")))), lambda x: x["text"]), "\n\n")
    grouped = m.groupBy("session_id").agg(texts.alias("content"), F.count("*").alias("n_messages"), F.max("created_at").alias("last_message"))
    return kept.join(grouped, "session_id", "left").select(*kept.columns, F.coalesce("content", F.lit("")).alias("content"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"), "last_message")


def sessions_parts(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Sessions, their messages and the messages' text parts: (session_id, n_messages, content), parts by message order, then part order.

    Parts are grouped by message before the join, so each join has one side per key.
    """
    text = parts.where(F.get_json_object("data", "$.type") == "text").select("message_id", "part_seq", F.get_json_object("data", "$.text").alias("text"))
    joined = text.groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    m = messages.join(joined, "message_id", "left")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seq", "message_id", "text")))), lambda x: x["text"]), "\n\n")
    grouped = m.groupBy("session_id").agg(F.count("*").alias("n_messages"), content.alias("content"))
    return sessions.join(grouped, "session_id", "left").select(*sessions.columns, F.coalesce("n_messages", F.lit(0)).alias("n_messages"), F.coalesce("content", F.lit("")).alias("content"))


def activity_marker(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(session_id, marker): latest created or updated time over a session, its messages and parts (epoch ms)."""

    def latest(df: DataFrame, name: str) -> DataFrame:
        have = [c for c in ("time_created", "time_updated") if c in df.columns]
        both = F.greatest(*have) if len(have) > 1 else F.col(have[0])
        return df.groupBy("session_id").agg(F.max(both).alias(name))

    out = latest(sessions, "s").join(latest(messages, "m"), "session_id", "left").join(latest(parts, "p"), "session_id", "left")
    return out.select("session_id", F.greatest("s", "m", "p").alias("marker"))


def with_resume_command(sessions: DataFrame, force: bool = False) -> DataFrame:
    """resume_command: the arguments that continue a session; permission flags if asked for or as the session ran."""
    dim = F.broadcast(agent_dim(sessions.sparkSession).select("agent", "binary", "yolo_flags", "resume_flags", "supports_yolo"))
    none = F.array().cast("array<string>")
    yolo = F.when(F.col("supports_yolo") & (F.lit(force) | F.col("yolo")), F.col("yolo_flags")).otherwise(none)
    usual = F.concat(F.array("binary"), yolo, "resume_flags", F.array("id"))
    with_dir = F.concat(F.array("binary", "directory"), "resume_flags", F.array("id"))
    folder = F.when(F.col("directory") == "", F.array("binary")).otherwise(F.array("binary", "directory"))
    command = F.when(F.col("binary").isNull(), none).when(F.col("agent") == "opencode", with_dir).when(F.col("agent") == "copilot-vscode", folder).otherwise(usual)
    return sessions.join(dim, "agent", "left").select(*sessions.columns, command.alias("resume_command"))


def semi_changed(children: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Children of changed parents only; the planner broadcasts the keys when they are few."""
    return children.join(changed.select(*keys).distinct(), list(keys), "left_semi")


# -- change detection ----------------------------------------------------------


def moved(current: Column, known: Column) -> Column:
    """A marker that is new or differs by more than the tolerance, in either direction."""
    return known.isNull() | (F.abs(current - known) > TOLERANCE)


def detect_changes(current: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of `current` (agent, id, mtime, ...) that `known` (agent, id, mtime) lacks or marks otherwise."""
    side = known.select(*KEY, F.col("mtime").alias("__known"))
    return current.join(side, KEY, "left").where(moved(F.col("mtime"), F.col("__known"))).drop("__known")


def detect_deletes(known: DataFrame, current: DataFrame, scan_status: DataFrame) -> DataFrame:
    """Known keys that a complete scan, which did not fail, no longer finds."""
    sure = scan_status.where("complete and not failed").select("agent")
    return known.select(*KEY).join(current.select(*KEY), KEY, "left_anti").join(sure, "agent", "left_semi").select(*KEY)


def plan_refresh(current: DataFrame, parsed: DataFrame, known: DataFrame, scan_status: DataFrame) -> DataFrame:
    """(agent, id, op, mtime): upsert, delete or keep for every key; unchanged keys are left out.

    `parsed` has parse_outcome (session, delete, retain) of changed keys. A
    failed source gives nothing; an incomplete one no deletes of absent keys.
    """
    c = current.select(*KEY, F.col("mtime").alias("now"))
    k = known.select(*KEY, F.col("mtime").alias("before"))
    both = c.join(k, KEY, "full_outer").join(parsed.select(*KEY, "parse_outcome"), KEY, "left").join(F.broadcast(scan_status), "agent", "left")
    present, changed = F.col("now").isNotNull(), moved(F.col("now"), F.col("before"))
    op = (
        F.when(F.coalesce("failed", F.lit(False)), None)
        .when(~present, F.when(F.coalesce("complete", F.lit(False)), "delete"))
        .when(~changed, None)
        .when(F.col("parse_outcome") == "session", "upsert")
        .when(F.col("parse_outcome") == "delete", F.when(F.col("before").isNotNull(), "delete"))
        .when(F.col("parse_outcome") == "retain", "keep")
    )
    return both.withColumn("op", op).where("op is not null").select(*KEY, "op", F.when(F.col("op") == "upsert", F.col("now")).alias("mtime"))


def gate_outcome(files: DataFrame) -> DataFrame:
    """`files` (health, parsed, usable) with outcome: an invalid file keeps the old row, a partial one too unless usable."""
    outcome = (
        F.when(F.col("health") == "INVALID", "retain")
        .when(F.col("health") == "PARTIAL", F.when(F.col("parsed") & F.col("usable"), "session").otherwise("retain"))
        .otherwise(F.when(F.col("parsed"), "session").otherwise("delete"))
    )
    return files.withColumn("outcome", outcome)


def refresh_summary(plan: DataFrame, known: DataFrame) -> DataFrame:
    """One row: sessions after the plan, changed, deleted."""
    fresh = plan.where("op = 'upsert'").join(known.select(*KEY), KEY, "left_anti").agg(F.count("*").alias("added"))
    counts = plan.agg(F.count_if(F.col("op") == "upsert").alias("new_or_modified"), F.count_if(F.col("op") == "delete").alias("deleted"))
    before = known.agg(F.count("*").alias("before"))
    return counts.crossJoin(before).crossJoin(fresh).select((F.col("before") + F.col("added") - F.col("deleted")).alias("sessions"), "new_or_modified", "deleted")


def fingerprint(sessions: DataFrame) -> DataFrame:
    """(agent, id, fingerprint): a hash of all indexed fields, so that an edit within a second shows."""
    return sessions.select(*KEY, F.xxhash64("title", "directory", F.unix_micros("timestamp"), "content", "message_count", "yolo").alias("fingerprint"))


# -- the session log -----------------------------------------------------------


def dedupe_sessions(sessions: DataFrame) -> DataFrame:
    """One row per key: latest marker, then time, then more content, then a hash of the row.

    A row that is no less in the first three always wins; the order makes the
    rest independent of how rows arrive. Ranks are narrow and pre-aggregated;
    the wide rows meet only the ranks that won. `sessions` is read twice, so it
    should be a table or a scan.
    """
    own = F.xxhash64(*sessions.columns)
    rank = F.struct("mtime", F.unix_micros("timestamp").alias("time"), F.octet_length("content").alias("bytes"), own.alias("own"))
    best = sessions.groupBy(*KEY).agg(F.max(rank).alias("best")).select(*KEY, F.col("best.own").alias("__own"))
    # only copies of one row are left to drop
    return sessions.withColumn("__own", own).join(best, [*KEY, "__own"], "left_semi").drop("__own").dropDuplicates(KEY)


def union_by_precedence(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("agent", "id")) -> DataFrame:
    """Rows of `first`, and those of `second` whose key it lacks; a marker is the later of both."""
    keys = list(keys)
    if "mtime" in first.columns:
        other = second.groupBy(*keys).agg(F.max("mtime").alias("__m"))
        first = first.join(other, keys, "left").withColumn("mtime", F.greatest("mtime", "__m")).select(first.columns)
    return first.unionByName(second.join(first.select(keys), keys, "left_anti").select(first.columns))


def log_rows(sessions: DataFrame, version: int, op: str = "upsert") -> DataFrame:
    """Rows of the session log: sessions to put, or (with op delete) keys to remove."""
    kinds = {f.name: f.dataType for f in StructType.fromDDL(SESSIONS)}
    values = [F.col(c) if c in sessions.columns else F.lit(None).cast(kinds[c]).alias(c) for c in SESSION_COLUMNS if c not in KEY]
    return sessions.select(*KEY, F.lit(version).cast("long").alias("version"), F.lit(op).alias("op"), *values)


def latest_snapshot(log: DataFrame) -> DataFrame:
    """Sessions as of the log's last version of each key; removed keys hidden. A delete beats a put of the same version.

    The last versions are found on narrow columns, in a hash aggregate; wide
    rows meet them by key and version. A version puts a key once.
    """
    rank = F.col("version") * 2 + F.when(F.col("op") == "delete", 1).otherwise(0)
    best = log.groupBy(*KEY).agg(F.max(rank).alias("__rank"))
    puts = log.where("op <> 'delete'").withColumn("__rank", rank)
    return puts.join(best, [*KEY, "__rank"], "left_semi").select(*SESSION_COLUMNS)
