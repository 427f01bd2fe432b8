"""Session tables derived from the driver's tables, for the registered queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions.text import truncate_title
from sessionlake.model import AGENT_NAMES, configure
from sessionlake.operators.messages import assemble_sessions
from sessionlake.operators.refresh import KEY

#: Sessions take the event of their number times this, so that their times spread over weeks.
SPREAD = 49
AS_OF = dt.datetime(2024, 1, 16)
QUERIES = (
    (1, "thing"),
    (2, "agent:claude,codex the of"),
    (3, "-dir:click retoin"),
    (4, 'agent:!kimi "of the'),
    (5, "date:<5d ion"),
    (6, "agent:Claude,!CoDex"),
    (7, 'dir:"/work/view" date:>1w'),
    (8, "date:yesterday"),
    (9, "-date:<9d gekeit"),
    (10, "purchase"),
    (11, "xagent:claude,pi date:soon thst erst"),
    (12, "date:999999999y dir:signup,error"),
)

#: Searches with quotes, signs and joined clauses.
CLAUSE_QUERIES = (
    (1, '"of the"'),
    (2, "+the -of"),
    (3, 'title:"the of" thing'),
    (4, "thing AND of OR purchase"),
    (5, 'the AND NOT "of the" retoin'),
    (6, '"in the" agent:claude,pi date:<400d'),
    (7, "-the"),
    (8, "content:the-of nofield:thing"),
    (9, '+thing +"in the" -zzz'),
    (10, '"/work/view/u3" "half of'),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def agent_of(conv_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in AGENT_NAMES]), (conv_id % 12 + 1).cast("int"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_messages: turns of users and assistants as messages."""
    configure(spark)
    t = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    user = F.col("role") == "user"
    return t.select(
        agent_of(F.col("conv_id")).alias("agent"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", "text",
        F.lit(None).cast("timestamp").alias("ts"), user.alias("counts_as_turn"), user.alias("title_candidate"), F.lit(False).alias("yolo"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_sessions: assembled conversations with the time and folder of the event of the same number."""
    made = assemble_sessions(messages(spark, sf_dir)).withColumn("conv_id", F.col("session_id").cast("long"))
    e = table(spark, sf_dir, "events").where(F.col("event_id") % SPREAD == 0).select((F.col("event_id") / SPREAD).cast("long").alias("conv_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value")
    both = made.join(e, "conv_id")
    directory = F.when(F.col("conv_id") % 17 == 0, "").otherwise(F.concat(F.lit("/work/"), "event_type", F.lit("/u"), (F.col("user_id") % 10).cast("string")))
    return both.select(
        F.col("session_id").alias("id"), "agent", truncate_title(F.col("first_user"), 100).alias("title"), directory.alias("directory"), F.col("ts").alias("timestamp"),
        "content", "message_count", (F.unix_micros("ts") / 1_000_000).alias("mtime"), (F.col("value") > 20).alias("yolo"),
    )


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_sessions without the wide columns: neither content nor titles are assembled for it."""
    configure(spark)
    t = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    made = t.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("message_count")).where("message_count > 0")
    e = table(spark, sf_dir, "events").where(F.col("event_id") % SPREAD == 0).select((F.col("event_id") / SPREAD).cast("long").alias("conv_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    directory = F.when(F.col("conv_id") % 17 == 0, "").otherwise(F.concat(F.lit("/work/"), "event_type", F.lit("/u"), (F.col("user_id") % 10).cast("string")))
    return made.join(e, "conv_id").select(F.col("conv_id").cast("string").alias("id"), agent_of(F.col("conv_id")).alias("agent"), directory.alias("directory"), F.col("ts").alias("timestamp"), "message_count", (F.unix_micros("ts") / 1_000_000).alias("mtime"))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_known: markers of an earlier scan: some keys missing, some older, some gone."""
    c = F.col("id").cast("long")
    shifted = F.col("mtime") + F.when(c % 10 == 1, 5.0).when(c % 10 == 2, 0.0005).otherwise(0.0)
    own = listed(spark, sf_dir).where(c % 10 != 0).select(*KEY, shifted.alias("mtime"))
    gone = spark.range(5).select(F.when(F.col("id") % 2 == 0, "codex").otherwise("kimi").alias("agent"), F.concat(F.lit("gone-"), F.col("id").cast("string")).alias("id"), F.lit(1.0).alias("mtime"))
    return own.unionByName(gone)


def scan_status(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, a != "kimi", a == "grok") for a in AGENT_NAMES], "agent string, complete boolean, failed boolean")


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUERIES), "query_id int, query string")


def clause_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLAUSE_QUERIES), "query_id int, query string")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_log: a search string from each turn."""
    t = table(spark, sf_dir, "conversations")
    kind, conv = (F.col("conv_id") + F.col("turn")) % 6, F.col("conv_id").cast("string")

    def text(start: int, n: int) -> Column:
        return F.substring("text", start, n)

    made = (
        F.when(kind == 0, F.concat(F.lit("agent:"), "role", F.lit(",!Pi "), text(1, 20)))
        .when(kind == 1, F.concat(F.lit('-dir:"'), text(1, 8), F.lit('" '), text(10, 12)))
        .when(kind == 2, F.concat(F.lit("date:<"), F.col("turn").cast("string"), F.lit("d "), text(1, 10)))
        .when(kind == 3, F.concat(F.lit("xagent:claude,"), "role", F.lit(" date:soon")))
        .when(kind == 4, F.concat(text(1, 30), F.lit(" date:yesterday agent:"), "role"))
        .otherwise(F.concat(F.lit("dir:a dir:"), "role", F.lit(" -date:>"), conv, F.lit("h")))
    )
    return t.select((F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("query_id"), made.alias("query"))


def health_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_health: each conversation as a file's lines, the last torn where conv_id % 5 = 0, the first where it is 1."""
    t = table(spark, sf_dir, "conversations")
    ends = t.groupBy("conv_id").agg(F.max("turn").alias("last"))
    raw = F.to_json(F.struct("role", "text"))
    torn = ((F.col("conv_id") % 5 == 0) & (F.col("turn") == F.col("last"))) | ((F.col("conv_id") % 5 == 1) & (F.col("turn") == 0))
    return t.join(ends, "conv_id").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line_no"), F.when(torn, "{").otherwise(raw).alias("raw"))


def history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_events: each turn as an event of a session's history; `none` where it is no event."""
    t = table(spark, sf_dir, "conversations")
    at, odd = (F.col("turn") + F.col("conv_id")) % 9, F.col("conv_id") % 3
    message = F.when(F.col("role") == "system", "none").otherwise("message")
    after = F.when(F.col("conv_id") % 2 == 0, "tool_result").otherwise("step_end")
    rare = F.when(odd == 0, "undo").when(odd == 1, "clear").otherwise("compaction")
    kind = F.when(at == 1, "step_begin").when(at.isin(2, 8), "part").when(at == 3, "tool_call").when(at == 5, after).when(at == 7, rare).otherwise(message)
    return t.select(F.col("conv_id").cast("string").alias("session_id"), "conv_id", F.col("turn").cast("long").alias("seq"), kind.alias("kind"), "role", "text")


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """v_parts as three landed tables (sessions, messages, parts); times are made from the keys."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "conv_id", "turn", "role", "text", F.concat_ws("-", "conv_id", "turn").alias("message_id"))
    s = t.groupBy("session_id", "conv_id").agg(F.lit(1).alias("one")).select("session_id", (F.col("conv_id") * 1000).alias("time_created"), (F.col("conv_id") * 1000 + 7).alias("time_updated"))
    m = t.select("message_id", "session_id", F.col("turn").alias("seq"), "role", (F.col("conv_id") * 1000 + F.col("turn") * 3).alias("time_created"))
    pieces = t.select("message_id", "session_id", "conv_id", "turn", F.posexplode(F.split("text", r"\. ", -1)).alias("part_seq", "piece"))
    text = pieces.select("message_id", "session_id", "part_seq", F.to_json(F.struct(F.lit("text").alias("type"), F.col("piece").alias("text"))).alias("data"), (F.col("conv_id") * 1000 + F.col("turn") * 2 + F.col("part_seq")).alias("time_updated"))
    tool = t.select("message_id", "session_id", F.lit(-1).alias("part_seq"), F.lit('{"type":"tool"}').alias("data"), F.lit(0).cast("long").alias("time_updated"))
    return s, m, text.unionByName(tool)
