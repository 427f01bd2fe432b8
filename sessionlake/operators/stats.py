"""Statistics over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.text import display_dir, human_bytes
from sessionlake.model import agent_dim

WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def totals(sessions: DataFrame) -> DataFrame:
    """One row: sessions, messages, average to one decimal, first and last time."""
    return sessions.agg(
        F.count("*").alias("sessions"),
        F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"),
        F.coalesce(F.round(F.avg("message_count"), 1), F.lit(0.0)).alias("avg_messages"),
        F.min("timestamp").alias("oldest"),
        F.max("timestamp").alias("newest"),
    )


def by_agent(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("agent").agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages"), F.sum(F.octet_length("content").cast("long")).alias("content_bytes"))


def top_directories(sessions: DataFrame, n: int = 10, home: str = "/home/user") -> DataFrame:
    grouped = sessions.groupBy(display_dir(F.col("directory"), home).alias("directory")).agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages"))
    return grouped.orderBy(F.desc("sessions"), F.desc("messages"), "directory").limit(n)


def by_weekday(sessions: DataFrame) -> DataFrame:
    """(ord, weekday, sessions) Monday to Sunday, zeros shown."""
    spark = sessions.sparkSession
    days = spark.createDataFrame(list(enumerate(WEEKDAYS)), "ord int, weekday string")
    counted = sessions.groupBy(F.date_format("timestamp", "E").alias("weekday")).agg(F.count("*").alias("n"))
    return days.join(counted, "weekday", "left").select("ord", "weekday", F.coalesce("n", F.lit(0)).alias("sessions"))


def by_hour(sessions: DataFrame) -> DataFrame:
    """(hour, sessions) 0 to 23, zeros shown."""
    hours = sessions.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counted = sessions.groupBy(F.hour("timestamp").alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(counted, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("sessions"))


def peak_hours(sessions: DataFrame, k: int = 3) -> DataFrame:
    return by_hour(sessions).where("sessions > 0").orderBy(F.desc("sessions"), "hour").limit(k)


def scaled(histogram: DataFrame, count: str = "sessions", width: int = 24, levels: int = 7) -> DataFrame:
    """`histogram` (a few rows) with bar (1 to width) and level (0 to levels); both 0 for an empty cell."""
    top = F.max(count).over(Window.partitionBy())
    part = F.col(count) / top
    empty = (F.col(count) == 0) | (top == 0)
    # half up, not half to even
    bar = F.greatest(F.floor(part * width + 0.5), F.lit(1))
    return histogram.select("*", F.when(empty, 0).otherwise(bar).cast("long").alias("bar"), F.when(empty, 0).otherwise(F.ceil(part * levels)).cast("long").alias("level"))


def grouping_sets(sessions: DataFrame) -> DataFrame:
    """All groupings of one scan: (kind, key, sessions, messages, content_bytes) for agent, weekday, hour and all."""
    slim = sessions.select("agent", F.date_format("timestamp", "E").alias("weekday"), F.hour("timestamp").cast("string").alias("hour"), "message_count", F.octet_length("content").cast("long").alias("bytes"))
    sets = [[F.col("agent")], [F.col("weekday")], [F.col("hour")], []]
    grouped = slim.groupingSets(sets, "agent", "weekday", "hour").agg(
        F.grouping_id().alias("gid"), F.count("*").alias("sessions"), F.sum("message_count").alias("messages"), F.sum("bytes").alias("content_bytes")
    )
    kind = F.when(F.col("gid") == 3, "agent").when(F.col("gid") == 5, "weekday").when(F.col("gid") == 6, "hour").otherwise("all")
    return grouped.select(kind.alias("kind"), F.coalesce("agent", "weekday", "hour", F.lit("")).alias("key"), "sessions", "messages", "content_bytes")


def agent_facets(sessions: DataFrame) -> DataFrame:
    """(ord, agent, badge, sessions) in the fixed order, agents without sessions left out."""
    counted = sessions.groupBy("agent").agg(F.count("*").alias("sessions"))
    return counted.join(F.broadcast(agent_dim(sessions.sparkSession)), "agent").select("ord", "agent", "badge", "sessions")


def raw_store_stats(files: DataFrame) -> DataFrame:
    """(agent, available, file_count, total_bytes) of distinct paths of `files` (agent, path, size); agents without files too."""
    counted = files.dropDuplicates(["agent", "path"]).groupBy("agent").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    dim = F.broadcast(agent_dim(files.sparkSession).select("agent"))
    return counted.join(dim, "agent", "right").select("agent", F.col("n").isNotNull().alias("available"), F.coalesce("n", F.lit(0)).alias("file_count"), F.coalesce("b", F.lit(0)).alias("total_bytes"))


def agent_report(stats: DataFrame, raw: DataFrame) -> DataFrame:
    """Agents with sessions or stores, missing figures 0, most sessions first."""
    zero = F.lit(0)
    both = stats.join(raw.where("file_count > 0"), "agent", "full_outer")
    out = both.select("agent", *[F.coalesce(c, zero).alias(c) for c in ("sessions", "messages", "content_bytes", "file_count", "total_bytes")])
    return out.withColumn("content_size", human_bytes(F.col("content_bytes"))).withColumn("raw_size", human_bytes(F.col("total_bytes"))).orderBy(F.desc("sessions"), "agent")


def share(count: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(count / total)
