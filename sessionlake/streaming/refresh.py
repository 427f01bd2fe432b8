"""Streaming refresh: landed files to the session log, one committed batch at a time.

Each micro-batch is parsed, gated by file health, planned against the snapshot
and committed (streaming.commits); a retry of one that was committed does
nothing. The file source reads a path once, so sources land new versions of a
file under new folders; deletes come from listing jobs only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionlake.model import SESSION_COLUMNS, configure
from sessionlake.operators.refresh import KEY, gate_outcome, latest_snapshot, log_rows
from sessionlake.sources.scan import FILES, file_health, is_table, source_path
from sessionlake.sources.scratch import scratch
from sessionlake.streaming import commits
from sessionlake.streaming.commits import commit, commit_batch, compact, current, has_committed, read_committed, read_part, switch, vacuum  # noqa: F401

BATCH_FILES = 500
EVERY = "1 second"
#: Batches after which the log is compacted.
COMPACT_EVERY = 10_000
#: Keys that are broadcast to look them up in the log; more are joined as the planner likes.
FEW_KEYS = 10_000

#: files (path, mtime, size, value) -> sessions, their id being the file's session_id
Parser = Callable[[DataFrame], DataFrame]


def read_log(spark: SparkSession, out: str) -> DataFrame:
    """The session log of committed batches; empty before the first."""
    return read_committed(spark, current(spark, out), "log")


def read_snapshot(spark: SparkSession, out: str, keys: DataFrame | None = None, few: bool = True) -> DataFrame:
    """Current sessions; of `keys` (agent, id) alone if they are given; `few`: they are broadcast."""
    log = read_log(spark, out)
    if keys is not None:
        keys = keys.select(*KEY)
        log = log.join(F.broadcast(keys) if few else keys, KEY, "left_semi")
    return latest_snapshot(log).select(SESSION_COLUMNS)


def read_metrics(spark: SparkSession, out: str) -> DataFrame:
    return read_part(spark, current(spark, out), "metrics")


def batch_changes(files: DataFrame, sessions: DataFrame, snapshot: Callable[[DataFrame], DataFrame], agent: str, session_id, version: int) -> tuple[DataFrame, DataFrame]:
    """(log rows, outcomes) of a batch: what the health gate lets through, as puts or removals.

    Of several versions of one session in a batch the last file counts. A
    retained file leaves the snapshot's row as it is. `snapshot` gives the
    current rows of the keys that it is asked for. A file is a whole session:
    sources with several files a session are followed by
    streaming.incremental.start_following.
    """
    named = files.select("path", "mtime", session_id.alias("id")).groupBy("id").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))
    health = named.join(file_health(files), "path")
    parsed = sessions.select("id", F.lit(True).alias("parsed")).distinct()
    # without a user text a partial file is not usable
    gated = gate_outcome(health.join(parsed, "id", "left").withColumn("parsed", F.coalesce("parsed", F.lit(False))).withColumn("usable", F.col("parsed")))
    outcomes = gated.select(F.lit(agent).alias("agent"), "id", "outcome")
    puts = log_rows(sessions.join(outcomes.where("outcome = 'session'").select(*KEY), KEY, "left_semi"), version)
    gone = outcomes.where("outcome = 'delete'")
    gone = gone.join(snapshot(gone).select(*KEY), KEY, "left_semi")
    return puts.unionByName(log_rows(gone, version, "delete")), outcomes


def stream_files(spark: SparkSession, root: str, batch_files: int = BATCH_FILES) -> DataFrame:
    """Streaming (path, mtime, size, value) of whole files that appear under `root`; of tables of files, `batch_files` counts the tables' files."""
    if is_table(root):
        return spark.readStream.schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", batch_files).parquet(root)
    raw = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", batch_files).text(root, wholetext=True)
    meta = F.col("_metadata")
    return raw.select(source_path(meta["file_path"]).alias("path"), (F.unix_micros(meta["file_modification_time"]) / 1_000_000).alias("mtime"), meta["file_size"].alias("size"), "value")


def start_refresh(spark: SparkSession, root: str, out: str, agent: str, parse: Parser, session_id, every: str | None = EVERY, batch_files: int = BATCH_FILES) -> StreamingQuery:
    """Start the refresh of one source; `every` None processes what there is and ends."""
    configure(spark)

    writer_name = f"refresh:{agent}:{root}"

    def on_batch(files: DataFrame, batch_id: int) -> None:
        session = files.sparkSession
        if files.isEmpty() or has_committed(session, out, writer_name, batch_id):
            return
        path = scratch(session, "batch")  # read once: a file may change while it is judged
        files.write.parquet(path)
        files = session.read.schema(files.schema).parquet(path)
        few = files.count() <= FEW_KEYS
        rows, outcomes = batch_changes(files, parse(files), lambda keys: read_snapshot(session, out, keys, few), agent, session_id, 0)
        n = {r.outcome: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
        numbered = lambda number: (rows.withColumn("version", F.lit(number).cast("long")), None)
        number = commit(session, out, numbered, (n.get("session", 0), n.get("retain", 0), n.get("delete", 0)), writer_name, batch_id)
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            compact(session, out)

    writer = stream_files(spark, root, batch_files).writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{out}/checkpoint")
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def refresh_once(spark: SparkSession, root: str, out: str, agent: str, parse: Parser, session_id, batch_files: int = BATCH_FILES) -> DataFrame:
    """Process all files that are new under `root`, then return the snapshot."""
    start_refresh(spark, root, out, agent, parse, session_id, None, batch_files).awaitTermination()
    return read_snapshot(spark, out)


def rebuild(spark: SparkSession, out: str, sessions: DataFrame) -> None:
    """Replace everything by `sessions`, one row per key: a new generation, then the switch to it."""
    commits.rebuild(spark, out, sessions, log_rows)
