"""Batches of the session log that several writers may commit, and generations of it.

A writer claims a number by creating `claims/<n>`, which only one can; it then
writes `log/batch_id=<n>` and `marks/batch_id=<n>`, and last a row of
`metrics/batch_id=<n>`, without which readers do not see the batch. Numbers order
what is said of a session: the highest counts. Writers do not wait for one
another; what one of them said of a session on older grounds is marked with these
grounds (the mark names the files' time and size), so the next refresh sees that
they moved.

All of it lies in a generation, which the pointer `CURRENT` names. Compaction and
rebuilds write a new one and switch to it. A writer looks at the pointer after
its commit and commits again if it moved; whoever moved it then takes over what
had been committed to the old one since it was read. Between them no commit is
lost: it came before the switch, or its writer sees the switch.

Claims need a file system whose create-if-absent is one step (a local one, HDFS,
object stores with conditional puts).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.model import SESSION_LOG
from sessionlake.sources.scratch import read_text, replace_text

METRICS = "files bigint, upserts bigint, retained bigint, deletes bigint, writer string, writer_batch bigint"
MARKS = "agent string, key string, id string, mtime double, size bigint, entry bigint, version bigint"
_SCHEMAS = {"log": SESSION_LOG, "marks": MARKS, "metrics": METRICS}
#: Generations number their batches from multiples of this, so that batches taken over from an older one keep their numbers.
STEP = 1_000_000


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of change in ms) of what lies in a folder."""
    fs, p = file_system(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []


def create_if_absent(spark: SparkSession, path: str) -> bool:
    """Create an empty file; whether it was not there."""
    fs, p = file_system(spark, path)
    fs.mkdirs(p.getParent())
    jvm = spark.sparkContext._jvm
    uri = fs.makeQualified(p).toUri()
    try:
        if uri.getScheme() == "file":
            none = spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
            jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Paths.get(uri), none)
        else:
            fs.create(p, False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


# -- generations ---------------------------------------------------------------


def current(spark: SparkSession, out: str) -> str:
    """Folder of the current generation: the one that `CURRENT` names, `out` itself before the first switch."""
    fs, p = file_system(spark, f"{out}/CURRENT")
    if not fs.exists(p):
        return out
    return f"{out}/{read_text(spark, f'{out}/CURRENT')}"


def switch(spark: SparkSession, out: str, generation: str) -> None:
    """Make `generation`, a complete folder under `out`, the current one."""
    replace_text(spark, f"{out}/CURRENT", generation)


def _numbers(spark: SparkSession, base: str, part: str) -> set[int]:
    return {int(name.removeprefix("batch_id=")) for name, _ in _names(spark, f"{base}/{part}") if name.removeprefix("batch_id=").isdigit()}


def committed(spark: SparkSession, base: str) -> set[int]:
    """Numbers of a generation's committed batches, at most as many as a compaction leaves to gather."""
    return {r.batch_id for r in read_part(spark, base, "metrics").select("batch_id").distinct().collect()}


def claim(spark: SparkSession, base: str) -> int:
    """A batch number that no other writer has."""
    n = max(_numbers(spark, base, "claims") | _numbers(spark, base, "metrics"), default=-1) + 1
    while not create_if_absent(spark, f"{base}/claims/{n}"):
        n += 1
    return n


def read_part(spark: SparkSession, base: str, part: str) -> DataFrame:
    """`log`, `marks` or `metrics` of a generation, uncommitted batches too."""
    full = f"{_SCHEMAS[part]}, batch_id bigint"
    fs, p = file_system(spark, f"{base}/{part}")
    if not fs.exists(p):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(f"{base}/{part}")


def read_committed(spark: SparkSession, base: str, part: str) -> DataFrame:
    done = read_part(spark, base, "metrics").select("batch_id").distinct()
    return read_part(spark, base, part).join(F.broadcast(done), "batch_id", "left_semi").drop("batch_id")


# -- commits -------------------------------------------------------------------

#: base and number of a batch -> what to write of it: log rows, marks (or None)
Batch = Callable[[int], tuple[DataFrame, DataFrame | None]]


def commit_batch(rows: DataFrame, metrics: DataFrame, base: str, number: int, marks: DataFrame | None = None) -> None:
    """Write a batch's rows and marks, then the metrics row that makes it visible; `number` is the caller's."""
    rows.write.mode("overwrite").parquet(f"{base}/log/batch_id={number}")
    if marks is not None:
        marks.write.mode("overwrite").parquet(f"{base}/marks/batch_id={number}")
    metrics.write.mode("overwrite").parquet(f"{base}/metrics/batch_id={number}")


def commit(spark: SparkSession, out: str, batch: Batch, counts: tuple[int, int, int], writer: str | None = None, writer_batch: int | None = None) -> int:
    """Commit (upserts, retained, deletes) and their rows as a new batch of the current generation; its number.

    A writer that names itself and its batch can ask with `has_committed`
    whether a retry is needed.
    """
    metrics = spark.createDataFrame([(sum(counts), *counts, writer, writer_batch)], METRICS)
    while True:
        base = current(spark, out)
        number = claim(spark, base)
        rows, marks = batch(number)
        commit_batch(rows, metrics, base, number, marks)
        if current(spark, out) == base:
            return number


def has_committed(spark: SparkSession, out: str, writer: str, writer_batch: int) -> bool:
    found = read_part(spark, current(spark, out), "metrics").where((F.col("writer") == writer) & (F.col("writer_batch") == writer_batch))
    return not found.isEmpty()


def last_rows(log: DataFrame) -> DataFrame:
    """The last row of every key of a log, version and op with it; a delete beats a put of the same version."""
    rank = F.col("version") * 2 + F.when(F.col("op") == "delete", 1).otherwise(0)
    best = log.groupBy("agent", "id").agg(F.max(rank).alias("__rank"))
    return log.withColumn("__rank", rank).join(best, ["agent", "id", "__rank"], "left_semi").drop("__rank")


def known_keys(log: DataFrame) -> DataFrame:
    """(agent, id) whose last row of a log is a put; what last_rows says, from the narrow columns in one aggregate."""
    rank = F.col("version") * 2 + F.when(F.col("op") == "delete", 1).otherwise(0)
    return log.groupBy("agent", "id").agg(F.max(rank).alias("__rank")).where("__rank % 2 = 0").select("agent", "id")


def last_marks(marks: DataFrame) -> DataFrame:
    """The last mark of every key, cleared ones (without mtime) too."""
    last = marks.groupBy("agent", "key").agg(F.max_by(F.struct("id", "mtime", "size", "entry", "version"), "version").alias("m"))
    return last.select("agent", "key", "m.*")


def start_generation(spark: SparkSession, out: str, fill: Callable[[str, set[int], int], tuple[DataFrame, DataFrame | None]]) -> None:
    """Write a new generation and switch to it.

    `fill` gets the old generation, its committed batches and the new first
    number, and gives log rows and marks. Batches committed to the old one after
    that are taken over under their numbers.
    """
    old = current(spark, out)
    done = committed(spark, old)
    first = (max(done | _numbers(spark, old, "claims"), default=-1) // STEP + 1) * STEP
    generation = f"generation-{uuid.uuid4().hex}"
    base = f"{out}/{generation}"
    rows, marks = fill(old, done, first)
    if not create_if_absent(spark, f"{base}/claims/{first}"):
        raise RuntimeError(f"{base} is not new")
    rows.write.parquet(f"{base}/log/batch_id={first}")
    n = spark.read.schema(SESSION_LOG).parquet(f"{base}/log/batch_id={first}").where("op <> 'delete'").count()
    if marks is not None:
        marks.write.parquet(f"{base}/marks/batch_id={first}")
    spark.createDataFrame([(n, n, 0, 0, None, None)], METRICS).write.parquet(f"{base}/metrics/batch_id={first}")
    switch(spark, out, generation)
    for number in sorted(committed(spark, old) - done):
        for part in ("log", "marks", "metrics"):
            late = read_part(spark, old, part).where(F.col("batch_id") == number).drop("batch_id")
            late.write.mode("overwrite").parquet(f"{base}/{part}/batch_id={number}")


def compact(spark: SparkSession, out: str) -> None:
    """A new generation with the last row and mark of every key, each with its version.

    Removals are left out, but for those that a batch which is still being
    written, and has a lower number, could undo.
    """

    def fill(old: str, done: set[int], first: int) -> tuple[DataFrame, DataFrame]:
        open_ = _numbers(spark, old, "claims") - done
        rows = last_rows(read_committed(spark, old, "log")).where((F.col("op") != "delete") | (F.col("version") > min(open_, default=first)))
        return rows, last_marks(read_committed(spark, old, "marks")).where("mtime is not null")

    start_generation(spark, out, fill)


def rebuild(spark: SparkSession, out: str, sessions: DataFrame, log_rows: Callable[[DataFrame, int], DataFrame]) -> None:
    """A new generation of `sessions`, one row per key. Marks of sessions that are among them stay, so what did not change is not parsed again."""

    def fill(old: str, done: set[int], first: int) -> tuple[DataFrame, DataFrame]:
        marks = last_marks(read_committed(spark, old, "marks")).where("mtime is not null")
        return log_rows(sessions, first), marks.join(sessions.select("agent", "id"), ["agent", "id"], "left_semi").select([c.split()[0] for c in MARKS.split(", ")])

    start_generation(spark, out, fill)


def vacuum(spark: SparkSession, out: str, retain_hours: float = 24 * 7) -> list[str]:
    """Delete generations that are not current, and batches of the current one that were never committed, if nothing in them changed for `retain_hours`; what was deleted."""
    oldest = (time.time() - retain_hours * 3600) * 1000
    base, gone = current(spark, out), []
    done = committed(spark, base)
    if base != out:
        parts = ("log", "marks", "metrics", "claims")
        gone += [f"{out}/{name}" for name, at in _names(spark, out) if at <= oldest and f"{out}/{name}" != base and (name.startswith("generation-") or name in parts)]
    for part in ("log", "marks"):
        gone += [f"{base}/{part}/{name}" for name, at in _names(spark, f"{base}/{part}") if at <= oldest and name.startswith("batch_id=") and int(name[9:]) not in done]
    for path in gone:
        fs, p = file_system(spark, path)
        fs.delete(p, True)
    return gone
