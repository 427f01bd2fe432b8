"""The registry of file sources: which files make a session, how they are parsed, when a partial one is usable."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions.json import get, is_strict_json
from sessionlake.functions.paths import path_id
from sessionlake.functions.times import parse_iso
from sessionlake.model import configure
from sessionlake.operators.refresh import latest_lookup
from sessionlake.sources import agents
from sessionlake.sources.scan import lines_of, listing, readable_listing, scan_files, scan_json_docs, scan_jsonl


def _key(rule: str) -> Callable[[Column], Column]:
    return lambda path: path_id(path, rule)


def _kimi_key(path: Column) -> Column:
    return F.regexp_extract(path, r"/([^/]+)/(?:(?:session-meta/)?state\.json|agents/main/wire\.jsonl)$", 1)


@dataclass(frozen=True)
class Source:
    """A kind of session files below one folder.

    own: pattern of the paths of a session's files; key: what such files of one
    session have in common; lines: pattern of those whose health decides;
    shared: pattern of files about many sessions, which every parse reads;
    folder: whether a session's files share a folder of its own; head:
    pattern, and value of a record, of the file that may name the session
    otherwise than its key does; sure_head: whether bad lines before that record
    leave the id uncertain; entries: what the shared files say of sessions, as
    (id, entry) with a hash of it; usable: whether a session parsed from a partial
    file is kept.
    """

    agent: str
    own: str
    key: Callable[[Column], Column]
    lines: str = r"\.jsonl$"
    shared: str = ""
    folder: bool = False
    head: tuple[str, Column] | None = None
    sure_head: bool = False
    entries: Callable[[SparkSession, DataFrame, str | None], DataFrame] | None = None
    usable: Callable[[], Column] = field(default=lambda: F.lit(True))

    def parse(self, spark: SparkSession, files: str | DataFrame, origin: str | None = None) -> DataFrame:
        """Sessions of a folder, or of files (path, mtime, size, value) that were read; origin: the folder in which an index's paths were written (kimi)."""
        more = {"origin": origin} if self.agent in agents.WITH_ORIGIN else {}
        return agents.sessions_of(self.agent, agents.FILE_SOURCES[self.agent](spark, files, **more))

    def list_files(self, spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, bool]:
        """(own, shared) files below `root`, own with key, and whether all folders could be listed. Contents are not read."""
        files, complete = readable_listing(spark, root)
        own = files.where(F.col("path").rlike(self.own)).withColumn("key", self.key(F.col("path"))).where("key <> ''")
        return own, files.where(F.col("path").rlike(self.shared)) if self.shared else files.limit(0), complete

    def home(self, file: str) -> str:
        """The file, or the folder of its session if that has several files, as they lie (landed names too)."""
        if not self.folder:
            return file
        place = re.sub(r"(/file=[^/]+)?/[^/]*$", "", file)
        return re.sub(r"(/(dir\d?=)?agents/(dir\d?=)?main|/(dir\d?=)?session-meta)$", "", place)

    def list_near(self, spark: SparkSession, root: str, files: list[str]) -> tuple[DataFrame, DataFrame]:
        """(own, shared) files of the sessions of some files below `root`, found from their paths: nothing else is listed."""
        homes = sorted({self.home(f) for f in files})
        own = listing(spark, homes)
        own = own.where(F.col("path").rlike(self.own)).withColumn("key", self.key(F.col("path"))).where("key <> ''")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        above, top = set(), fs.makeQualified(p).toUri().getPath().rstrip("/")
        for home in homes:
            while len(home := home.rpartition("/")[0]) and spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home).toUri().getPath().startswith(top):
                if home in above:
                    break
                above.add(home)
        name = re.sub(r"^/|\$$|\\", "", self.shared)
        found = [s.getPath().toString() for folder in sorted(above) for glob in (name, f"file={name}/part-*") for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{glob}")) or ()] if name else []
        return own, listing(spark, found) if found else own.limit(0).drop("key")

    def ids(self, files: DataFrame) -> DataFrame:
        """(key, id, uncertain) of the sessions of `files`."""
        keys = files.where(F.col("path").rlike(self.own)).select(self.key(F.col("path")).alias("key")).where("key <> ''").distinct()
        if self.head is None:
            return keys.select("key", F.col("key").alias("id"), F.lit(False).alias("uncertain"))
        name, value = self.head
        spark = configure(files.sparkSession)
        if name.endswith(".jsonl"):
            found = scan_jsonl(spark, files, name)
        else:
            found = scan_json_docs(spark, files, name).withColumn("line_no", F.lit(0))
        value = F.nullif(value, F.lit(""))
        named = found.groupBy(self.key(F.col("path")).alias("key")).agg(F.min_by(value, F.when(value.isNotNull(), F.col("line_no"))).alias("named"))
        ids = keys.join(named, "key", "left").select("key", F.coalesce("named", "key").alias("id"))
        if not self.sure_head:
            return ids.withColumn("uncertain", F.lit(False))
        header = found.where(value.isNotNull()).groupBy(self.key(F.col("path")).alias("key")).agg(F.min("line_no").alias("header"))
        lines = lines_of(scan_files(spark, files, name)).where(~is_strict_json(F.col("raw")))
        bad = lines.groupBy(self.key(F.col("path")).alias("key")).agg(F.min("line_no").alias("bad"))
        # a header that was found names the session, whatever stands before it
        return ids.join(header, "key", "left").join(bad, "key", "left").select("key", "id", (F.col("bad").isNotNull() & F.col("header").isNull()).alias("uncertain"))


def _claude_entries(spark: SparkSession, files: DataFrame, origin: str | None) -> DataFrame:
    return agents.claude_index(spark, files).select(F.col("session_id").alias("id"), F.xxhash64("summary", "modified", "file_mtime").alias("entry"))


def _codex_entries(spark: SparkSession, files: DataFrame, origin: str | None) -> DataFrame:
    # an entry without a time of its own has its file's, which says nothing of the entry
    own = F.when(parse_iso(F.col("updated_at")).isNotNull(), F.col("updated_at"))
    return latest_lookup(agents.codex_names(spark, files)).select("id", F.xxhash64("thread_name", own).alias("entry"))


def _kimi_entries(spark: SparkSession, files: DataFrame, origin: str | None) -> DataFrame:
    if origin is None:
        return spark.createDataFrame([], "id string, entry bigint")
    return agents.kimi_work_dirs(spark, files, origin).select(F.col("session_id").alias("id"), F.xxhash64("at", "work_dir").alias("entry"))


def _sources() -> dict[str, Source]:
    rec = F.col("rec")
    kind = get(rec, "$.type")
    every = (
        Source("antigravity", r"/transcript(_full)?\.jsonl$", _key("great_grandparent"), folder=True, shared=r"/history\.jsonl$"),
        Source("claude", r"/(?!agent-)[^/]*\.jsonl$", _key("stem"), shared=r"/sessions-index\.json$", entries=_claude_entries),
        Source("codex", r"/rollout-[^/]*\.jsonl$", _key("uuid_tail"), shared=r"/session_index\.jsonl$", head=("*.jsonl", F.when(kind == "session_meta", get(rec, "$.payload.id"))), entries=_codex_entries),
        Source("copilot-cli", r"\.jsonl$", _key("parent_or_stem"), head=("*.jsonl", F.when(kind == "session.start", get(rec, "$.data.sessionId"))), sure_head=True),
        Source("copilot-vscode", r"/(?!workspace\.json$)[^/]*\.json$", _key("stem"), lines="", shared=r"/workspace\.json$", head=("*.json", get(rec, "$.sessionId"))),
        Source("grok", r"/(updates\.jsonl|summary\.json)$", _key("parent"), folder=True),
        Source("kimi", r"/(state\.json|agents/main/wire\.jsonl)$", _kimi_key, folder=True, shared=r"/session_index\.jsonl$", entries=_kimi_entries, usable=lambda: F.col("message_count") > 0),
        Source("pi", r"\.jsonl$", _key("after_underscore"), head=("*.jsonl", F.when(kind == "session", get(rec, "$.id")))),
        Source("vibe", r"/session_[^/]*/(messages\.jsonl|meta\.json)$", _key("parent"), folder=True, head=("meta.json", get(rec, "$.session_id")), usable=lambda: F.col("content").rlike("(^|\n\n)» ")),
    )
    return {s.agent: s for s in every}


def source(agent: str) -> Source:
    """The registered source of an agent (needs an active session)."""
    return _sources()[agent]
