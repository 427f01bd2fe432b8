"""Reading agents' files: discovery, lines, documents, health.

A root is a folder of files, or (a path with a part that ends in `.files`) a folder
of tables of landed files, where a row is a whole file: opening, listing and
committing millions of small files costs more than what stands in them.
"""

from __future__ import annotations

import contextlib
import re
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.functions.json import is_strict_json
from sessionlake.functions.paths import path_id

#: A plain file over this size is not read as one row: large_lines and read_blocks read its lines, unread_files names it.
MOST_BYTES = 512 << 20
#: Ending of a folder that holds tables of landed files.
TABLE = ".files"
#: A row of them is a whole file under its path at the source; a path is there once.
FILES = "path string, mtime double, size bigint, value string"
#: Bytes of a row group, so that a large table file is read by several tasks.
GROUP = 16 << 20


@dataclass(frozen=True)
class FileRule:
    """Which files of a folder tree are sessions, and how their id is read from the path."""

    agent: str
    glob: str = "*.jsonl"
    keep: str | None = None  # pattern that a path must have
    drop: str | None = None  # pattern that it must not have
    id_rule: str = "stem"


RULES = {
    "claude": FileRule("claude", drop=r"/agent-[^/]*$"),
    "codex": FileRule("codex", keep=r"/rollout-[^/]*$", id_rule="uuid_tail"),
    "copilot-cli": FileRule("copilot-cli", id_rule="parent_or_stem"),
    "copilot-vscode": FileRule("copilot-vscode", "*.json", drop=r"/workspace\.json$"),
    "grok": FileRule("grok", keep=r"/updates\.jsonl$", id_rule="parent"),
    "kimi": FileRule("kimi", "state.json", id_rule="parent"),
    "opencode": FileRule("opencode", "ses_*.json"),
    "pi": FileRule("pi", id_rule="after_underscore"),
    "vibe": FileRule("vibe", keep=r"/session_[^/]*/messages\.jsonl$", id_rule="parent"),
    "antigravity": FileRule("antigravity", keep=r"/brain/[^/]+/\.system_generated/logs/transcript(_full)?\.jsonl$", id_rule="great_grandparent"),
}


def is_table(root: str | list[str] | DataFrame) -> bool:
    """Whether a root holds tables of landed files."""
    return isinstance(root, str) and any(part.endswith(TABLE) for part in root.split("/"))


def file_table(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """The rows of FILES below `root`."""
    return spark.read.schema(FILES).option("recursiveFileLookup", "true").parquet(*([root] if isinstance(root, str) else root))


def append_files(files: DataFrame, root: str) -> None:
    """Append `files` (path, value) to the tables of landed files in `root`; their time is now."""
    if not is_table(root):
        raise ValueError(f"{root} does not end in {TABLE}")
    rows = files.select("path", (F.unix_micros(F.current_timestamp()) / 1_000_000).alias("mtime"), F.octet_length("value").cast("long").alias("size"), "value")
    rows.write.mode("append").option("parquet.block.size", GROUP).parquet(root)


def list_source_files(spark: SparkSession, root: str, rule: FileRule) -> DataFrame:
    """(agent, session_id, path, mtime, size) of a source's files; contents are not read."""
    files = listing(spark, root, rule.glob)
    out = files.select(F.lit(rule.agent).alias("agent"), "path", "mtime", "size")
    if rule.keep:
        out = out.where(F.col("path").rlike(rule.keep))
    if rule.drop:
        out = out.where(~F.col("path").rlike(rule.drop))
    return out.select("agent", path_id(F.col("path"), rule.id_rule).alias("session_id"), "path", "mtime", "size")


def listing(spark: SparkSession, root: str | list[str], glob: str = "*") -> DataFrame:
    """(file, path, mtime, size) of files under `root` (a folder, or a list of folders and files), empty ones left out; contents are not read. `file` is where it lies (of a row, its table's file as a URI), `path` its source_path."""
    if is_table(root):
        files = file_table(spark, root).where("size > 0").select(F.col("_metadata.file_path").alias("file"), "path", "mtime", "size")
        return files.where(F.col("path").rlike(_name_pattern(glob)))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{glob},part-*.txt}}").load(root)
    files = files.where("length > 0").select(F.col("path").alias("file"), source_path(F.col("path")).alias("path"), (F.unix_micros("modificationTime") / 1_000_000).alias("mtime"), F.col("length").alias("size"))
    return files.where(F.col("path").rlike(_name_pattern(glob)))


def readable_listing(spark: SparkSession, root: str) -> tuple[DataFrame, bool]:
    """`listing` of what can be listed below `root`, and whether that is all of it.

    If some folder cannot be read, the folders of `root` are listed one by one
    and those that cannot are left out. A root that is no folder is an error.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        raise NotADirectoryError(root)
    try:
        return listing(spark, root), True
    except (Py4JJavaError, PySparkException):
        parts = []
        for child in fs.listStatus(p):
            with contextlib.suppress(Py4JJavaError, PySparkException):
                parts.append(listing(spark, child.getPath().toString()))
        if not parts:
            raise
        return reduce(DataFrame.unionByName, parts), False


def source_path(path: Column) -> Column:
    """A file's path at its source.

    A landing job that writes with partitionBy keeps names as folders,
    `dir=<name>/file=<name>/part-....txt`; they are read as the path they stand for.
    """
    named = F.regexp_replace(path, r"/file=([^/]+)/part-[^/]*$", "/$1")
    return F.regexp_replace(named, r"/dir\d?=([^/]+)(?=/)", "/$1")


def _name_pattern(glob: str) -> str:
    return "/" + re.escape(glob).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"


def scan_files(spark: SparkSession, root: str | DataFrame, glob: str = "*") -> DataFrame:
    """(path, mtime, size, value) of whole files under `root`, so that line order is kept.

    Hidden folders must be named in `root`. A DataFrame of files already read (a
    micro-batch) is filtered by name alone.
    """
    if isinstance(root, DataFrame):
        return root.where(F.col("path").rlike(_name_pattern(glob)))
    if is_table(root):
        return file_table(spark, root).where(F.col("path").rlike(_name_pattern(glob)))
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{glob},part-*.txt}}").text(root, wholetext=True)
    meta = F.col("_metadata")
    files = raw.select(source_path(meta["file_path"]).alias("path"), (F.unix_micros(meta["file_modification_time"]) / 1_000_000).alias("mtime"), meta["file_size"].alias("size"), "value")
    return files.where((F.col("size") <= MOST_BYTES) & F.col("path").rlike(_name_pattern(glob)))


def unread_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, mtime, size) of the files under `root` that scan_files leaves out for their size; contents are not read."""
    if is_table(root):
        return file_table(spark, root).select("path", "mtime", "size").where(F.lit(False))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{glob},part-*.txt}}").load(root).where(F.col("length") > MOST_BYTES)
    files = files.select(source_path(F.col("path")).alias("path"), (F.unix_micros("modificationTime") / 1_000_000).alias("mtime"), F.col("length").alias("size"))
    return files.where(F.col("path").rlike(_name_pattern(glob)))


def large_lines(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """lines_of for the files over MOST_BYTES, which Spark reads in blocks."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{glob},part-*.txt}}").option("lineSep", "\n").text(root)
    rows = number_blocks(_block_lines(raw.where(F.col("_metadata")["file_size"] > MOST_BYTES)))
    numbered = rows.select(source_path(F.col("file")).alias("path"), "mtime", F.col("line").alias("line_no"), F.col("value").alias("raw"))
    return numbered.where(F.col("path").rlike(_name_pattern(glob)) & F.col("raw").rlike(r"\S"))


def read_blocks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, mtime, size, block, i, value) of the lines of some files, whatever their size; number_blocks numbers them."""
    return _block_lines(spark.read.option("lineSep", "\n").text(literal_paths(paths)))


def literal_paths(paths: list[str]) -> list[str]:
    """Paths as Spark's readers take them: they are patterns there."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]


def _block_lines(raw: DataFrame) -> DataFrame:
    """Lines with `i`, which grows within a block (of a file, where Spark splits it): rows of a block follow one another in one task."""
    meta = F.col("_metadata")
    return raw.select(
        meta["file_path"].alias("file"), (F.unix_micros(meta["file_modification_time"]) / 1_000_000).alias("mtime"), meta["file_size"].alias("size"),
        meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("i"), F.regexp_replace("value", "\r$", "").alias("value"),
    )


def number_blocks(rows: DataFrame) -> DataFrame:
    """(file, mtime, size, value, line): a line's number is the lines of the blocks before its own and its place in its block."""
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(blocks, ["file", "block"]).select("file", "mtime", "size", "value", (F.col("start") + F.col("i") - F.col("least")).cast("int").alias("line"))


def lines_of(files: DataFrame) -> DataFrame:
    """(path, mtime, line_no, raw): lines that are not blank, numbered from 0 in file order. Files in several rows say in `line` at which line each begins."""
    split = F.posexplode(F.split("value", "\r?\n", -1)).alias("line_no", "raw")
    if "line" in files.columns:
        each = files.select("path", "mtime", "line", split).select("path", "mtime", (F.col("line") + F.col("line_no")).alias("line_no"), "raw")
    else:
        each = files.select("path", "mtime", split)
    return each.where(F.col("raw").rlike(r"\S"))


def scan_jsonl(spark: SparkSession, root: str | DataFrame, glob: str = "*.jsonl") -> DataFrame:
    """(path, mtime, line_no, raw, rec) of good lines: each is one JSON value; blank and bad lines are left out."""
    lines = lines_of(scan_files(spark, root, glob))
    if not isinstance(root, DataFrame) and not is_table(root):
        lines = lines.unionByName(large_lines(spark, root, glob))
    return lines.where(is_strict_json(F.col("raw"))).withColumn("rec", F.try_parse_json("raw"))


def scan_json_docs(spark: SparkSession, root: str | DataFrame, glob: str = "*.json") -> DataFrame:
    """(path, mtime, raw, rec): one JSON value per file; rec is null if it is no JSON."""
    docs = scan_files(spark, root, glob).withColumnRenamed("value", "raw")
    return docs.select("path", "mtime", "raw", F.when(is_strict_json(F.col("raw")), F.try_parse_json("raw")).alias("rec"))


def jsonl_health(lines: DataFrame) -> DataFrame:
    """(path, health) of `lines` (path, line_no, raw).

    CLEAN without a bad line; INVALID without a good one, or if no good line
    follows the last bad one; else PARTIAL.
    """
    ok = is_strict_json(F.col("raw"))
    marked = lines.where(F.col("raw").rlike(r"\S")).select("path", "line_no", ok.alias("ok"))
    grouped = marked.groupBy("path").agg(
        F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"), F.max(F.when(F.col("ok"), F.col("line_no"))).alias("last_good"), F.max(F.when(~F.col("ok"), F.col("line_no"))).alias("last_bad")
    )
    invalid = (F.col("good") == 0) | (F.col("last_bad") > F.col("last_good"))
    return grouped.select("path", F.when(F.col("bad") == 0, "CLEAN").when(invalid, "INVALID").otherwise("PARTIAL").alias("health"))


def file_health(files: DataFrame) -> DataFrame:
    """(path, health) of every file, an empty one CLEAN."""
    found = jsonl_health(lines_of(files))
    paths = files.select("path").distinct() if "line" in files.columns else files.select("path")
    return paths.join(found, "path", "left").select("path", F.coalesce("health", F.lit("CLEAN")).alias("health"))


def json_doc_health(docs: DataFrame) -> DataFrame:
    """(path, health): CLEAN if the document is one JSON value."""
    return docs.select("path", F.when(is_strict_json(F.col("raw")), "CLEAN").otherwise("INVALID").alias("health"))


def prefer_file(files: DataFrame) -> DataFrame:
    """One of two files per session_id (variant full or regular): the full one if not empty and no smaller, else the regular, else the full if not empty."""
    full, regular = F.col("variant") == "full", F.col("variant") == "regular"
    grouped = files.groupBy("session_id").agg(*[F.max(F.when(v, F.struct("size", *[c for c in files.columns if c not in ("session_id", "variant", "size")]))).alias(n) for n, v in (("f", full), ("r", regular))])
    take_full = (F.col("f.size") > 0) & (F.col("r").isNull() | (F.col("f.size") >= F.col("r.size")))
    chosen = F.when(take_full, F.col("f")).otherwise(F.col("r"))
    return grouped.withColumn("c", chosen).where("c is not null").select("session_id", "c.*")


def number_lines(df: DataFrame, *keys: str, order: str) -> DataFrame:
    return df.withColumn("line_no", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
