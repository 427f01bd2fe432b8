"""The tables that searches read, laid out so that one search reads its own terms.

Postings carry the positions of their term. They, the vocabulary and the fuzzy
keys are partitioned by a hash of the term (or key), sorted by it inside, and a
bucket that one term fills is written by several tasks. A search whose terms are
few enough names them in the filter, so only their buckets are listed and only
pages with them are read; more terms meet the tables by a join.

A kept index is a list of segments that never change. An update writes one for
the sessions that changed: their rows, the keys that hide rows of those sessions
in earlier segments, and by how much frequencies and lengths differ, so sums over
segments are what a whole rebuild would count. Later segments are merged into one
when they have grown to a share of what stands before them, so each row is
rewritten a number of times that grows as the logarithm of the index.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions.text import all_tokens, is_term
from sessionlake.sources.scratch import read_text, replace_text, scratch

FUZZY_LEAST_CHARS = 3
#: Lengths of the beginnings under which terms are filed; a word uses the longest that it has.
FUZZY_LENGTHS = (3, 6)
#: Terms up to which a search names them in the filter of its scans.
NAMED_TERMS = 2_000
#: Postings in a bucket, about, and the buckets at least and at most.
BUCKET_ROWS = 5_000_000
BUCKETS = (16, 4096)


def postings(sessions: DataFrame) -> DataFrame:
    """(agent, id, field, term, tf, len, positions): a row per field and distinct term.

    len is the field's length in terms; positions count words from 0, those
    that are too long to be terms too. Terms are counted within their row, so
    nothing is shuffled to make the table. A directory is one raw term.
    """
    return _counted(sessions.withColumns({f: _placed(F.col(f)) for f in ("title", "content")}))


def _placed(text: Column) -> Column:
    """Terms with their positions, sorted."""
    at = F.transform(all_tokens(text), lambda t, i: F.struct(t.alias("term"), i.alias("at")))
    return F.sort_array(F.filter(at, lambda x: is_term(x["term"])))


def _counted(placed: DataFrame) -> DataFrame:
    """Postings of sessions whose title and content are sorted arrays of (term, at)."""

    def counted(field: str) -> DataFrame:
        rows = placed.select("agent", "id", F.lit(field).alias("field"), F.col(field).alias("w"))
        # equal terms are neighbours: a run's length is the distance between its ends
        ends = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: ~F.try_element_at("w", i + 1)["term"].eqNullSafe(F.element_at("w", i)["term"]))
        rows = rows.where(F.size("w") > 0).withColumn("ends", ends).withColumn("places", F.transform("w", lambda x: x["at"]))
        # runs become rows before they are taken out: that is compiled code, which a transform's is not. No row has no end; of an
        # inner explode the planner would test the number of ends below, where finding each reads the text again
        rows = rows.select("*", F.posexplode_outer("ends").alias("k", "end"))
        tf = F.col("end") - F.coalesce(F.get("ends", F.col("k") - 1), F.lit(0))
        return rows.select("agent", "id", "field", F.element_at("w", F.col("end"))["term"].alias("term"), tf.cast("long").alias("tf"), F.size("w").cast("long").alias("len"), F.slice("places", F.col("end") - tf + 1, tf).alias("positions"))

    one = F.lit(1).cast("long")
    raw = placed.where("directory <> ''").select("agent", "id", F.lit("directory").alias("field"), F.col("directory").alias("term"), one.alias("tf"), one.alias("len"), F.array(F.lit(0)).alias("positions"))
    return counted("title").unionByName(counted("content")).unionByName(raw)


def vocabulary(post: DataFrame) -> DataFrame:
    """(field, term, df)."""
    return post.groupBy("field", "term").agg(F.count("*").alias("df"))


def field_totals(sessions: DataFrame, post: DataFrame) -> DataFrame:
    """(field, docs, avg_len): all sessions count, also those with an empty field."""
    n = sessions.agg(F.count("*").alias("docs"))
    # a field's length is on each of its rows, in proportion to tf
    lengths = post.groupBy("field").agg(F.sum("tf").alias("total"))
    return lengths.crossJoin(F.broadcast(n)).select("field", "docs", (F.col("total") / F.col("docs")).alias("avg_len"))


def deletions(c: Column) -> Column:
    """The string and all strings that lack one of its characters."""
    return F.array_append(F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.char_length(c)))), c)


def _filed(n: int, keys: Column) -> Column:
    """Keys of beginnings of n characters: apart from those of other lengths."""
    return F.transform(keys, lambda k: F.concat(F.lit(f"{n}:"), k))


def cells_of_fuzzy(word: Column) -> Column:
    """Keys of a word: its beginning of the longest filed length, less one character or none, after that length."""
    out = F.array().cast("array<string>")
    for n in FUZZY_LENGTHS:
        out = F.when(F.char_length(word) >= n, _filed(n, F.array_distinct(deletions(F.substring(word, 1, n))))).otherwise(out)
    return out


def fuzzy_keys(vocab: DataFrame) -> DataFrame:
    """(key, field, term): where terms of titles and contents are filed.

    A word of n characters or more is within one edit of a beginning of a term
    only if its own first n are within one edit of such a beginning, which then
    has n - 1 to n + 1 characters; strings within one edit (or swap) of one
    another share one that lacks a character of one of them, or of both.
    """
    term = F.col("term")
    keys = []
    for n in FUZZY_LENGTHS:
        cut = [F.substring(term, 1, m) for m in (n - 1, n, n + 1)]
        made = F.array_distinct(F.concat(F.array(cut[0]), deletions(cut[1]), deletions(cut[2])))
        keys.append(F.when(F.char_length(term) >= n - 1, _filed(n, made)).otherwise(F.array().cast("array<string>")))
    terms = vocab.where(F.col("field").isin("title", "content"))
    return terms.select(F.explode(F.concat(*keys)).alias("key"), "field", "term")


def _bucket(c: Column, buckets: int) -> Column:
    return (F.crc32(c.cast("binary")) % buckets).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """Tables that searches read: slim sessions (agent, id, directory, timestamp), postings, vocabulary, field totals and, in one that is kept, fuzzy keys.

    buckets: into how many the last tables are partitioned, 0 if they are not;
    removed: (agent, id, at) of keys that hide rows of segments under `at`.
    """

    slim: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    totals: DataFrame
    fuzzy_keys: DataFrame | None = None
    buckets: int = 0
    removed: DataFrame | None = None

    def postings_of(self, terms: DataFrame | list[str]) -> DataFrame:
        """Postings in which those of `terms` (term, or a list of them) are."""
        return live(self.postings_named(terms), self.removed)

    def postings_named(self, terms: DataFrame | list[str]) -> DataFrame:
        """postings_of with those that later segments hide."""
        return self._named(self.postings, "term", terms)

    def vocabulary_of(self, terms: DataFrame | list[str]) -> DataFrame:
        found = self._named(self.vocabulary, "term", terms)
        return found if self.removed is None else _summed(found)

    def terms_near(self, keys: DataFrame | list[str]) -> DataFrame:
        """(key, field, term) in which those of `keys` (key, or a list of them) are."""
        return fuzzy_keys(self.vocabulary) if self.fuzzy_keys is None else self._named(self.fuzzy_keys, "key", keys)

    def _named(self, table: DataFrame, column: str, wanted: DataFrame | list[str]) -> DataFrame:
        if not self.buckets:
            return table
        if isinstance(wanted, DataFrame):
            names = [r[0] for r in wanted.distinct().limit(NAMED_TERMS + 1).collect()]
            some = None if len(names) <= NAMED_TERMS else [r[0] for r in wanted.select(_bucket(F.col(column), self.buckets)).distinct().collect()]  # at most BUCKETS[1]
        else:
            names, some = sorted(set(wanted)), None
        some = sorted({crc32(n.encode()) % self.buckets for n in names}) if some is None else some
        found = table.where(F.col("bucket").isin(some))
        return (found.where(F.col(column).isin(names)) if len(names) <= NAMED_TERMS else found).drop("bucket")


def _spread(df: DataFrame, path: str, by: str, buckets: int) -> None:
    """Write `df` partitioned by a hash of `by` and sorted by it; a bucket too large for a task is split over several."""
    rows = df.withColumn("bucket", _bucket(F.col(by), buckets)).hint("rebalance", "bucket")
    rows.sortWithinPartitions("bucket", by).write.partitionBy("bucket").mode("overwrite").parquet(path)


def live(rows: DataFrame, removed: DataFrame | None) -> DataFrame:
    """Rows (agent, id, segment, ...) that no later segment hides, without the segment."""
    if removed is None:
        return rows.drop("segment")
    hides = removed.withColumnsRenamed({"agent": "__agent", "id": "__id"})
    return rows.join(hides, (F.col("agent") == F.col("__agent")) & (F.col("id") == F.col("__id")) & (F.col("at") > F.col("segment")), "left_anti").drop("segment")


def _summed(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")


def _narrow(sessions: DataFrame) -> DataFrame:
    return sessions.select("agent", "id", "directory", "timestamp", _placed(F.col("title")).alias("title"), _placed(F.col("content")).alias("content"))


def build_index(sessions: DataFrame, path: str | None = None) -> SearchIndex:
    """Write the index of `sessions` under `path`; without one, a plainer one for a few searches in a new scratch folder. What it reads of them is read once."""
    spark = sessions.sparkSession
    if path is not None:
        segment = f"segment-{uuid.uuid4().hex}"
        narrow = _table(_narrow(sessions).sortWithinPartitions("agent", "id"), f"{path}/{segment}/tokens")
        size = narrow.agg(F.count("*").alias("docs"), F.sum(F.size("title") + F.size("content")).alias("n")).first()
        buckets = min(max((size.n or 0) // BUCKET_ROWS, BUCKETS[0]), BUCKETS[1])
        _write_segment(narrow, None, f"{path}/{segment}", buckets)
        replace_text(spark, f"{path}/MANIFEST", json.dumps({"buckets": buckets, "segments": [{"name": segment, "docs": size.docs, "rows": size.docs}]}))
        return open_index(spark, path)
    base = scratch(spark, "search")
    narrow = _table(_narrow(sessions), f"{base}/tokens")
    slim, post = narrow.select("agent", "id", "directory", "timestamp"), _table(_counted(narrow), f"{base}/postings")
    return SearchIndex(slim, post, _table(vocabulary(post), f"{base}/vocabulary"), _table(field_totals(slim, post), f"{base}/totals"))


def _table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write_segment(narrow: DataFrame, old: DataFrame | None, path: str, buckets: int) -> None:
    """Everything of a segment but its tokens: of the sessions `narrow`, which take the place of `old`, if there are such."""
    spark = narrow.sparkSession
    _spread(_counted(narrow), f"{path}/postings", "term", buckets)
    post = spark.read.schema(_TABLES["postings"]).parquet(f"{path}/postings")
    if old is None:
        _spread(vocabulary(post), f"{path}/vocabulary", "term", buckets)
        _spread_fuzzy(spark.read.schema(_TABLES["vocabulary"]).parquet(f"{path}/vocabulary"), path, buckets)
        post.groupBy("field").agg(F.sum("tf").alias("total")).write.mode("overwrite").parquet(f"{path}/totals")
        return
    own = post.select("field", "term", "tf", F.lit(1).cast("long").alias("sign")).unionByName(_counted(old).select("field", "term", "tf", F.lit(-1).cast("long").alias("sign")))
    df = own.groupBy("field", "term").agg(F.sum("sign").alias("df"))
    _spread(df.where("df <> 0"), f"{path}/vocabulary", "term", buckets)
    _spread_fuzzy(vocabulary(post), path, buckets)
    own.groupBy("field").agg(F.sum(F.col("tf") * F.col("sign")).alias("total")).write.mode("overwrite").parquet(f"{path}/totals")


def _spread_fuzzy(vocab: DataFrame, path: str, buckets: int) -> None:
    """Write the fuzzy keys: many times the rows of the terms, which are few enough to lie in a few tasks and are dealt out first."""
    _spread(fuzzy_keys(vocab.repartition(buckets, "term")), f"{path}/fuzzy_keys", "key", buckets)


_KEY = "agent string, id string"
_TERMS = "array<struct<term: string, at: int>>"
_TABLES = {
    "tokens": f"{_KEY}, directory string, timestamp timestamp, title {_TERMS}, content {_TERMS}", "postings": f"{_KEY}, field string, term string, tf bigint, len bigint, positions array<int>, bucket int",
    "vocabulary": "field string, term string, df bigint, bucket int", "totals": "field string, total bigint", "fuzzy_keys": "key string, field string, term string, bucket int", "removed": _KEY,
}
#: A segment joins those after it when it has under this many times their rows.
MERGE_FACTOR = 2


def manifest(spark: SparkSession, path: str) -> dict:
    """{"buckets", "segments": [{"name", "docs" (sessions more than before), "rows" (sessions in it)}]}, in their order."""
    return json.loads(read_text(spark, f"{path}/MANIFEST"))


def _parts(spark: SparkSession, path: str, segments: list[dict], part: str, first: int = 0) -> DataFrame:
    """A table of all segments, each row with the number of its segment."""
    found = [spark.read.schema(_TABLES[part]).parquet(f"{path}/{s['name']}/{part}").withColumn("segment", F.lit(k)) for k, s in enumerate(segments, first)]
    return reduce(DataFrame.unionByName, found)


def _removed(spark: SparkSession, path: str, segments: list[dict]) -> DataFrame | None:
    """(agent, id, at): the last segment that hides a key in those before it; None if none does."""
    later = segments[1:]
    if not later:
        return None
    return _parts(spark, path, later, "removed", 1).groupBy("agent", "id").agg(F.max("segment").alias("at"))


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    """The index that build_index and update_index wrote under `path`."""
    found = manifest(spark, path)
    segments = found["segments"]
    removed = _removed(spark, path, segments)
    docs = sum(s["docs"] for s in segments)
    slim = live(_parts(spark, path, segments, "tokens").select("agent", "id", "directory", "timestamp", "segment"), removed)
    totals = _parts(spark, path, segments, "totals").groupBy("field").agg(F.sum("total").alias("total")).where("total > 0")
    totals = totals.select("field", F.lit(docs).cast("long").alias("docs"), (F.col("total") / docs).alias("avg_len"))
    post, vocab, fuzzy = (_parts(spark, path, segments, part) for part in ("postings", "vocabulary", "fuzzy_keys"))
    return SearchIndex(slim, post, vocab.drop("segment"), totals, fuzzy.drop("segment"), found["buckets"], removed)


def update_index(spark: SparkSession, path: str, changed: DataFrame, removed_keys: DataFrame) -> SearchIndex:
    """Bring the index under `path` up to `changed` sessions (new ones too) and the loss of `removed_keys` (agent, id).

    Of the other sessions nothing is rewritten; the tokens of changed ones are
    read by their keys. One update at a time: the manifest is replaced whole.
    """
    found = manifest(spark, path)
    segments, buckets = found["segments"], found["buckets"]
    base = f"{path}/segment-{uuid.uuid4().hex}"
    narrow = _table(_narrow(changed).sortWithinPartitions("agent", "id"), f"{base}/tokens")
    keys = _table(narrow.select("agent", "id").unionByName(removed_keys.select("agent", "id")).distinct(), f"{base}/removed")
    before = _parts(spark, path, segments, "tokens")
    some = keys.select("id").limit(NAMED_TERMS + 1).collect()
    if len(some) <= NAMED_TERMS:
        before = before.where(F.col("id").isin([r.id for r in some]))
    old = live(before.join(keys, ["agent", "id"], "left_semi"), _removed(spark, path, segments))
    old = _table(old, scratch(spark, "replaced"))
    _write_segment(narrow, old, base, buckets)
    rows = narrow.count()
    segments = [*segments, {"name": base.rpartition("/")[2], "docs": rows - old.count(), "rows": rows}]
    replace_text(spark, f"{path}/MANIFEST", json.dumps({"buckets": buckets, "segments": segments}))
    _merge_small(spark, path)
    return open_index(spark, path)


def _merge_small(spark: SparkSession, path: str) -> None:
    """Merge the last segments into one, as far back as a segment has under MERGE_FACTOR times the rows of those after it."""
    segments = manifest(spark, path)["segments"]
    k, after = len(segments) - 1, max(segments[-1]["rows"], 1)
    while k > 0 and segments[k - 1]["rows"] < MERGE_FACTOR * after:
        k -= 1
        after += segments[k]["rows"]
    if k < len(segments) - 1:
        merge_segments(spark, path, k)


def merge_segments(spark: SparkSession, path: str, first: int = 0) -> None:
    """Make one of the segments from number `first` on: their live rows and sums. Contents of sessions are not read."""
    found = manifest(spark, path)
    segments, buckets = found["segments"], found["buckets"]
    own, base = segments[first:], f"{path}/segment-{uuid.uuid4().hex}"
    removed = _removed(spark, path, own)
    narrow = _table(live(_parts(spark, path, own, "tokens"), removed).sortWithinPartitions("agent", "id"), f"{base}/tokens")
    if first:
        _parts(spark, path, own, "removed").select("agent", "id").distinct().write.parquet(f"{base}/removed")
    post = live(_parts(spark, path, own, "postings"), removed).drop("bucket")
    _spread(post, f"{base}/postings", "term", buckets)
    vocab = _parts(spark, path, own, "vocabulary").groupBy("field", "term").agg(F.sum("df").alias("df"))
    _spread(vocab.where("df <> 0"), f"{base}/vocabulary", "term", buckets)
    _spread_fuzzy(vocabulary(spark.read.schema(_TABLES["postings"]).parquet(f"{base}/postings")), base, buckets)
    _parts(spark, path, own, "totals").groupBy("field").agg(F.sum("total").alias("total")).write.parquet(f"{base}/totals")
    merged = {"name": base.rpartition("/")[2], "docs": sum(s["docs"] for s in own), "rows": narrow.count()}
    replace_text(spark, f"{path}/MANIFEST", json.dumps({"buckets": buckets, "segments": [*segments[:first], merged]}))
