"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; for each host (source) the distinct documents
that hold a line are counted. Lines above the host's limit are boilerplate: they
are removed, and a document that loses most of its words that way is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.scratch import written

#: A line is boilerplate in a host if more documents than both of these hold it.
LEAST_DOCS = 20
SHARE_OF_DOCS = 0.1
#: Share of its words that a kept document may lose.
MOST_LOST = 0.5
LEAST_WORDS = 20
WINDOW = 8
GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Array of the maximal runs of other than space and bytes 9 to 13."""
    return F.filter(F.split(text, GAP, -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in WINDOW-word windows that occur twice or more in the text.

    Windows are compared as 64-bit hashes. Only a text with a repeated window
    sorts its windows; then the covered words are the sum of steps between
    places of repeated windows, each step WINDOW at most.
    """
    n = F.size(words)
    starts = F.when(n > WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1)))
    hashed = F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW))))[0]

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = F.transform(
            F.array(placed),
            lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: ((k > 0) & F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])), lambda x: x["i"])),
        )[0]
        return F.transform(F.array(twice), lambda p: F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, b: a + b))[0]

    return F.coalesce(F.transform(F.array(hashed), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))[0], F.lit(0))


def _normalised(line: Column) -> Column:
    return F.lower(F.trim(line))


def base_columns(text: Column) -> dict[str, Column]:
    """Arrays that the rules share: the text's words and its lines that hold a word."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {"__words": words_of(text), "__lines": lines}


def _documents(base: DataFrame) -> DataFrame:
    """`base` (host, id, lines) with a column weight, so that a document's rows weigh one in all: a row that repeats adds its surplus as a negative one."""
    repeated = base.groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1")
    surplus = base.join(repeated, "id", "left_semi").dropDuplicates(["id"]).join(repeated, "id")
    return base.select("host", "id", "lines", F.lit(1).cast("long").alias("weight")).unionByName(surplus.select("host", "id", "lines", (1 - F.col("copies")).alias("weight")))


def _boilerplate(base: DataFrame, least_docs: int, share: float) -> DataFrame:
    """(key): hash of host and line, of lines that more than the host's limit of distinct documents hold."""
    documents = _documents(base)
    held = documents.select("host", "weight", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counts = held.groupBy("host", "line").agg(F.sum("weight").alias("docs")).where(F.col("docs") > least_docs)
    limits = documents.groupBy("host").agg(F.greatest(F.lit(least_docs), F.floor(F.sum("weight") * share)).alias("limit"))
    return counts.join(limits, counts.host.eqNullSafe(limits.host)).where("docs > limit").select(F.xxhash64(counts.host, F.col("line")).alias("key"))


def _lost(base: DataFrame, frequent: DataFrame) -> DataFrame:
    """(id, lost, gone): words in boilerplate lines of all rows of a document, and the hashes of those lines."""
    lines = base.select("host", "id", F.explode("lines").alias("l")).select("id", "l.line", "l.n", F.xxhash64("host", "l.line").alias("key"))
    return lines.join(frequent, "key", "left_semi").groupBy("id").agg(F.sum("n").alias("lost"), F.collect_set("line").alias("gone"))


def _document_id(doc_id: Column, host: Column, text: Column) -> Column:
    """Hash of a document's id, host and text; a null id is not a null host."""
    return F.xxhash64(doc_id.cast("string"), doc_id.isNull(), host, host.isNull(), text)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    host = F.col("source").cast("string")
    rows = docs.select("doc_id", host.alias("host"), text.alias("text")).withColumns(base_columns(F.col("text")))
    return rows.withColumn("id", _document_id(F.col("doc_id"), F.col("host"), F.col("text")))


def _hashed_lines() -> Column:
    return F.transform("__lines", lambda x: F.struct(F.xxhash64(_normalised(x)).alias("line"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))).alias("lines")


def quality_rules(docs: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE_OF_DOCS) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): base figures, boilerplate and verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_boilerplate_words (words of the
    document in boilerplate lines of its host). A null text counts as empty; a
    null source is a host of its own. Rows alike in doc_id, source and text are
    one document to the line counts, and each is returned. Empty tables give empty results.
    """
    rows = _rows(docs)
    n_words = F.size("__words").cast("long")
    base = rows.select(
        "doc_id", "host", "id",
        n_words.alias("n_words"),
        F.char_length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).cast("long").alias("n_repeat_words"),
        _hashed_lines(),
    )
    base = written(base)
    lost = _lost(base, _boilerplate(base, least_docs, share))
    # every row of a repeated document adds its lines' words
    copies = base.groupBy("id").agg(F.count("*").alias("copies"))
    lost = lost.join(copies, "id").select("id", (F.col("lost") / F.col("copies")).cast("long").alias("n_boilerplate_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = base.join(lost, "id", "left").withColumn("n_boilerplate_words", F.coalesce("n_boilerplate_words", F.lit(0).cast("long"))).withColumn("base_failed", failed)
    depleted = F.col("n_boilerplate_words") > MOST_LOST * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), "n_boilerplate_words")


def without_boilerplate(docs: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE_OF_DOCS) -> DataFrame:
    """`docs` (doc_id, text, source, ...) without the boilerplate lines of their hosts, all columns kept; depleted documents go.

    A document without such a line stays as it is, null and empty texts too. The
    base rules are not applied. An n_chars column, if there is one, is set to
    the new length. Repeated rows are one document to the counts, and each is returned.
    """
    base = written(_rows(docs).select("host", "id", F.size("__words").alias("n_words"), _hashed_lines()))
    lost = _lost(base, _boilerplate(base, least_docs, share))
    facts = base.groupBy("id").agg(F.count("*").alias("copies"), F.max("n_words").alias("n_words"))
    verdict = lost.join(facts, "id").select("id", "gone", (F.col("lost") / F.col("copies") > MOST_LOST * F.col("n_words")).alias("depleted"))
    # the whole row travels as one column, so that no name of its own can clash
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(_document_id(docs["doc_id"], docs["source"].cast("string"), text).alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    both = rows.join(verdict, "id", "left").where(~F.coalesce("depleted", F.lit(False)))
    left = F.filter(F.split(F.col("row.text").cast("string"), "\n", -1), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains("gone", F.xxhash64(_normalised(x)))))
    both = both.withColumn("new", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n")))
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.char_length("new")).cast(docs.schema["n_chars"].dataType)
    return both.select([changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
