"""Search over sessions: query parsing, postings, ranking, pages.

A query table goes through the same plan as a single query. What a query asks
for is a small table of terms: those of its clauses (operators.query_text) with
their weights, and those of the vocabulary that its words match within one edit.
They meet the postings by one equi-join; phrases are found by the positions that
postings carry; and one aggregate per (query, session) gives the score. Ranking
reads keys, directories and times; wide columns are fetched for the rows of the
page. A SearchIndex is kept beside the sessions (operators.search_index) and
passed in; without one it is written once for the call.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from sessionlake.functions.text import tokens
from sessionlake.operators.filters import UNIT_SECONDS, agent_filter, all_of, dir_filter, filter_matches
from sessionlake.operators import query_text
from sessionlake.operators.search_index import FUZZY_LEAST_CHARS, SearchIndex, build_index, cells_of_fuzzy, live, merge_segments, open_index, postings, update_index, vocabulary  # noqa: F401
from sessionlake.sources.scratch import scratch

K1, B = 1.2, 0.75
EXACT_WEIGHT = 5.0
_KEYWORD = r'(-?)(agent|dir|date):(?:"([^"]+)"|(\S+))'
#: Rows up to which what queries ask for is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Rows of asked terms that the driver takes up at once; more are written.
LOCAL_ROWS = 20_000
#: Queries up to which what they ask for is made on the driver.
FEW_QUERIES = 200
#: Words up to which each is compared with the terms by an expression of its own; more meet them by deletion keys.
FEW_WORDS = 16
#: Fields whose terms a word may match within an edit.
FUZZY_FIELDS = ("title", "content")
#: Tasks among which sessions of one agent are dealt to queries without a text.
CELLS = 64
#: A date span over this many seconds is no filter.
_MOST_SECONDS = 60_000_000_000


# -- query log ---------------------------------------------------------------


def _split_values(value: Column, negated: Column) -> tuple[Column, Column]:
    """(include, exclude) of a comma list: ! excludes a value, a leading - all."""
    pieces = F.filter(F.transform(F.split(value, ","), lambda v: F.trim(v)), lambda v: v != "")
    marked = F.transform(pieces, lambda v: F.struct((F.startswith(v, F.lit("!")) | negated).alias("no"), F.regexp_replace(v, "^!", "").alias("v")))
    return F.transform(F.filter(marked, lambda x: ~x["no"]), lambda x: x["v"]), F.transform(F.filter(marked, lambda x: x["no"]), lambda x: x["v"])


def parse_queries(queries: DataFrame, as_of: dt.datetime) -> DataFrame:
    """`queries` (query_id, query) with text, agent, dir and date filters.

    agent_include/exclude and dir_include/exclude are arrays (empty: no
    filter); date is a struct (op, value, cutoff, until, negated) or null. The
    last keyword of a kind counts; a last date that cannot be read clears the
    filter. Keywords are found anywhere, even behind other characters.
    """
    hits = F.transform(
        F.arrays_zip(*[F.regexp_extract_all("query", F.lit(_KEYWORD), F.lit(g)).alias(f"g{g}") for g in range(1, 5)]),
        lambda x: F.struct((x["g1"] == "-").alias("no"), x["g2"].alias("key"), F.when(x["g3"] != "", x["g3"]).otherwise(x["g4"]).alias("value")),
    )
    df = queries.withColumn("__hits", hits)

    def last(key: str) -> Column:
        return F.try_element_at(F.filter("__hits", lambda x: x["key"] == key), F.lit(-1))

    df = df.withColumns({f"__{key}": last(key) for key in ("agent", "dir", "date")})
    text = F.trim(F.regexp_replace(F.regexp_replace("query", _KEYWORD, ""), r"\s+", " "))
    none = F.array().cast("array<string>")
    columns = [text.alias("text")]
    for key in ("agent", "dir"):
        value = F.lower(f"__{key}.value") if key == "agent" else F.col(f"__{key}.value")
        include, exclude = _split_values(value, F.col(f"__{key}.no"))
        columns += [F.coalesce(include, none).alias(f"{key}_include"), F.coalesce(exclude, none).alias(f"{key}_exclude")]
    raw = F.col("__date.value")
    negated = F.col("__date.no") | F.startswith(raw, F.lit("!"))
    word = F.lower(F.trim(F.regexp_replace(raw, "^!", "")))
    return df.select("query_id", "query", *columns, _date_struct(word, negated, as_of).alias("date"))


def _date_struct(word: Column, negated: Column, as_of: dt.datetime) -> Column:
    now = F.lit(as_of).cast("timestamp")
    midnight = F.to_date(now).cast("timestamp")
    unit = F.regexp_extract(word, r"^[<>]?\d+(m|h|d|w|mo|y)$", 1)
    number = F.regexp_extract(word, r"^[<>]?(\d+)", 1).try_cast("double")
    per = F.lit(None).cast("double")
    for u, s in UNIT_SECONDS.items():
        per = F.when(unit == u, F.lit(float(s))).otherwise(per)
    seconds = number * per
    relative = (unit != "") & (seconds <= _MOST_SECONDS)
    ago = F.timestamp_micros((F.unix_micros(now) - seconds * 1_000_000).cast("long"))
    none = F.lit(None).cast("timestamp")
    cutoff = (
        F.when(word == "today", midnight).when(word == "yesterday", F.date_sub(F.to_date(now), 1).cast("timestamp"))
        .when(word == "week", now - F.expr("interval 7 days")).when(word == "month", now - F.expr("interval 30 days")).when(relative, ago)
    )
    op = F.when(word.isin("today", "yesterday"), "exact").when(relative & F.startswith(word, F.lit(">")), "greater").otherwise("less")
    return F.when(cutoff.isNotNull(), F.struct(op.alias("op"), word.alias("value"), cutoff.alias("cutoff"), F.when(word == "yesterday", midnight).otherwise(none).alias("until"), negated.alias("negated")))


def override(parsed: DataFrame, agent: str | None = None, directory: str | None = None) -> DataFrame:
    """Explicit agent and directory arguments in place of the parsed ones."""
    none = F.array().cast("array<string>")
    for key, value in (("agent", agent.lower() if agent else None), ("dir", directory)):
        if value:
            parsed = parsed.withColumn(f"{key}_include", F.array(F.lit(value))).withColumn(f"{key}_exclude", none)
    return parsed


def passes_filters(parsed_date: str = "date") -> Column:
    """Whether a session joined to a parsed query passes the query's filters."""
    d, ts = F.col(parsed_date), F.col("timestamp")
    inside = F.when(d["op"] == "greater", ts < d["cutoff"]).otherwise((ts >= d["cutoff"]) & (d["until"].isNull() | (ts < d["until"])))
    dated = F.when(d.isNull(), True).when(d["negated"], ~inside).otherwise(inside)
    return filter_matches(F.col("agent"), F.col("agent_include"), F.col("agent_exclude")) & filter_matches(F.col("directory"), F.col("dir_include"), F.col("dir_exclude"), substring=True) & dated


# -- what queries ask for ------------------------------------------------------


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Typed:
    """What texts ask for: clauses, the words of the fuzzy part with the number that must match, keys of those words, and the rules of clauses.

    terms and key_list are the same on the driver, if the queries are few.
    """

    clauses: DataFrame
    words: DataFrame
    keys: DataFrame
    rules: DataFrame
    terms: list[str] | None = None
    key_list: list[str] | None = None


def _local(spark: SparkSession, schema: str, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(_parse_datatype_string(schema))), schema)


_CLAUSES = "query_id {0}, clause int, group int, sign string, field string, raw string, terms array<string>"
_RULES = "query_id {0}, must array<int>, nots array<int>, shoulds array<int>, groups array<struct<group: int, must: array<int>, nots: array<int>>>"


def typed_queries(parsed: DataFrame) -> Typed:
    """What `parsed` (query_id, text) asks for: of a few queries on the driver, of more in written tables."""
    spark, kind = parsed.sparkSession, dict(parsed.dtypes)["query_id"]
    cs = query_text.with_groups(query_text.clause_list(F.col("text")))
    whole = parsed.select("query_id", cs.alias("cs"), _fuzzy_list(F.col("text")).alias("ws"))
    whole = whole.select("query_id", "cs", F.struct(*query_text.rule(F.col("cs"))).alias("rule"), F.transform("ws", lambda w: F.struct(w["word"].alias("word"), w["times"].alias("times"), cells_of_fuzzy(w["word"]).alias("keys"))).alias("ws"))
    rows = whole.limit(FEW_QUERIES + 1).collect()
    if len(rows) > FEW_QUERIES:
        whole = _kept(whole, "typed")
        need = F.aggregate("ws", F.lit(0).cast("long"), lambda n, w: n + w["times"]).alias("need")
        words = whole.select("query_id", need, F.inline("ws")).select("query_id", "need", "word", "times", "keys")
        return Typed(whole.select("query_id", F.inline("cs")), words.drop("keys"), words.select("word", F.explode("keys").alias("key")).distinct(), whole.select("query_id", "rule.*"))
    found = [r.asDict(recursive=True) for r in rows]
    clauses = [{"query_id": r["query_id"], **c} for r in found for c in r["cs"]]
    words = [{"query_id": r["query_id"], "need": sum(w["times"] for w in r["ws"]), **w} for r in found for w in r["ws"]]
    keys = sorted({(w["word"], k) for w in words for k in w["keys"]})
    return Typed(
        _local(spark, _CLAUSES.format(kind), clauses),
        _local(spark, f"query_id {kind}, need bigint, word string, times bigint", [{k: v for k, v in w.items() if k != "keys"} for w in words]),
        _local(spark, "word string, key string", [{"word": w, "key": k} for w, k in keys]),
        _local(spark, _RULES.format(kind), [{"query_id": r["query_id"], **r["rule"]} for r in found]),
        sorted({t for c in clauses for t in (*c["terms"], c["raw"])}), sorted({k for _, k in keys}),
    )


def exact_terms(typed: Typed, index: SearchIndex) -> DataFrame:
    """(query_id, clause, group, field, term, k, n, gain, avg_len): the terms of clauses in the fields where all of a clause's terms occur.

    k is the term's place in its clause of n terms; gain is the sum of the
    terms' inverse frequencies, 0 where the clause forbids.
    """
    every = typed.clauses.withColumn("field", F.explode(F.when(F.col("field") != "", F.array("field")).otherwise(F.array(*[F.lit(f) for f in query_text.FIELDS]))))
    whole = F.col("field") == "directory"
    each = every.select("query_id", "clause", "group", "sign", "field", F.posexplode(F.when(whole, F.array("raw")).otherwise(F.col("terms"))).alias("k", "term"), F.when(whole, 1).otherwise(F.size("terms")).alias("n"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    met = index.vocabulary_of(each.select("term") if typed.terms is None else typed.terms).join(each, ["field", "term"]).join(F.broadcast(index.totals), "field").withColumn("idf", idf)
    own = met.groupBy("query_id", "clause", "group", "sign", "field", "n", "avg_len").agg(F.sum("idf").alias("gain"), F.collect_list(F.struct("k", "term")).alias("found")).where(F.size("found") == F.col("n"))
    gain = F.when(F.col("sign") == "-", 0.0).otherwise(F.col("gain"))
    return own.select("query_id", "clause", "group", "field", "n", gain.alias("gain"), "avg_len", F.inline("found")).select("query_id", "clause", "group", "field", "term", "k", "n", "gain", "avg_len")


def _bm25_score() -> Column:
    tf = F.col("tf")
    return F.col("gain") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))


def phrase_hits(post: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, clause, group, agent, id, exact) of phrases `asked`: their terms at places that follow one another in a field.

    Each term's positions are shifted back by its place in the phrase; what all
    of them share are the phrase's beginnings, whose number is its frequency.
    """
    met = post.join(asked, ["field", "term"]).withColumn("at", F.transform("positions", lambda p: p - F.col("k")))
    key = ["query_id", "clause", "group", "field", "agent", "id"]
    held = met.groupBy(*key).agg(F.collect_list("at").alias("at"), *[F.any_value(c).alias(c) for c in ("n", "gain", "avg_len", "len")]).where(F.size("at") == F.col("n"))
    shared = F.aggregate(F.slice("at", F.lit(2), F.size("at")), F.element_at("at", F.lit(1)), lambda x, y: F.array_intersect(x, y))
    return held.withColumn("tf", F.size(shared).cast("long")).where("tf > 0").select("query_id", "clause", "group", "agent", "id", _bm25_score().alias("exact"))


def _exact_score() -> Column:
    """Sum of the matching clauses' scores if the query's clauses match, else null, over a session's clauses joined to the query's rules."""
    groups = query_text.matched_groups(F.col("clauses"))
    joined = F.aggregate(F.filter("grouped", lambda g: F.array_contains(groups, g["group"])), F.lit(0.0), lambda total, g: total + g["exact"])
    return F.when(query_text.passes(F.col("clauses"), groups), F.coalesce("alone", F.lit(0.0)) + joined)


def _met() -> tuple[Column, Column, Column]:
    """What an aggregate per (query, session) makes of its hits (clause, group, exact)."""
    apart = F.col("group").isNull()
    return F.collect_set("clause").alias("clauses"), F.sum(F.when(apart, F.col("exact"))).alias("alone"), F.collect_list(F.when(~apart, F.struct("group", "exact"))).alias("grouped")


def bm25(parsed: DataFrame, index: SearchIndex) -> DataFrame:
    """(query_id, agent, id, score) of the sessions that the clauses of each query match, fuzzy matches and directories apart."""
    typed = typed_queries(parsed)
    asked = _asked(exact_terms(typed, index))
    hits = asked.single(index).select("query_id", "clause", "group", "agent", "id", _bm25_score().alias("exact"))
    hits = hits.unionByName(asked.phrased(index)) if asked.phrases else hits
    met = hits.groupBy("query_id", "agent", "id").agg(*_met()).join(typed.rules, "query_id")
    return met.select("query_id", "agent", "id", _exact_score().alias("score")).where("score > 0")


@dataclass(frozen=True)
class Asked:
    """Rows of terms that queries ask for; how many, and of them of phrases; the terms on the driver, if they are few."""

    rows: DataFrame
    count: int
    phrases: int
    terms: list[str] | None

    def single(self, index: SearchIndex, hidden: bool = False) -> DataFrame:
        """Postings joined to the rows that ask for one term; with `hidden`, those that later segments hide too, each with its segment."""
        rows = self.rows.where("n = 1")
        terms = rows.select("term") if self.terms is None else self.terms
        return (index.postings_named(terms) if hidden else index.postings_of(terms)).join(_small(rows, self.count), ["field", "term"])

    def phrased(self, index: SearchIndex) -> DataFrame:
        rows = self.rows.where("n > 1")
        return phrase_hits(index.postings_of(rows.select("term")), _small(rows, self.phrases))


def _asked(rows: DataFrame) -> Asked:
    found = rows.limit(LOCAL_ROWS + 1).toArrow()
    if found.num_rows <= LOCAL_ROWS:
        return Asked(rows.sparkSession.createDataFrame(found, rows.schema), found.num_rows, sum(n > 1 for n in found.column("n").to_pylist()), found.column("term").to_pylist())
    kept = _kept(rows, "asked")
    counts = kept.agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 1).alias("phrases")).first()
    return Asked(kept, counts.rows, counts.phrases, None)


def within_one_edit_prefix(word: Column, term: Column) -> Column:
    """Whether a prefix of `term` is at most one insertion, deletion, substitution or swap from `word`.

    Everything turns on the first place where they differ.
    """
    differs = F.array_position(F.zip_with(F.split(word, ""), F.split(term, ""), lambda a, b: a.eqNullSafe(b)), False)
    p = F.coalesce(F.nullif(differs, F.lit(0)), F.least(F.char_length(word), F.char_length(term)) + 1).cast("int")

    def rest(c: Column, start: Column) -> Column:
        return F.substring(c, start, F.lit(1 << 30))

    has = F.char_length(term) >= p
    return (
        (p > F.char_length(word))
        | (has & F.startswith(rest(term, p + 1), rest(word, p + 1)))
        | (has & F.startswith(rest(term, p + 1), rest(word, p)))
        | F.startswith(rest(term, p), rest(word, p + 1))
        | ((F.substring(term, p + 1, F.lit(1)) == F.substring(word, p, F.lit(1))) & (F.substring(word, p + 1, F.lit(1)) == F.substring(term, p, F.lit(1))) & (F.char_length(word) > p) & F.startswith(rest(term, p + 2), rest(word, p + 2)))
    )


def _may_begin(word: str, term: Column) -> Column:
    """A cheap test that every term passes that begins within one edit of `word`: one half of the word is whole, or its middle letters are swapped."""
    h = len(word) // 2
    swapped = word[: h - 1] + word[h] + word[h - 1]
    found = F.startswith(term, F.lit(word[:h])) | F.startswith(term, F.lit(swapped))
    for shift in (-1, 0, 1):
        found = found | (F.substring(term, h + 1 + shift, len(word) - h) == word[h:])
    return found


def fuzzy_terms(words: DataFrame, index: SearchIndex, keys: DataFrame | None = None, key_list: list[str] | None = None) -> DataFrame:
    """(word, field, term) of `words` (word) whose word matches a prefix of the term within one edit.

    With the index's table of fuzzy keys, words meet terms on keys that lack one
    character, and the vocabulary is not read. Without it a few words are
    compared with the vocabulary in one pass, and more of them meet it on keys
    made for the call. The vocabulary is distinct terms, never the tokens of the
    corpus. `keys` (word, key), and their list, may be given.
    """
    # a term has under 40 bytes, so no longer word can match
    words = words.select("word").where(F.char_length("word") <= 41).distinct()
    if index.fuzzy_keys is None:
        terms = index.vocabulary.where(F.col("field").isin(*FUZZY_FIELDS)).select("field", "term")
        some = [r.word for r in words.limit(FEW_WORDS + 1).collect()]
        if len(some) <= FEW_WORDS and all(len(w) >= FUZZY_LEAST_CHARS for w in some):
            met = F.array(*[F.when(_may_begin(w, F.col("term")), F.lit(w)) for w in sorted(some)]).cast("array<string>")
            found = terms.select("field", "term", F.explode(F.array_compact(met)).alias("word"))
            return found.where(within_one_edit_prefix(F.col("word"), F.col("term"))).select("word", "field", "term")
    keys = word_keys(words) if keys is None else keys
    if key_list is None:
        keys = _kept(keys, "keys")
        keys = _small(keys, keys.count())
    found = index.terms_near(keys.select("key") if key_list is None else key_list).join(keys, "key")
    return found.where(within_one_edit_prefix(F.col("word"), F.col("term"))).select("word", "field", "term").distinct()


def word_keys(words: DataFrame) -> DataFrame:
    """(word, key): the keys under which terms near a word are filed."""
    return words.select("word", F.explode(cells_of_fuzzy(F.col("word"))).alias("key"))


def _fuzzy_list(text: Column) -> Column:
    """Array of (word, times): words of three or more characters, lower-cased, and how often each comes."""
    words = F.transform(F.filter(F.split(text, r"\s+", -1), lambda w: F.char_length(w) >= FUZZY_LEAST_CHARS), lambda w: F.lower(w))
    return F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("word"), F.size(F.filter(words, lambda x: x == w)).cast("long").alias("times")))


def fuzzy_words(parsed: DataFrame) -> DataFrame:
    """(query_id, need, word, times): words of three or more characters, lower-cased; need is their number."""
    words = parsed.select("query_id", _fuzzy_list(F.col("text")).alias("ws"))
    return words.select("query_id", F.aggregate("ws", F.lit(0).cast("long"), lambda n, w: n + w["times"]).alias("need"), F.inline("ws"))


def _all_words(marks: Column, need: Column) -> Column:
    """Sum over a query's word and field matches if all its words match, else null; marks: set of (word, field, times)."""
    found = F.aggregate(F.array_distinct(F.transform(marks, lambda m: F.struct(m["word"].alias("w"), m["times"].alias("n")))), F.lit(0).cast("long"), lambda n, m: n + m["n"])
    return F.when((F.size(marks) > 0) & (found == need), F.aggregate(marks, F.lit(0.0), lambda n, m: n + m["times"]))


def fuzzy(parsed: DataFrame, index: SearchIndex) -> DataFrame:
    """(query_id, agent, id, score): every word of three or more characters matches in title or content; 1 per word and field."""
    words = fuzzy_words(parsed)
    asked = fuzzy_terms(words, index).join(words, "word")
    hit = live(index.postings, index.removed).join(asked, ["field", "term"]).groupBy("query_id", "agent", "id").agg(F.max("need").alias("need"), F.collect_set(F.struct("word", "field", "times")).alias("marks"))
    return hit.select("query_id", "agent", "id", _all_words(F.col("marks"), F.col("need")).alias("score")).where("score is not null")


def dir_text(parsed: DataFrame, sessions: DataFrame) -> DataFrame:
    """(query_id, agent, id, score): a one-word text of three or more characters in the directory; constant 1.

    Needles meet the distinct directories on three characters, then are looked for.
    """
    one = parsed.where((F.char_length("text") >= 3) & ~F.contains("text", F.lit(" "))).select("query_id", F.lower("text").alias("needle"))
    one = one.withColumn("gram", F.substring("needle", 1, 3))
    dirs = sessions.select("directory").distinct().withColumn("low", F.lower("directory")).where(F.char_length("low") >= 3)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("low") - 2), lambda i: F.substring("low", i, F.lit(3))))
    hit = dirs.withColumn("gram", F.explode(grams)).join(one, "gram").where(F.contains("low", F.col("needle"))).select("query_id", "directory")
    return sessions.select("agent", "id", "directory").join(hit, "directory").select("query_id", "agent", "id", F.lit(1.0).alias("score"))


def search_scores(parsed: DataFrame, sessions: DataFrame, index: SearchIndex | None = None) -> DataFrame:
    """(query_id, agent, id, score) of all sessions that a query's text matches, filters not applied."""
    index = build_index(sessions) if index is None else index
    typed = typed_queries(parsed)
    mark = "struct<word: string, field: string, times: bigint>"
    null = F.lit(None)
    exact = exact_terms(typed, index).select("*", null.cast("long").alias("need"), null.cast(mark).alias("mark"))
    close = fuzzy_terms(typed.words, index, typed.keys, typed.key_list).join(typed.words, "word")
    close = close.select(
        "query_id", null.cast("int").alias("clause"), null.cast("int").alias("group"), "field", "term", F.lit(0).alias("k"), F.lit(1).alias("n"), F.lit(0.0).alias("gain"), F.lit(1.0).alias("avg_len"),
        "need", F.struct("word", "field", "times").cast(mark).alias("mark"),
    )
    asked = _asked(exact.unionByName(close))
    columns = {"clause": "int", "group": "int", "exact": "double", "need": "bigint", "times": "bigint", "fields": "bigint", "dir": "double"}

    def hit(df: DataFrame, **own: Column) -> DataFrame:
        return df.select("query_id", "agent", "id", *[own.get(c, null).cast(t).alias(c) for c, t in columns.items()])

    # A word is near many terms of a session: they become one row before anything is collected, in an aggregate of plain
    # numbers. What later segments hide is dropped from these rows, not from the postings.
    hides = index.removed is not None
    key = ["query_id", "agent", "id", *(["segment"] if hides else []), "clause", "group", "word"]
    met = asked.single(index, hides).withColumn("word", F.col("mark.word"))
    met = met.groupBy(*key).agg(
        F.sum(F.when(F.col("clause").isNotNull(), _bm25_score())).alias("exact"), F.max("need").alias("need"), F.max("mark.times").alias("times"),
        *[F.max(F.when(F.col("mark.field") == f, 1).otherwise(0)).alias(f) for f in FUZZY_FIELDS],
    )
    met = live(met, index.removed) if hides else met
    hits = hit(met, **{c: F.col(c) for c in ("clause", "group", "exact", "need", "times")}, fields=sum((F.col(f) for f in FUZZY_FIELDS), F.lit(0)))
    if asked.phrases:
        hits = hits.unionByName(hit(asked.phrased(index), clause=F.col("clause"), group=F.col("group"), exact=F.col("exact")))
    hits = hits.unionByName(hit(dir_text(parsed, index.slim), dir=F.col("score")))
    marks = F.sum(F.col("times") * F.col("fields"))
    every = hits.groupBy("query_id", "agent", "id").agg(*_met(), F.when(F.sum("times") == F.max("need"), marks.cast("double")).alias("close"), F.sum("dir").alias("dir"))
    zero = F.lit(0.0)
    every = every.join(typed.rules, "query_id", "left")
    total = F.coalesce(_exact_score(), zero) * EXACT_WEIGHT + F.coalesce("close", zero) + F.coalesce("dir", zero)
    # a session that only some of the words match within an edit, or that a clause forbids, is no match
    return every.withColumn("score", total).where("score > 0").select("query_id", "agent", "id", "score")


def phrase_filter(sessions: DataFrame, phrase: str) -> DataFrame:
    """Sessions with the phrase's words next to each other in title or content.

    A word that is not in the text drops the row before positions are compared.
    """
    terms = tokens(F.lit(phrase))

    def adjacent(field: str) -> Column:
        p = F.col("__p")

        def inside(t: Column) -> Column:
            places = F.sequence(F.lit(1), F.greatest(F.size(t) - F.size(p) + 1, F.lit(1)))
            return F.exists(places, lambda i: F.slice(t, i, F.size(p)) == p)

        return F.exists(F.array(tokens(F.col(field))), lambda t: F.when(F.size(F.array_except(p, t)) == 0, inside(t)).otherwise(False))

    return sessions.withColumn("__p", terms).where((F.size("__p") > 0) & (adjacent("title") | adjacent("content"))).drop("__p")


# -- results -----------------------------------------------------------------


def one_query(spark: SparkSession, text: str, as_of: dt.datetime) -> DataFrame:
    return parse_queries(_local(spark, "query_id int, query string", [{"query_id": 0, "query": text}]), as_of)


def _literal_filters(row) -> Column | None:
    """The filters of one parsed query as a predicate that reaches the scan."""
    dated = None
    if (d := row.date) is not None:
        ts, cutoff = F.col("timestamp"), F.lit(d.cutoff).cast("timestamp")
        dated = ts < cutoff if d.op == "greater" else ts >= cutoff
        if d.until is not None and d.op != "greater":
            dated = dated & (ts < F.lit(d.until).cast("timestamp"))
        dated = ~dated if d.negated else dated
    return all_of(agent_filter(row.agent_include, row.agent_exclude), dir_filter(row.dir_include, row.dir_exclude), dated)


def search(sessions: DataFrame, query: str, as_of: dt.datetime, limit: int = 50, offset: int = 0, index: SearchIndex | None = None) -> DataFrame:
    """Best sessions of one query: by score, then time, agent, id; without a text, the latest.

    Sessions are ranked by their keys; the other columns are fetched for the page's rows.
    """
    parsed = one_query(sessions.sparkSession, query, as_of)
    row = parsed.first()
    passes = _literal_filters(row)
    order = [F.desc("timestamp"), "agent", "id"]
    if not row.text:
        slim = sessions.select("agent", "id", "directory", "timestamp") if index is None else index.slim
        ranked = slim.where(passes) if passes is not None else slim
        page = ranked.select("agent", "id", "timestamp", F.lit(None).cast("double").alias("score")).orderBy(*order)
    else:
        index = build_index(sessions) if index is None else index
        kept = index.slim.where(passes) if passes is not None else index.slim
        # parsed once: the plans below start from its text
        typed = _local(sessions.sparkSession, "query_id int, text string", [{"query_id": 0, "text": row.text}])
        page = search_scores(typed, sessions, index).join(kept.select("agent", "id", "timestamp"), ["agent", "id"])
        order = [F.desc(F.round("score", 6)), *order]
        page = page.select("agent", "id", "timestamp", "score").orderBy(*order)
    page = page.offset(offset).limit(limit)
    return sessions.join(F.broadcast(page.select("agent", "id", "score")), ["agent", "id"]).select(*sessions.columns, "score").orderBy(*order)


FILTERS = ("agent_include", "agent_exclude", "dir_include", "dir_exclude", "date")


def _listed(parsed: DataFrame, slim: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, agent, id, timestamp, score 0) of the sessions that pass the filters of queries without a text; of the k latest for each, if asked.

    Queries with the same filters are one. Filters meet sessions by equality of
    agent (any, where none is asked for) and of a cell of the session's key.
    """
    asked = parsed.where("text = ''").select("query_id", *FILTERS).withColumn("filter", F.xxhash64(*FILTERS))
    distinct = asked.groupBy("filter").agg(*[F.any_value(c).alias(c) for c in FILTERS])
    some = F.when(F.size("agent_include") > 0, F.array_distinct("agent_include")).otherwise(F.array(F.lit("*")))
    dealt = distinct.withColumn("who", F.explode(some)).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    rows = slim.withColumn("who", F.explode(F.array(F.col("agent"), F.lit("*")))).withColumn("cell", F.pmod(F.xxhash64("agent", "id"), F.lit(CELLS)).cast("int"))
    met = rows.join(dealt, ["who", "cell"]).where(passes_filters()).select("filter", "agent", "id", "timestamp")
    if k is not None:
        w = Window.partitionBy("filter").orderBy(F.desc("timestamp"), "agent", "id")
        met = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    return met.join(asked.select("query_id", "filter"), "filter").select("query_id", "agent", "id", "timestamp", F.lit(0.0).alias("score"))


def matches(parsed: DataFrame, sessions: DataFrame, index: SearchIndex | None = None, k: int | None = None) -> DataFrame:
    """(query_id, agent, id, timestamp, score) of the sessions that match each query, text and filters; score 0 without a text.

    All of them, or with k at least the k best of each query.
    """
    index = build_index(sessions) if index is None else index
    typed = parsed.where("text <> ''")
    by_text = search_scores(typed, sessions, index).join(index.slim, ["agent", "id"]).join(typed.select("query_id", *FILTERS), "query_id").where(passes_filters())
    columns = ["query_id", "agent", "id", "timestamp", "score"]
    return by_text.select(columns).unionByName(_listed(parsed, index.slim, k).select(columns))


def search_batch(queries: DataFrame, sessions: DataFrame, as_of: dt.datetime, k: int = 10, index: SearchIndex | None = None) -> DataFrame:
    """(query_id, rank, agent, id, score): the k best of each query of a table."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), F.desc("timestamp"), "agent", "id")
    found = matches(parse_queries(queries, as_of), sessions, index, k)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "agent", "id", F.round("score", 6).alias("score"))


def page_meta(pages: DataFrame) -> DataFrame:
    """`pages` (total, offset, limit) with state, returned and next_offset; a null limit asks for all."""
    limit = F.coalesce("limit", F.greatest(F.col("total") - F.col("offset"), F.lit(0)))
    df = pages.withColumn("limit", limit)
    df = df.withColumn("returned", F.greatest(F.least("limit", F.col("total") - F.col("offset")), F.lit(0)))
    more = F.col("offset") + F.col("returned") < F.col("total")
    state = F.when((F.col("total") > 0) & (F.col("offset") >= F.col("total")), "past_end").when(more, "more").otherwise("complete")
    return df.withColumn("state", state).withColumn("next_offset", F.when(more, F.col("offset") + F.col("returned")))


def result_json(page: DataFrame, total: int, offset: int, limit: int) -> DataFrame:
    """One row `json`: the envelope of a page (at most `limit` rows) in the order of searches, without content, mtime and yolo."""
    fields = [c for c in page.columns if c not in ("content", "mtime", "yolo", "score", "rank", "resume_command")]
    if "resume_command" in page.columns:
        fields.append("resume_command")
    # the order is made here: a sort of the page does not outlive a join
    score = -F.round("score", 6) if "score" in page.columns else F.lit(0.0)
    item = F.struct(score.alias("score"), (-F.unix_micros("timestamp")).alias("time"), "agent", "id", F.struct(*fields).alias("s"))
    rows = page.agg(F.array_sort(F.collect_list(item)).alias("x")).select(F.transform("x", lambda r: r["s"]).alias("sessions"))
    meta = page_meta(rows.select(F.lit(total).cast("long").alias("total"), F.lit(offset).cast("long").alias("offset"), F.lit(limit).cast("long").alias("limit"), "sessions"))
    body = F.struct(F.lit(1).alias("schema_version"), "sessions", F.struct("state", "total", "offset", "limit", "returned", "next_offset").alias("meta"))
    return meta.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
