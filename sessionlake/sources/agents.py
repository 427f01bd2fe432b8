"""One ingestion job per source format: files or landed tables to (messages, attributes), then sessions.

messages: agent, session_id, seq, role, text (null where a record only counts
as a turn), ts, counts_as_turn, title_candidate (a user text that may name the
session), yolo. attributes: a row per session with title (resolved but for the
first user text), directory, timestamp, mtime, yolo.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.functions.json import content_texts, get, is_kind, is_strict_json, tool_summaries, typed_texts
from sessionlake.functions.paths import absolute_dir, path_id, uri_to_path
from sessionlake.functions.text import blank_to_null, truncate_title
from sessionlake.functions.times import any_ts, epoch_ts, parse_iso
from sessionlake.model import SESSION_COLUMNS, SESSIONS, configure
from sessionlake.operators.messages import HISTORY_EVENTS, coalesce_chunks, fold_history, fold_rewinds, project_commands, rendered, shell_input, unwrap_request
from sessionlake.operators.refresh import activity_marker, dedupe_sessions, latest_lookup
from sessionlake.sources.scan import RULES, prefer_file, scan_files, scan_json_docs, scan_jsonl
from sessionlake.sources.scratch import scratch

PARTS = 1_000_000  # a record's parts are numbered within its line


@dataclass(frozen=True)
class Rules:
    """What a session's title and survival depend on."""

    limit: int = 100
    word_break: bool = True
    cut_named: bool = True  # whether a stored title is cut as well
    without_user: str | None = None  # title of a session without a user text; None drops it
    needs_text: bool = True  # whether a session without any text is dropped


def _texts(df: DataFrame, keep: Sequence[str], texts: Column, role: Column, turn: Column, candidate: Column, ts: Column | None = None) -> DataFrame:
    """Explode `texts` of each record; a record that counts as a turn but has no text keeps one row with a null text."""
    some = F.when((F.size(texts) > 0) | ~turn, texts).otherwise(F.array(F.lit(None).cast("string")))
    rows = df.select(*keep, "line_no", role.alias("role"), turn.alias("turn"), candidate.alias("candidate"), (F.lit(None).cast("timestamp") if ts is None else ts).alias("ts"), F.posexplode(some).alias("part", "text"))
    return rows.select(*keep, (F.col("line_no").cast("long") * PARTS + F.col("part")).alias("seq"), "role", "text", "ts", (F.col("turn") & (F.col("part") == 0)).alias("counts_as_turn"), (F.col("candidate") & F.col("text").isNotNull()).alias("title_candidate"))


def _messages(agent: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(agent).alias("agent"), "session_id", "seq", "role", "text", "ts", "counts_as_turn", "title_candidate", F.lit(False).alias("yolo"))


def to_sessions(messages: DataFrame, attrs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Sessions of one source: texts in order, title by precedence, dropped where its rules say so."""
    has = F.col("text").isNotNull() & (F.col("text") != "")
    line = F.when(has, F.struct("seq", rendered(F.col("role"), F.col("text")).alias("r")))
    grouped = messages.groupBy("agent", "session_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["r"]), "\n\n").alias("content"),
        F.min_by(F.when(F.col("title_candidate"), F.col("text")), F.when(F.col("title_candidate"), F.col("seq"))).alias("first_user"),
        F.count_if("counts_as_turn").alias("message_count"),
        F.count_if(has).alias("n_texts"),
        F.max("ts").alias("last_ts"),
    )
    joined = attrs.join(grouped, ["agent", "session_id"], "left")
    named = truncate_title(F.col("title"), rules.limit, rules.word_break) if rules.cut_named else F.col("title")
    title = F.coalesce(blank_to_null(named), truncate_title(F.col("first_user"), rules.limit, rules.word_break), F.lit(rules.without_user))
    kept = joined.where(F.col("first_user").isNotNull()) if rules.without_user is None else joined
    if rules.needs_text:
        kept = kept.where(F.coalesce("n_texts", F.lit(0)) > 0)
    out = kept.select(
        F.col("session_id").alias("id"), "agent", title.alias("title"), F.coalesce("directory", F.lit("")).alias("directory"), F.coalesce("timestamp", "last_ts", F.timestamp_micros((F.col("mtime") * 1_000_000).cast("long"))).alias("timestamp"),
        F.coalesce("content", F.lit("")).alias("content"), F.coalesce("message_count", F.lit(0)).alias("message_count"), "mtime", F.coalesce("yolo", F.lit(False)).alias("yolo"),
    )
    return out.select(SESSION_COLUMNS)


def _jsonl(spark: SparkSession, root: str | DataFrame, agent: str, id_rule: str | None = None) -> DataFrame:
    rule = RULES[agent]
    r = scan_jsonl(configure(spark), root, rule.glob)
    if rule.keep and id_rule is None:
        r = r.where(F.col("path").rlike(rule.keep))
    if rule.drop:
        r = r.where(~F.col("path").rlike(rule.drop))
    return r.withColumn("session_id", path_id(F.col("path"), id_rule or rule.id_rule))


def _first(value: Column, order: str = "line_no") -> Column:
    v = F.nullif(value, F.lit(""))
    return F.min_by(v, F.when(v.isNotNull(), F.col(order)))


def _last(value: Column, order: str = "line_no") -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _attrs(agent: str, df: DataFrame, title: Column | None = None, directory: Column | None = None, timestamp: Column | None = None, yolo: Column | None = None, mtime: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(agent).alias("agent"), "session_id", (_none() if title is None else title).alias("title"), (_none() if directory is None else directory).alias("directory"),
        (_none("timestamp") if timestamp is None else timestamp).alias("timestamp"), (F.col("mtime") if mtime is None else mtime).alias("mtime"), (F.lit(False) if yolo is None else yolo).alias("yolo"),
    )


def _file_time() -> Column:
    return F.timestamp_micros((F.col("mtime") * 1_000_000).cast("long"))


def claude_index(spark: SparkSession, root: str | DataFrame) -> DataFrame:
    """(session_id, summary, modified, file_mtime, index_mtime) of the entries with a summary in the folders' sessions-index.json files; of one session the latest file's last."""
    docs = scan_json_docs(configure(spark), root, "sessions-index.json")
    each = docs.select("path", "mtime", F.posexplode(F.try_variant_get("rec", "$.entries", "array<variant>")).alias("n", "e"))
    entry = each.select(
        F.col("e").isNotNull().alias("valid"), _plain(F.col("e"), "$.sessionId").alias("session_id"), F.trim(_plain(F.col("e"), "$.summary")).alias("summary"), _plain(F.col("e"), "$.modified").alias("modified"),
        F.try_variant_get("e", "$.fileMtime", "double").alias("file_mtime"), F.col("mtime").alias("index_mtime"), F.struct("mtime", "path", "n").alias("place"),
    ).where((F.col("session_id") != "") & F.col("summary").rlike(r"\S"))
    fields = ("summary", "modified", "file_mtime", "index_mtime")
    return entry.groupBy("session_id").agg(F.max_by(F.struct(*fields), "place").alias("e")).select("session_id", *[f"e.{c}" for c in fields])


def codex_names(spark: SparkSession, root: str | DataFrame) -> DataFrame:
    """(id, line_no, thread_name, updated_at, valid, deleted) of the lines of session_index.jsonl under `root`; without a time of its own a line has its file's."""
    r = scan_jsonl(configure(spark), root, "session_index.jsonl")
    name, at = F.trim(_plain(F.col("rec"), "$.thread_name")), _plain(F.col("rec"), "$.updated_at")
    known = F.coalesce((_plain(F.col("rec"), "$.id") != "") & name.rlike(r"\S"), F.lit(False))
    return r.select(_plain(F.col("rec"), "$.id").alias("id"), "line_no", name.alias("thread_name"), F.when(parse_iso(at).isNotNull(), at).otherwise(F.col("mtime").cast("decimal(20,6)").cast("string")).alias("updated_at"), known.alias("valid"), F.lit(False).alias("deleted"))


def ingest_claude(spark: SparkSession, root: str | DataFrame, id_rule: str | None = None, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`index` (session_id, summary, modified, file_mtime ms, index_mtime): the sidecars' entries; read from the files under `root` by default."""
    r = _jsonl(spark, root, "claude", id_rule)
    index = claude_index(spark, root) if index is None else index
    kind, content = get(F.col("rec"), "$.type"), F.try_variant_get("rec", "$.message.content", "variant")
    user, string = kind == "user", is_kind(content, "STRING")
    noisy = F.coalesce(get(F.col("rec"), "$.isMeta", "boolean"), F.lit(False)) | F.startswith(get(content, "$"), F.lit("<command")) | F.startswith(get(content, "$"), F.lit("<local-command"))
    texts = F.when(user & string & noisy, F.array().cast("array<string>")).otherwise(content_texts(content))
    first_typed = get(content, "$[0].type") == "text"
    turn = F.when(user, string | F.coalesce(first_typed, F.lit(False))).otherwise(F.size(texts) > 0)
    long = F.when(string, F.char_length(get(content, "$")) > 10).otherwise(True)
    rows = _texts(r.where(kind.isin("user", "assistant")), ["session_id"], texts, F.when(user, "user").otherwise("assistant"), turn, user & long)
    facts = r.groupBy("session_id").agg(F.max("mtime").alias("mtime"), _first(F.when(user, get(F.col("rec"), "$.cwd"))).alias("cwd"), _last(blank_to_null(F.when(kind == "ai-title", get(F.col("rec"), "$.aiTitle")))).alias("ai_title"))
    both = facts.join(index, "session_id", "left")
    marker = F.greatest("mtime", "index_mtime", F.unix_micros(parse_iso(F.col("modified"))) / 1_000_000, F.col("file_mtime") / 1000)
    return _messages("claude", rows), _attrs("claude", both, F.coalesce(blank_to_null(F.col("summary")), "ai_title"), F.col("cwd"), _file_time(), mtime=marker)


def ingest_codex(spark: SparkSession, root: str | DataFrame, id_rule: str | None = None, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`names` (id, line_no, thread_name, updated_at, valid, deleted): the thread index, last entry first; read from the file under `root` by default."""
    r = _jsonl(spark, root, "codex", id_rule)
    names = codex_names(spark, root) if names is None else names
    kind, inner = get(F.col("rec"), "$.type"), get(F.col("rec"), "$.payload.type")
    ids = r.groupBy("session_id").agg(
        F.max("mtime").alias("mtime"), _first(F.when(kind == "session_meta", get(F.col("rec"), "$.payload.id"))).alias("header"), _first(F.when(kind == "session_meta", get(F.col("rec"), "$.payload.cwd"))).alias("cwd"),
        F.coalesce(F.bool_or((kind == "turn_context") & ((get(F.col("rec"), "$.payload.approval_policy") == "never") | (get(F.col("rec"), "$.payload.sandbox_policy.mode") == "danger-full-access"))), F.lit(False)).alias("yolo"),
    )
    role = F.when(kind == "response_item", get(F.col("rec"), "$.payload.role")).when(inner == "user_message", "user").when(inner == "agent_reasoning", "assistant")
    said = F.coalesce(get(F.col("rec"), "$.payload.message"), get(F.col("rec"), "$.payload.text"))
    texts = F.when(kind == "response_item", F.filter(content_texts(F.try_variant_get("rec", "$.payload.content", "variant")), lambda t: ~F.startswith(F.ltrim(t), F.lit("<environment_context>")))).otherwise(F.filter(F.array(said), lambda t: t != ""))
    prompt = (kind == "event_msg") & (inner == "user_message")
    own = r.where((kind.isin("response_item", "event_msg")) & role.isin("user", "assistant"))
    rows = _texts(own, ["session_id"], texts, role, F.coalesce(prompt & (said != ""), F.lit(False)), F.coalesce(prompt, F.lit(False)))
    real = ids.select("session_id", F.coalesce("header", "session_id").alias("real"))
    rows = rows.join(real, "session_id").drop("session_id").withColumnRenamed("real", "session_id")
    facts = ids.withColumn("session_id", F.coalesce("header", "session_id"))
    latest = latest_lookup(names).select(F.col("id").alias("session_id"), "thread_name", "updated_at")
    facts = facts.withColumn("at", _file_time()).join(latest, "session_id", "left").withColumn("mtime", F.greatest("mtime", F.unix_micros(any_ts(F.col("updated_at"))) / 1_000_000))
    return _messages("codex", rows), _attrs("codex", facts, F.col("thread_name"), F.col("cwd"), F.col("at"), F.col("yolo"))


def ingest_copilot_cli(spark: SparkSession, root: str | DataFrame, id_rule: str | None = None) -> tuple[DataFrame, DataFrame]:
    r = _jsonl(spark, root, "copilot-cli", id_rule)
    kind = get(F.col("rec"), "$.type")

    def data(p: str) -> Column:
        return get(F.col("rec"), f"$.data.{p}")

    trust = F.nullif(F.regexp_extract(data("message"), r"Folder (/[^\s]+)", 1), F.lit(""))
    place = F.when(kind == "session.start", data("context.cwd")).when((kind == "session.info") & (data("infoType") == "folder_trust"), trust)
    facts = r.groupBy("session_id").agg(
        F.max("mtime").alias("mtime"), _last(F.when(kind == "session.start", F.nullif(data("sessionId"), F.lit("")))).alias("header"),
        _first(place).alias("cwd"), _last(F.trim(blank_to_null(F.when(kind == "session.title_changed", data("title"))))).alias("title"),
    )
    user = kind == "user.message"
    rows = _texts(r.where(kind.isin("user.message", "assistant.message") & (data("content") != "")), ["session_id"], F.array(data("content")), F.when(user, "user").otherwise("assistant"), F.lit(True), user & (F.char_length(data("content")) > 10))
    real = facts.select("session_id", F.coalesce("header", "session_id").alias("real"))
    rows = rows.join(real, "session_id").drop("session_id").withColumnRenamed("real", "session_id")
    facts = facts.withColumn("session_id", F.coalesce("header", "session_id"))
    return _messages("copilot-cli", rows), _attrs("copilot-cli", facts, F.col("title"), F.col("cwd"), _file_time())


def ingest_copilot_vscode(spark: SparkSession, root: str | DataFrame, id_rule: str | None = None) -> tuple[DataFrame, DataFrame]:
    docs = scan_json_docs(configure(spark), root).where("rec is not null")
    places = docs.where(F.col("path").rlike(r"/workspace\.json$")).select(F.regexp_replace("path", r"/workspace\.json$", "").alias("ws"), uri_to_path(get(F.col("rec"), "$.folder")).alias("folder"))
    own = docs.where(~F.col("path").rlike(r"/workspace\.json$")).withColumn("session_id", F.coalesce(F.nullif(get(F.col("rec"), "$.sessionId"), F.lit("")), path_id(F.col("path"), id_rule or "stem")))
    req = own.select("session_id", F.posexplode(F.try_variant_get("rec", "$.requests", "array<variant>")).alias("line_no", "q"))
    said = get(F.col("q"), "$.message.text")
    user = _texts(req.where(said != ""), ["session_id"], F.array(said), F.lit("user"), F.lit(True), F.lit(True))
    values = F.filter(F.transform(F.try_variant_get("q", "$.response", "array<variant>"), lambda p: F.try_variant_get(p, "$.value", "string")), lambda t: t.isNotNull() & (t != ""))
    answer = _texts(req.where(F.size(values) > 0), ["session_id"], values, F.lit("assistant"), F.lit(True), F.lit(False)).withColumn("seq", F.col("seq") + 1)
    refs = own.select("session_id", F.posexplode(F.try_variant_get("rec", "$.requests", "array<variant>")).alias("n", "q")).select("session_id", "n", F.regexp_replace(get(F.col("q"), "$.contentReferences[0].reference.uri.fsPath"), r"/[^/]*$", "").alias("ref"))
    refs = refs.groupBy("session_id").agg(_first(F.col("ref"), "n").alias("ref"))
    facts = own.withColumn("ws", F.regexp_replace("path", r"/chatSessions/[^/]*$", "")).join(places, "ws", "left").join(refs, "session_id", "left")
    at = F.coalesce(epoch_ts(get(F.col("rec"), "$.lastMessageDate"), "ms"), epoch_ts(get(F.col("rec"), "$.creationDate"), "ms"), _file_time())
    return _messages("copilot-vscode", user.unionByName(answer)), _attrs("copilot-vscode", facts, get(F.col("rec"), "$.customTitle"), F.coalesce(F.nullif("folder", F.lit("")), "ref"), at)


def crush_torn(messages: DataFrame) -> DataFrame:
    """(session_id) of sessions with parts that cannot be parsed."""
    return messages.where(tool_summaries(F.col("parts")).isNull() & F.col("parts").isNotNull()).select("session_id").distinct()


def ingest_crush(sessions: DataFrame, messages: DataFrame, project: Column | None = None, torn: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Landed tables sessions(id, title, message_count, created_at, updated_at), messages(session_id, role, parts, created_at).

    A session with parts that cannot be parsed is left out of both results, so that its old row stays; `torn`: their ids (session_id), if they are known.
    """
    kept = sessions.where("message_count > 0").withColumnRenamed("id", "session_id")
    m = messages.select("session_id", "role", "created_at", tool_summaries(F.col("parts")).alias("text"), "parts")
    torn = crush_torn(messages) if torn is None else torn
    m, kept = m.join(torn, "session_id", "left_anti"), kept.join(torn, "session_id", "left_anti")
    own = m.join(kept.select("session_id"), "session_id").where("text <> ''").withColumn("line_no", F.col("created_at"))
    user = F.col("role") == "user"
    rows = _texts(own, ["session_id"], F.array("text"), F.when(user, "user").otherwise("assistant"), F.lit(True), user & (F.char_length("text") > 5), any_ts(F.col("created_at")))
    at = F.coalesce(epoch_ts(F.col("updated_at")), epoch_ts(F.col("created_at")))
    return _messages("crush", rows), _attrs("crush", kept, F.col("title"), project, at, mtime=F.unix_micros(at) / 1_000_000)


def _cursor_records(blobs: DataFrame) -> DataFrame:
    """(session_id, at, rec): records of blobs and all records nested in them; `at` orders them, an inner one before the one that holds it."""
    sliced = F.regexp_extract("value", r"(?s)(\{.*\})", 1)
    text = F.when(is_strict_json(F.col("value")), F.col("value")).when(is_strict_json(sliced), sliced)
    level = blobs.select("session_id", F.array(F.col("seq").cast("long")).alias("path"), F.try_parse_json(text).alias("rec"))
    found = []
    # one level of nesting at a time, until none is left; a level is written, so that it is parsed once
    while True:
        path = scratch(blobs.sparkSession, "cursor-level")
        level.write.parquet(path)
        level = blobs.sparkSession.read.schema(level.schema).parquet(path)
        if level.isEmpty() and found:
            return reduce(DataFrame.unionByName, found)
        found.append(level.select("session_id", F.array_append("path", F.lit(2).cast("long")).alias("at"), "rec"))
        inner = []
        for n, name in enumerate(("messages", "conversation")):
            items = level.select("session_id", "path", F.posexplode(F.try_variant_get("rec", f"$.{name}", "array<variant>")).alias("i", "rec"))
            inner.append(items.select("session_id", F.concat("path", F.array(F.lit(n).cast("long"), F.col("i").cast("long"))).alias("path"), "rec"))
        level = inner[0].unionByName(inner[1])


def ingest_cursor(meta: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Landed key-value tables of chats: meta(session_id, key, value, mtime, directory), blobs(session_id, seq, value), values JSON.

    A record that holds messages or a conversation is taken apart, at any depth. Around a JSON object other
    text is passed over; a text that is none, but ends in $ and an id, is what a user typed.
    """
    rec = F.col("rec")
    every = _cursor_records(blobs)
    named, kind = _plain(rec, "$.role"), F.try_variant_get("rec", "$.type", "variant")
    number = F.when(is_kind(kind, "BIGINT"), get(rec, "$.type"))
    word = _plain(rec, "$.type")
    role = F.when(named.isin("user", "assistant"), named).when((number == "1") | (word == "user"), "user").when((number == "2") | word.isin("ai", "assistant"), "assistant")
    parts = F.transform(F.try_variant_get("rec", "$.content", "array<variant>"), lambda p: F.coalesce(_plain(p, "$.text"), _plain(p, "$.data")))
    text = F.coalesce(_plain(rec, "$.text"), _plain(rec, "$.content"), F.array_join(F.filter(parts, lambda t: t.isNotNull()), "\n"), F.lit(""))
    said = every.select("session_id", "at", role.alias("role"), text.alias("text"), any_ts(get(rec, "$.timestamp")).alias("ts")).where(F.col("role").isNotNull() & F.col("text").rlike(r"\S"))
    typed = F.regexp_extract("value", r"(?s)^[\s\x00]*(.*)\$[\p{Cntrl}\s]*([^$]*?)[\p{Cntrl}\s]*$", 1)
    ident = F.regexp_extract("value", r"(?s)^[\s\x00]*(.*)\$[\p{Cntrl}\s]*([^$]*?)[\p{Cntrl}\s]*$", 2)
    plain = ~is_strict_json(F.col("value")) & typed.rlike(r"\S") & (F.octet_length(ident) >= 8) & F.contains(ident, F.lit("-"))
    old = blobs.where(plain).select("session_id", F.array(F.col("seq").cast("long")).alias("at"), F.lit("user").alias("role"), F.regexp_replace(typed, r"^[\p{Cntrl}\s]+|[\p{Cntrl}\s]+$", "").alias("text"), F.lit(None).cast("timestamp").alias("ts"))
    own = said.unionByName(old).withColumn("line_no", F.row_number().over(Window.partitionBy("session_id").orderBy("at")))
    user = F.col("role") == "user"
    rows = _texts(own, ["session_id"], F.array("text"), F.col("role"), user, user, F.col("ts"))
    names = every.select("session_id", "at", F.coalesce(_plain(rec, "$.name"), _plain(rec, "$.title")).alias("name"), any_ts(get(rec, "$.createdAt")).alias("made"))
    names = names.groupBy("session_id").agg(_first(F.col("name"), "at").alias("name"), F.min_by("made", F.when(F.col("made").isNotNull(), F.col("at"))).alias("made"))
    doc = F.try_parse_json("value")
    facts = meta.groupBy("session_id").agg(
        F.max("mtime").alias("mtime"), F.max(blank_to_null(F.coalesce(get(doc, "$.name"), get(doc, "$.title")))).alias("title"),
        F.coalesce(F.max(F.nullif(F.coalesce(get(doc, "$.cwd"), get(doc, "$.workspace")), F.lit(""))), F.max(absolute_dir(F.col("directory")))).alias("cwd"), F.max(epoch_ts(get(doc, "$.createdAt"))).alias("created"),
    )
    latest = rows.groupBy("session_id").agg(F.max("ts").alias("last"))
    facts = facts.join(latest, "session_id", "left").join(names, "session_id", "left")
    return _messages("cursor", rows), _attrs("cursor", facts, F.coalesce("title", blank_to_null(F.col("name"))), F.col("cwd"), F.coalesce("last", "created", "made"))


def ingest_grok(spark: SparkSession, root: str | DataFrame, id_rule: str | None = None) -> tuple[DataFrame, DataFrame]:
    r = _jsonl(spark, root, "grok", id_rule)

    def update(p: str, kind: str = "string") -> Column:
        return get(F.col("rec"), f"$.params.update.{p}", kind)

    name = update("sessionUpdate")
    prompt = F.coalesce(update("_meta.promptIndex"), get(F.col("rec"), "$.params._meta.promptId"))
    bash = F.try_variant_get("rec", "$.params.update._meta.bashCommand", "variant").isNotNull()
    kind = F.when(bash, "bash").when(name == "user_message_chunk", "user").when(name == "agent_message_chunk", "agent").when(name == "rewind_marker", "rewind").otherwise("other")
    indexed = update("_meta.promptIndex").isNotNull()
    chunks = r.select("session_id", F.col("line_no").cast("long").alias("seq"), kind.alias("kind"), prompt.alias("prompt"), F.coalesce(update("content.text"), F.lit("")).alias("text"), update("target_prompt_index", "int").alias("target"), indexed.alias("indexed"), any_ts(get(F.col("rec"), "$.timestamp")).alias("ts"))
    first_indexed = chunks.where("indexed").groupBy("session_id").agg(F.min("seq").alias("since"))
    chunks = chunks.join(first_indexed, "session_id", "left").withColumn("kind", F.when((F.col("kind") == "user") & ~F.col("indexed") & (F.col("seq") > F.col("since")), "bash").otherwise(F.col("kind")))
    runs = coalesce_chunks(chunks).select("session_id", F.col("first").alias("seq"), "kind", "text", F.lit(None).cast("int").alias("target"))
    rewinds = chunks.where("kind = 'rewind'").select("session_id", "seq", "kind", "text", "target")
    kept = fold_rewinds(runs.unionByName(rewinds)).withColumn("line_no", F.col("seq"))
    user = F.col("kind") == "user"
    rows = _texts(kept, ["session_id"], F.array("text"), F.when(user, "user").otherwise("assistant"), user, user & F.col("text").rlike(r"\S"))
    docs = scan_json_docs(spark, root, "summary.json").where("rec is not null")
    docs = docs.select(path_id(F.col("path"), "parent").alias("session_id"), "rec", F.col("mtime").alias("m1"), absolute_dir(path_id(F.col("path"), "grandparent")).alias("place"))
    last = chunks.groupBy("session_id").agg(F.max("ts").alias("last")).join(r.groupBy("session_id").agg(F.max("mtime").alias("m2")), "session_id")
    facts = docs.join(last, "session_id")
    at = F.coalesce("last", *[any_ts(get(F.col("rec"), f"$.{k}")) for k in ("updated_at", "last_active_at", "created_at")])
    title = F.coalesce(*[blank_to_null(get(F.col("rec"), f"$.{k}")) for k in ("generated_title", "session_summary")])
    return _messages("grok", rows), _attrs("grok", facts, title, F.coalesce(F.nullif(get(F.col("rec"), "$.info.cwd"), F.lit("")), "place"), at, mtime=F.greatest("m1", "m2"))


def _kimi_events(r: DataFrame) -> DataFrame:
    """Lines of event logs as rows of fold_history."""
    rec = F.col("rec")

    def text(path: str) -> Column:
        return F.coalesce(get(rec, path), F.lit(""))

    def origin(field: str) -> Column:
        return text(f"$.message.origin.{field}")

    kind, event = text("$.type"), F.when(text("$.type") == "context.append_loop_event", text("$.event.type"))
    of, role = origin("kind"), text("$.message.role")
    shell = of == "shell_command"
    searchable = (of != "injection") & ~(shell & (origin("phase") == "output")) & role.isin("user", "assistant")
    content = content_texts(F.try_variant_get("rec", "$.message.content", "variant"))
    shown = F.filter(F.transform(content, lambda t: F.coalesce(shell_input(t), t)), lambda t: t != "")
    typed = project_commands(of, origin("trigger"), origin("skillName"), origin("skillArgs"), origin("pluginId"), origin("commandName"), origin("commandArgs"))
    said = F.when(typed.isNotNull(), F.array(typed)).when(shell & (origin("phase") == "input"), shown).otherwise(content)
    anchor = (role == "user") & (of.isin("", "user") | (of.isin("skill_activation", "plugin_command") & (origin("trigger") == "user-slash")))
    turn = (anchor | ((role == "user") & shell & (origin("phase") == "input"))) & (F.size(said) > 0)
    part = F.when(get(rec, "$.event.part.type") == "text", F.nullif(get(rec, "$.event.part.text"), F.lit("")))
    summary = F.coalesce(_plain(rec, "$.summary"), _plain(rec, "$.contextSummary"), F.array_join(content_texts(F.try_variant_get("rec", "$.summary.content", "variant")), ""))
    what = (
        F.when((kind == "context.append_message") & searchable, "message").when(kind == "context.apply_compaction", "compaction").when(kind == "context.undo", "undo").when(kind == "context.clear", "clear")
        .when(event == "step.begin", "step_begin").when(event == "step.end", "step_end").when(event == "tool.call", "tool_call").when(event == "tool.result", "tool_result").when((event == "content.part") & part.isNotNull(), "part")
    )
    texts = F.when(kind == "context.append_message", said).when(event == "content.part", F.array(part)).when(kind == "context.apply_compaction", F.array(summary))
    message = kind == "context.append_message"
    return r.select(
        "session_id", F.col("line_no").cast("long").alias("seq"), what.alias("kind"), F.when(event.isin("step.begin", "step.end"), text("$.event.uuid")).otherwise(text("$.event.stepUuid")).alias("ref"), text("$.event.toolCallId").alias("call"),
        role.alias("role"), texts.alias("texts"), (message & turn).alias("turn"), (message & anchor).alias("anchor"), (message & (of == "compaction_summary")).alias("summary"), F.coalesce(get(rec, "$.count", "bigint"), F.lit(0)).alias("count"),
    ).where("kind is not null")


def _plain(v: Column, path: str) -> Column:
    """The value at `path` if it is a string."""
    inner = F.try_variant_get(v, path, "variant")
    return F.when(is_kind(inner, "STRING"), F.try_variant_get(v, path, "string"))


def _resolved(path: Column) -> Column:
    """A path without . and .. parts."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def kimi_work_dirs(spark: SparkSession, root: str | DataFrame, origin: str) -> DataFrame:
    """(session_id, at, work_dir): last valid entries of the session index under `root`.

    `origin` is the sessions folder on the machine that wrote the index, `at` a session's
    folder below it. An entry is valid if its folder lies there and has the session's name.
    """
    entries = scan_jsonl(configure(spark), root, "session_index.jsonl")
    rec = F.col("rec")
    base, place = _resolved(F.lit(origin)), _resolved(get(rec, "$.sessionDir"))
    deleted = F.coalesce(get(rec, "$.deleted", "boolean"), F.lit(False))
    inside = F.startswith(get(rec, "$.sessionDir"), F.lit("/")) & F.startswith(place, F.concat(base, F.lit("/"))) & (F.element_at(F.split(place, "/"), -1) == get(rec, "$.sessionId"))
    valid = (get(rec, "$.sessionId") != "") & (deleted | (inside & get(rec, "$.workDir").isNotNull()))
    log = entries.select(get(rec, "$.sessionId").alias("id"), "line_no", F.coalesce(valid, F.lit(False)).alias("valid"), deleted.alias("deleted"), F.substring(place, F.char_length(base) + 2, F.lit(1 << 30)).alias("at"), get(rec, "$.workDir").alias("work_dir"))
    return latest_lookup(log).select(F.col("id").alias("session_id"), "at", "work_dir")


def ingest_kimi(spark: SparkSession, root: str | DataFrame, id_rule: str | None = None, origin: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Event logs: messages, steps, tools, undo, clear and compaction, folded per session.

    `root` holds the sessions folder, and session_index.jsonl beside it if there is one; `origin`: see
    kimi_work_dirs, without which the index is not used. Of two states of a session the one in its own folder
    counts, not the one in session-meta.
    """
    spark = configure(spark)
    r = scan_jsonl(spark, root, "wire.jsonl").withColumn("session_id", path_id(F.col("path"), "great_grandparent" if id_rule is None else id_rule))
    docs = scan_json_docs(spark, root, "state.json").where("rec is not null").withColumn("dir", F.regexp_replace("path", r"(/session-meta)?/state\.json$", ""))
    docs = docs.withColumn("legacy", F.col("path").rlike(r"/session-meta/state\.json$")).withColumn("session_id", F.element_at(F.split("dir", "/"), -1))
    own = F.min_by(F.struct("dir", "mtime", "raw"), F.struct("legacy", "path"))
    docs = docs.groupBy("session_id").agg(own.alias("s")).select("session_id", F.col("s.dir").alias("dir"), F.col("s.mtime").alias("m1"), F.try_parse_json("s.raw").alias("rec"))
    rec = F.col("rec")
    events = _kimi_events(r)
    prompt = F.coalesce(get(rec, "$.lastPrompt"), F.lit(""))
    nothing = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in HISTORY_EVENTS.split(", ")}
    last = docs.where(prompt.rlike(r"\S")).select(*[v.alias(c) for c, v in (nothing | {"session_id": F.col("session_id"), "seq": F.lit((1 << 63) - 1), "kind": F.lit("last_prompt"), "texts": F.array(prompt)}).items()])
    folded = fold_history(events.unionByName(last)).withColumn("line_no", F.col("place"))
    user = F.col("role") == "user"
    rows = _texts(folded, ["session_id"], F.col("texts"), F.col("role"), F.col("turn"), user & F.col("turn"))
    # whether the state's last prompt may still stand for the session, by the last event that decides it
    says = F.when((F.col("kind") == "message") & F.col("turn"), True).when((F.col("kind") == "clear") | ((F.col("kind") == "undo") & (F.col("count") > 0)), False)
    allowed = events.groupBy("session_id").agg(F.max_by(says, F.when(says.isNotNull(), F.col("seq"))).alias("allowed"))
    facts = docs.join(r.groupBy("session_id").agg(F.max("mtime").alias("m2")), "session_id", "left").join(allowed, "session_id", "left")
    if origin is not None:
        index = scan_files(spark, root, "session_index.jsonl").agg(F.max("mtime").alias("m3"))
        work = kimi_work_dirs(spark, root, origin)
        facts = facts.join(work, "session_id", "left").join(F.broadcast(index), how="cross")
        # the folder that the index names is the one in which the state lies
        facts = facts.withColumn("work_dir", F.when(F.endswith(F.concat(F.lit("/"), "dir"), F.concat(F.lit("/"), "at")), F.col("work_dir")))
    else:
        facts = facts.withColumn("work_dir", _none()).withColumn("m3", _none("double"))
    custom = is_kind(F.try_variant_get("rec", "$.isCustomTitle", "variant"), "BOOLEAN")
    named = F.when(custom, blank_to_null(get(rec, "$.title"))).otherwise(F.coalesce(blank_to_null(get(rec, "$.customTitle")), blank_to_null(get(rec, "$.title"))))
    title = F.coalesce(named, F.when(F.coalesce("allowed", F.lit(True)), blank_to_null(prompt)))
    place = F.coalesce(*[blank_to_null(get(rec, f"$.{k}")) for k in ("cwd", "workDir", "custom.cwd")], blank_to_null(F.col("work_dir")))
    at = F.coalesce(*[t for k in ("updatedAt", "createdAt") for t in (epoch_ts(get(rec, f"$.{k}"), "ms"), parse_iso(get(rec, f"$.{k}")))], F.timestamp_micros((F.col("m1") * 1_000_000).cast("long")))
    return _messages("kimi", rows), _attrs("kimi", facts, title, place, at, mtime=F.greatest("m1", "m2", "m3"))


def ingest_opencode(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Landed tables session(id, title, directory, time_created, time_updated), message(id, session_id, time_created, data), part(id, message_id, session_id, time_created, data)."""
    m = messages.select(F.col("id").alias("message_id"), "session_id", "time_created", get(F.try_parse_json("data"), "$.role").alias("role"))
    text = parts.select("message_id", F.col("id").alias("part_id"), F.col("time_created").alias("part_time"), F.try_parse_json("data").alias("d")).where(get(F.col("d"), "$.type") == "text")
    joined = text.groupBy("message_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part_time", "part_id", get(F.col("d"), "$.text").alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    own = m.join(joined, "message_id", "left").withColumn("line_no", F.col("time_created"))
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    rows = _texts(own, ["session_id"], F.filter(F.array("text"), lambda t: t != ""), F.when(user, "user").otherwise("assistant"), F.lit(True), user)
    s = sessions.withColumnRenamed("id", "session_id")
    facts = s.join(activity_marker(s, messages, parts).withColumn("mtime", F.col("marker") / 1000), "session_id")
    at = epoch_ts(F.greatest("time_created", "time_updated"), "ms")
    return _messages("opencode", rows), _attrs("opencode", facts, F.col("title"), F.col("directory"), at)


def ingest_opencode_legacy(spark: SparkSession, root: str | DataFrame) -> tuple[DataFrame, DataFrame]:
    """The older file tree: session/**/ses_*.json, message/<session>/msg_*.json, part/<message>/*.json below `root`; used where there is no store.

    Messages and parts follow one another by path. A session with a message or a
    part that cannot be read whole is left out of both results, so that its old row stays.
    """
    docs, rec = scan_json_docs(configure(spark), root), F.col("rec")
    s = docs.where(F.col("path").rlike(r"/session/.*/ses_[^/]*\.json$|/session/ses_[^/]*\.json$") & (_plain(rec, "$.id") != ""))
    m = docs.where(F.col("path").rlike(r"/message/.*/msg_[^/]*\.json$")).select(path_id(F.col("path"), "parent").alias("session_id"), "path", F.col("mtime").alias("m2"), _plain(rec, "$.id").alias("message_id"), _plain(rec, "$.role").alias("role"))
    kind, text = _plain(rec, "$.type"), _plain(rec, "$.text")
    p = docs.where(F.col("path").rlike(r"/part/.*\.json$")).select(path_id(F.col("path"), "parent").alias("message_id"), F.col("path").alias("part"), F.col("mtime").alias("m3"), F.when(kind == "text", text).alias("text"), (kind.isNull() | ((kind == "text") & text.isNull())).alias("torn"))
    of = m.where("message_id <> ''").join(p, "message_id", "left")
    torn = m.where("message_id is null or message_id = ''").select("session_id").unionByName(of.where("torn").select("session_id")).distinct()
    of = of.join(torn, "session_id", "left_anti")
    grouped = of.groupBy("session_id", "message_id", "path", "role").agg(F.max("m2").alias("m2"), F.max("m3").alias("m3"), F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("part", "text")))), lambda x: x["text"]).alias("texts"))
    own = grouped.withColumn("line_no", F.row_number().over(Window.partitionBy("session_id").orderBy("path", "message_id")))
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    rows = _texts(own, ["session_id"], F.col("texts"), F.when(user, "user").otherwise("assistant"), F.lit(True), user)
    seen = grouped.groupBy("session_id").agg(F.greatest(F.max("m2"), F.max("m3")).alias("seen"))
    made = F.coalesce(epoch_ts(get(rec, "$.time.updated"), "ms"), epoch_ts(get(rec, "$.time.created"), "ms"))
    s = s.select(_plain(rec, "$.id").alias("session_id"), "mtime", _plain(rec, "$.title").alias("title"), _plain(rec, "$.directory").alias("directory"), made.alias("made"))
    facts = s.join(torn, "session_id", "left_anti").join(seen, "session_id", "left")
    # a store's session is named by its title alone
    titled = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled session"))
    return _messages("opencode", rows), _attrs("opencode", facts, titled, F.col("directory"), F.coalesce("made", _file_time()), mtime=F.greatest("mtime", "seen", F.unix_micros("made") / 1_000_000))


def ingest_pi(spark: SparkSession, root: str | DataFrame, id_rule: str | None = None) -> tuple[DataFrame, DataFrame]:
    r = _jsonl(spark, root, "pi", id_rule)
    kind, rec = get(F.col("rec"), "$.type"), F.col("rec")
    role, shown = get(rec, "$.message.role"), F.coalesce(F.try_variant_get("rec", "$.message.display", "boolean"), F.lit(False))
    name = F.when(kind == "session_info", F.coalesce(get(rec, "$.name"), F.lit("")))
    stamp = F.coalesce(any_ts(get(rec, "$.message.timestamp")), parse_iso(get(rec, "$.timestamp")))
    chat = (kind == "message") & role.isin("user", "assistant")
    facts = r.groupBy("session_id").agg(
        F.max("mtime").alias("mtime"), _first(F.when(kind == "session", get(rec, "$.id"))).alias("header"), _first(F.when(kind == "session", get(rec, "$.cwd"))).alias("cwd"),
        _last(name).alias("name"), F.max(F.when(chat, stamp)).alias("last"), F.min_by(F.when(kind == "session", parse_iso(get(rec, "$.timestamp"))), F.when(kind == "session", F.col("line_no"))).alias("begun"),
    )
    extra = F.coalesce((kind == "custom_message") & F.try_variant_get("rec", "$.display", "boolean"), F.lit(False))
    summary = kind.isin("compaction", "branch_summary")
    own = r.where(F.coalesce(chat, F.lit(False)) | F.coalesce((kind == "message") & role.isin("custom", "hookMessage") & shown, F.lit(False)) | extra | summary)
    body = F.when(kind == "message", F.try_variant_get("rec", "$.message.content", "variant")).otherwise(F.try_variant_get("rec", "$.content", "variant"))
    texts = F.when(summary, F.filter(F.array(get(rec, "$.summary")), lambda t: t.rlike(r"\S"))).otherwise(typed_texts(body))
    user = F.coalesce((kind == "message") & (role == "user"), F.lit(False))
    rows = _texts(own, ["session_id"], texts, F.when(user, "user").otherwise("assistant"), user, user)
    real = facts.select("session_id", F.coalesce("header", "session_id").alias("real"))
    rows = rows.join(real, "session_id").drop("session_id").withColumnRenamed("real", "session_id")
    facts = facts.withColumn("session_id", F.coalesce("header", "session_id"))
    return _messages("pi", rows), _attrs("pi", facts, F.trim("name"), F.col("cwd"), F.coalesce("last", "begun", _file_time()))


def ingest_vibe(spark: SparkSession, root: str | DataFrame, id_rule: str | None = None) -> tuple[DataFrame, DataFrame]:
    r = scan_jsonl(configure(spark), root, "messages.jsonl").withColumn("folder", path_id(F.col("path"), "parent"))
    docs = scan_json_docs(spark, root, "meta.json").where("rec is not null")
    rec = F.col("rec")
    docs = docs.withColumn("folder", path_id(F.col("path"), "parent")).withColumn("session_id", F.coalesce(F.nullif(get(rec, "$.session_id"), F.lit("")), "folder"))
    role = get(rec, "$.role")
    own = r.where(~F.coalesce(role == "system", F.lit(False))).join(docs.select("folder", "session_id"), "folder")
    user = F.coalesce(role == "user", F.lit(False))
    rows = _texts(own, ["session_id"], content_texts(F.try_variant_get("rec", "$.content", "variant")), F.when(user, "user").otherwise("assistant"), F.lit(False), user)
    rows = rows.withColumn("counts_as_turn", F.lit(True))  # every text counts here
    facts = docs.join(r.groupBy("folder").agg(F.max("mtime").alias("m2")), "folder", "left")
    yolo = F.coalesce(get(rec, "$.config.auto_approve", "boolean"), F.lit(False)) | F.coalesce(get(rec, "$.auto_approve", "boolean"), F.lit(False))
    return _messages("vibe", rows), _attrs("vibe", facts, get(rec, "$.title"), get(rec, "$.environment.working_directory"), F.coalesce(parse_iso(get(rec, "$.start_time")), _file_time()), yolo, F.greatest("mtime", "m2"))


def ingest_antigravity(spark: SparkSession, root: str | DataFrame, id_rule: str | None = None, steps: DataFrame | None = None, history_root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Transcripts under root (.../brain/*/.system_generated/logs; the full one where it is no smaller), and `steps` (session_id, idx, step_type, status, ts, text) landed from the store, which win."""
    files = scan_files(configure(spark), root, "transcript*.jsonl")
    variant = F.when(F.col("path").rlike("_full\\.jsonl$"), "full").otherwise("regular")
    chosen = prefer_file(files.select(path_id(F.col("path"), id_rule or "great_grandparent").alias("session_id"), variant.alias("variant"), "size", "path"))
    r = scan_jsonl(spark, root, "transcript*.jsonl").join(chosen.select("session_id", "path"), "path")
    rec = F.col("rec")
    source, kind = get(rec, "$.source"), get(rec, "$.type")
    user = source.isin("USER", "USER_EXPLICIT")
    model = (source == "MODEL") & (kind == "PLANNER_RESPONSE")
    skipped = F.coalesce(kind.isin("CONVERSATION_HISTORY", "EPHEMERAL_MESSAGE"), F.lit(False))
    said = F.when(user, unwrap_request(get(rec, "$.content"))).otherwise(F.coalesce(F.nullif(get(rec, "$.content"), F.lit("")), get(rec, "$.thinking")))
    own = r.where((user | model) & ~skipped & (said != ""))
    rows = _texts(own, ["session_id"], F.array(said), F.when(user, "user").otherwise("assistant"), user, user, any_ts(get(rec, "$.created_at")))
    facts = r.groupBy("session_id").agg(F.max("mtime").alias("mtime"))
    if steps is not None:
        kept = steps.where("step_type in (14, 15) and status in (0, 3) and text <> ''").withColumn("line_no", F.col("idx"))
        asked = F.col("step_type") == 14
        landed = _texts(kept, ["session_id"], F.array(F.when(asked, unwrap_request(F.col("text"))).otherwise(F.col("text"))), F.when(asked, "user").otherwise("assistant"), asked, asked, F.col("ts"))
        stored = steps.groupBy("session_id").agg((F.unix_micros(F.max("ts")) / 1_000_000).alias("mtime"))
        rows = landed.unionByName(rows.join(stored.select("session_id"), "session_id", "left_anti"))
        facts = facts.unionByName(stored).groupBy("session_id").agg(F.max("mtime").alias("mtime"))
    history = scan_jsonl(spark, history_root or root, "history.jsonl").select(get(rec, "$.conversationId").alias("session_id"), get(rec, "$.workspace").alias("ws"), "line_no")
    places = history.where("session_id is not null").groupBy("session_id").agg(_last(F.nullif(uri_to_path(F.col("ws"), True), F.lit(""))).alias("place"))
    last = rows.groupBy("session_id").agg(F.max("ts").alias("last"))
    facts = facts.join(places, "session_id", "left").join(last, "session_id", "left")
    return _messages("antigravity", rows), _attrs("antigravity", facts, None, F.col("place"), F.coalesce("last", _file_time()))


RULES_OF: dict[str, Rules] = {
    "codex": Rules(80, False),
    "copilot-vscode": Rules(cut_named=False, without_user="VS Code chat"),
    "crush": Rules(cut_named=False),
    "opencode": Rules(cut_named=False, without_user="Untitled session", needs_text=False),
    "pi": Rules(without_user="(no messages)"),
    "vibe": Rules(80, False, cut_named=False, without_user="Vibe session", needs_text=False),
}

#: Sources that are folders of files; crush, cursor and opencode are landed tables.
FILE_SOURCES: dict[str, Callable[..., tuple[DataFrame, DataFrame]]] = {
    "antigravity": ingest_antigravity,
    "claude": ingest_claude,
    "codex": ingest_codex,
    "copilot-cli": ingest_copilot_cli,
    "copilot-vscode": ingest_copilot_vscode,
    "grok": ingest_grok,
    "kimi": ingest_kimi,
    "pi": ingest_pi,
    "vibe": ingest_vibe,
}


def sessions_of(agent: str, made: tuple[DataFrame, DataFrame]) -> DataFrame:
    return to_sessions(*made, RULES_OF.get(agent, Rules()))


#: Sources whose index names folders as they were on another machine.
WITH_ORIGIN = ("kimi",)


def ingest_all(spark: SparkSession, roots: dict[str, str], landed: dict[str, tuple[DataFrame, ...]] | None = None, origins: dict[str, str] | None = None) -> DataFrame:
    """All sources as branches of one plan, one row per session.

    roots: folder of each file source, and of opencode's older file tree, which
    is read only where its store is not landed; landed: tables of crush, cursor
    and opencode; origins: the folder in which kimi's index was written.
    """
    files = {**FILE_SOURCES, "opencode": ingest_opencode_legacy}

    def more(agent: str) -> dict[str, str | None]:
        return {"origin": (origins or {}).get(agent)} if agent in WITH_ORIGIN else {}

    parts = [sessions_of(agent, files[agent](spark, root, **more(agent))) for agent, root in roots.items() if agent not in (landed or {})]
    jobs = {"crush": ingest_crush, "cursor": ingest_cursor, "opencode": ingest_opencode}
    parts += [sessions_of(agent, jobs[agent](*tables)) for agent, tables in (landed or {}).items()]
    path = scratch(spark, "ingested")
    reduce(DataFrame.unionByName, parts).write.parquet(path)
    return dedupe_sessions(spark.read.schema(SESSIONS).parquet(path))


