"""Registered queries of the session operators: (spark, sf_dir) -> DataFrame, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import json as fj
from sessionlake.functions import paths, text, times
from sessionlake.model import AGENT_NAMES, AGENTS
from sessionlake.operators import filters, messages, refresh, search, stats
from sessionlake.plans import sql, views
from sessionlake.sources.scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


LISTED = "id, agent, directory, timestamp, message_count"


def _slim(df: DataFrame) -> DataFrame:
    return df.select(*LISTED.split(", "))


# -- messages ------------------------------------------------------------------


@query("render_messages", f"WITH {sql.V_MESSAGES} SELECT agent, session_id, seq, rendered FROM v_messages")
def render_messages(spark, sf):
    m = views.messages(spark, sf)
    return m.select("agent", "session_id", "seq", messages.rendered(F.col("role"), F.col("text")).alias("rendered"))


@query("drop_noise", """SELECT conv_id, turn, role, text FROM conversations
WHERE role IN ('user', 'assistant') AND regexp_matches(text, '\\S')
  AND NOT starts_with(ltrim(text), '<command') AND NOT starts_with(ltrim(text), '<local-command') AND NOT starts_with(ltrim(text), '<environment_context>')""")
def drop_noise(spark, sf):
    return messages.drop_noise(views.table(spark, sf, "conversations")).select("conv_id", "turn", "role", "text")


@query("unwrap_tags", r"""SELECT conv_id, turn,
  regexp_replace(CASE WHEN turn % 3 = 0 THEN text ELSE 'note ' || text END, '^\s+|\s+$', '', 'g') AS request,
  CASE WHEN turn % 3 = 1 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') || ' <&>' END AS command
FROM conversations""")
def unwrap_tags(spark, sf):
    t = views.table(spark, sf, "conversations")
    wrapped = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("x <USER_REQUEST>\n"), "text", F.lit("\n</USER_REQUEST> y"))).otherwise(F.concat(F.lit("note "), "text", F.lit(" <ADDITIONAL_METADATA>z")))
    shell = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("<bash-input>"), F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit(" &lt;&amp;&gt;</bash-input>"))).otherwise(F.col("text"))
    return t.select("conv_id", "turn", messages.unwrap_request(wrapped).alias("request"), messages.shell_input(shell).alias("command"))


@query("content_texts", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE text || '|' || role END AS texts FROM conversations")
def content_texts(spark, sf):
    t = views.table(views.configure(spark), sf, "conversations")
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("input_text")), F.struct(F.lit("x").alias("type"), F.lit(None).cast("string").alias("text"), F.col("role").alias("input_text")))
    raw = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("c")))).otherwise(F.to_json(F.struct(part.alias("c"))))
    v = F.try_variant_get(F.try_parse_json(raw), "$.c", "variant")
    return t.select("conv_id", "turn", F.array_join(fj.content_texts(v), "|").alias("texts"))


@query("tool_summaries", """SELECT conv_id, turn, CASE WHEN turn % 7 <> 6 THEN text || CASE WHEN length(text) < 500 THEN ' [' || role || ']: ' || left(text, 200) ELSE '' END || ' [calling ' || role || ']' END AS summary
FROM conversations""")
def tool_summaries(spark, sf):
    t = views.table(views.configure(spark), sf, "conversations")

    def part(kind, field, name):
        empty = F.lit(None).cast("string")
        data = F.struct(F.when(F.lit(field == "text"), F.col("text")).alias("text"), F.when(F.lit(field == "content"), F.col("text")).alias("content"), (F.col("role") if name else empty).alias("name"))
        return F.struct(F.lit(kind).alias("type"), data.alias("data"))

    raw = F.to_json(F.array(part("text", "text", False), part("tool_result", "content", True), part("tool_call", "", True)))
    return t.select("conv_id", "turn", fj.tool_summaries(F.when(F.col("turn") % 7 == 6, F.lit("[{")).otherwise(raw)).alias("summary"))


def _chunks(spark, sf):
    t = views.table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "agent").otherwise("other")
    body = F.when(F.col("n") == 0, F.substring("text", 1, 40)).otherwise(F.expr("substring(text, 41)"))
    return t.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.col("conv_id").alias("session_id"), (F.col("turn") * 10 + F.col("n")).alias("seq"), kind.alias("kind"), F.lit(0).alias("prompt"), body.alias("text"))


@query("coalesce_chunks", """WITH r AS (
  SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seg,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
u AS (SELECT *, sum(CASE WHEN role = 'user' AND before IS DISTINCT FROM 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS urun FROM r)
SELECT conv_id AS session_id, min(turn) * 10 AS first, CASE role WHEN 'user' THEN 'user' ELSE 'agent' END AS kind, string_agg(text, '' ORDER BY turn) AS text
FROM u WHERE role IN ('user', 'assistant') GROUP BY conv_id, role, CASE WHEN role = 'user' THEN urun ELSE seg END""")
def coalesce_chunks(spark, sf):
    return messages.coalesce_chunks(_chunks(spark, sf)).select("session_id", "first", "kind", "text")


@query("rewind_fold", """WITH RECURSIVE c AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn * 10 AS seq, left(text, 40) AS text,
    CASE WHEN turn % 7 = 4 THEN 'rewind' WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'agent' ELSE 'other' END AS kind FROM conversations),
f AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(seq BIGINT, kind VARCHAR, text VARCHAR)[]) AS kept FROM c
  UNION ALL
  SELECT conv_id, n, CASE WHEN kind <> 'rewind' THEN list_append(kept, struct_pack(seq := seq, kind := kind, text := text)) WHEN len(users) > 1 THEN kept[1:users[2] - 1] ELSE kept END
  FROM (SELECT c.*, kept, list_filter(range(1, len(kept) + 1), lambda i: kept[i].kind = 'user') AS users FROM f JOIN c ON c.conv_id = f.conv_id AND c.n = f.n + 1))
SELECT conv_id AS session_id, unnest(kept, recursive := true) FROM (SELECT *, max(n) OVER (PARTITION BY conv_id) AS latest FROM f) WHERE n = latest""")
def rewind_fold(spark, sf):
    c = _chunks(spark, sf).where("seq % 10 = 0")
    kind = F.when(F.col("seq") % 70 == 40, "rewind").otherwise(F.col("kind"))
    return messages.fold_rewinds(c.withColumn("kind", kind).withColumn("target", F.lit(1)))


@query("history_fold", f"WITH RECURSIVE {sql.V_HISTORY} SELECT CAST(conv_id AS VARCHAR) AS session_id, place, role, text, turn FROM v_entries")
def history_fold(spark, sf):
    e = views.history_events(spark, sf)
    none, no = F.lit(None).cast("string"), F.lit(False)
    user = (F.col("kind") == "message") & (F.col("role") == "user")
    ref = F.when(F.col("kind").isin("step_begin", "step_end", "part", "tool_call"), "s")
    rows = e.select("session_id", "seq", "kind", ref.alias("ref"), F.when(F.col("kind").isin("tool_call", "tool_result"), "c").alias("call"), "role", F.array("text").alias("texts"), user.alias("turn"), user.alias("anchor"), no.alias("summary"), F.lit(1).cast("long").alias("count"))
    last = e.where("conv_id % 4 = 0").select("session_id", "conv_id").distinct()
    last = last.select("session_id", F.lit(1 << 40).alias("seq"), F.lit("last_prompt").alias("kind"), none.alias("ref"), none.alias("call"), none.alias("role"), F.array(F.concat(F.lit("last "), "session_id")).alias("texts"), no.alias("turn"), no.alias("anchor"), no.alias("summary"), F.lit(0).cast("long").alias("count"))
    return messages.fold_history(rows.unionByName(last)).select("session_id", "place", "role", F.array_join("texts", "").alias("text"), "turn")


@query("assemble_sessions", sql.with_sessions("SELECT id, agent, title, directory, timestamp, content, message_count, mtime, yolo FROM v_sessions"))
def assemble_sessions(spark, sf):
    return views.sessions(spark, sf)


@query("truncate_title", f"SELECT doc_id, {sql.truncated('text', 80, False)} AS t80, {sql.truncated('text', 100)} AS t100 FROM documents")
def truncate_title(spark, sf):
    d = views.table(spark, sf, "documents")
    return d.select("doc_id", text.truncate_title(F.col("text"), 80, False).alias("t80"), text.truncate_title(F.col("text"), 100).alias("t100"))


@query("resolve_title", f"""WITH m AS (
  SELECT conv_id, arg_max(left(text, 30), turn) FILTER (role = 'assistant' AND turn % 3 = 0 AND regexp_matches(left(text, 30), '\\S')) AS last_title,
         arg_min(text, turn) FILTER (role = 'user') AS first_user FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(last_title, {sql.truncated("first_user", 100)}) AS title FROM m""")
def resolve_title(spark, sf):
    t = views.table(spark, sf, "conversations")
    title = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), F.substring("text", 1, 30))
    user = F.col("role") == "user"
    m = t.groupBy("conv_id").agg(messages.last_title(title, F.col("turn")).alias("last_title"), F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("first_user"))
    return m.select("conv_id", messages.resolve_title(F.col("last_title"), first_user=F.col("first_user")).alias("title"))


@query("yolo_flag", """SELECT user_id, bool_or(CASE WHEN event_type = 'error' THEN value > 30 ELSE false END OR event_type = 'purchase' AND value > 40) AS yolo FROM events GROUP BY user_id""")
def yolo_flag(spark, sf):
    e = views.table(spark, sf, "events")
    approval = F.when((F.col("event_type") == "error") & (F.col("value") > 30), "never").otherwise("ask")
    sandbox = F.when((F.col("event_type") == "purchase") & (F.col("value") > 40), "danger-full-access").otherwise("read-only")
    return e.groupBy("user_id").agg(messages.yolo_flag(approval, sandbox).alias("yolo"))


@query("explode_messages", sql.with_sessions(r"""
SELECT agent, id, pos - 1 AS pos, CASE WHEN starts_with(ltrim(piece), '» ') THEN 'user' WHEN starts_with(piece, '  ') THEN 'assistant' ELSE 'other' END AS role, piece AS text
FROM (SELECT agent, id, unnest(string_split(content, chr(10) || chr(10))) AS piece, unnest(generate_series(1, len(string_split(content, chr(10) || chr(10))))) AS pos FROM v_sessions)
WHERE regexp_matches(piece, '\S')"""))
def explode_messages(spark, sf):
    return messages.explode_messages(views.sessions(spark, sf))


@query("code_blocks", """SELECT conv_id, turn, 0 AS block, lower(role) AS language, text AS code FROM conversations
UNION ALL SELECT conv_id, turn, 1, '', left(text, 10) FROM conversations""")
def code_blocks(spark, sf):
    t = views.table(spark, sf, "conversations")
    body = F.concat(F.lit("a\n```"), F.upper("role"), F.lit(" x\n"), "text", F.lit("\n```\nb\n  ```\n"), F.substring("text", 1, 10))
    return messages.code_blocks(t.withColumn("text", body), ["conv_id", "turn"]).select("conv_id", "turn", "block", "language", F.coalesce("code", F.lit("")).alias("code"))


# -- columns -------------------------------------------------------------------


@query("parse_ts", """SELECT event_id, ts AS with_fraction, date_trunc('second', ts) AS naive, CAST(NULL AS TIMESTAMP) AS bad,
  ts - INTERVAL 2 HOUR AS with_offset FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events)""")
def parse_ts(spark, sf):
    e = views.table(views.configure(spark), sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select(
        "event_id", times.parse_iso(F.concat(iso, F.lit("Z"))).alias("with_fraction"), times.parse_iso(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("naive"),
        times.parse_iso(F.date_format("ts", "yyyy")).alias("bad"), times.parse_iso(F.concat(iso, F.lit("+02:00"))).alias("with_offset"),
    )


@query("epoch_ts", """SELECT event_id, date_trunc('millisecond', ts) AS from_ms, date_trunc('second', ts) AS from_s,
  date_trunc('millisecond', ts) AS auto_ms, CAST(NULL AS TIMESTAMP) AS none FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events)""")
def epoch_ts(spark, sf):
    e = views.table(views.configure(spark), sf, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    ms = F.col("ms")
    return e.select("event_id", times.epoch_ts(ms, "ms").alias("from_ms"), times.epoch_ts(F.floor(ms / 1000), "s").alias("from_s"), times.epoch_ts(ms).alias("auto_ms"), times.epoch_ts(-ms).alias("none"))


@query("path_ids", r"""SELECT page_id, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem,
  regexp_replace(regexp_replace(regexp_extract(p, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '^[^-]*-', '') AS after_dash,
  regexp_replace(regexp_replace(regexp_extract(p, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '^.*_', '') AS after_underscore, string_split(p, '/')[-2] AS parent
FROM (SELECT page_id, url || '/rollout-7_' || CAST(page_id AS VARCHAR) || '.jsonl' AS p FROM pages)""")
def path_ids(spark, sf):
    p = views.table(spark, sf, "pages").select("page_id", F.concat("url", F.lit("/rollout-7_"), F.col("page_id").cast("string"), F.lit(".jsonl")).alias("p"))
    return p.select("page_id", *[paths.path_id(F.col("p"), r).alias(r) for r in ("stem", "after_dash", "after_underscore", "parent")])


@query("percent_decode", "SELECT page_id, url_decode(url_encode(url)) || '+x' AS decoded, CASE WHEN page_id % 2 = 0 THEN '/a b' END AS absolute FROM pages")
def percent_decode(spark, sf):
    p = views.table(spark, sf, "pages")
    encoded = F.concat(F.url_encode("url"), F.lit("+x"))
    return p.select("page_id", paths.percent_decode(encoded).alias("decoded"), paths.absolute_dir(F.when(F.col("page_id") % 2 == 0, "%2Fa%20b").otherwise("a%20b")).alias("absolute"))


@query("uri_path", "SELECT page_id, '/w x/' || CAST(page_id AS VARCHAR) AS path, '' AS other, url AS kept FROM pages")
def uri_path(spark, sf):
    p = views.table(spark, sf, "pages")
    uri = F.concat(F.lit("file:///w%20x/"), F.col("page_id").cast("string"))
    return p.select("page_id", paths.uri_to_path(uri).alias("path"), paths.uri_to_path(F.col("url")).alias("other"), paths.uri_to_path(F.col("url"), True).alias("kept"))


@query("age_buckets", f"""SELECT event_type, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h'
  WHEN s < 2592000 THEN CAST(s // 86400 AS VARCHAR) || 'd' WHEN s < 31536000 THEN CAST(s // 2592000 AS VARCHAR) || 'mo' ELSE CAST(s // 31536000 AS VARCHAR) || 'y' END AS age, count(*) AS n
FROM (SELECT event_type, CAST(floor((epoch_us({sql.NOW}) - epoch_us(CAST(ts AS TIMESTAMP))) / 1000000) AS BIGINT) AS s FROM events) GROUP BY ALL""")
def age_buckets(spark, sf):
    e = views.table(views.configure(spark), sf, "events")
    return e.groupBy("event_type", text.age_label(F.col("ts").cast("timestamp"), F.lit(views.AS_OF).cast("timestamp")).alias("age")).agg(F.count("*").alias("n"))


@query("tokens", f"SELECT term, count(*) AS n FROM (SELECT unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY term")
def tokens(spark, sf):
    return views.table(spark, sf, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("fingerprint", sql.with_sessions("SELECT agent, id, CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'content' WHEN 2 THEN 'count' WHEN 3 THEN 'mtime' ELSE 'none' END AS edit, CAST(id AS BIGINT) % 5 < 3 AS changed FROM v_sessions"))
def fingerprint(spark, sf):
    """Whether the fingerprint tells an edited session from the one before; the marker's time is no part of it."""
    s, c = views.sessions(spark, sf), F.col("id").cast("long") % 5
    edited = s.withColumns({
        "title": F.when(c == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")), "content": F.when(c == 1, F.concat("content", F.lit(" "))).otherwise(F.col("content")),
        "message_count": F.when(c == 2, F.col("message_count") + 1).otherwise(F.col("message_count")), "mtime": F.when(c == 3, F.col("mtime") + 9).otherwise(F.col("mtime")),
    })
    both = refresh.fingerprint(s).join(refresh.fingerprint(edited).withColumnRenamed("fingerprint", "after"), refresh.KEY)
    edit = F.when(c == 0, "title").when(c == 1, "content").when(c == 2, "count").when(c == 3, "mtime").otherwise("none")
    return both.select("agent", "id", edit.alias("edit"), (F.col("fingerprint") != F.col("after")).alias("changed"))


# -- filters -------------------------------------------------------------------


def _filtered(name: str, where: str, make):
    @query(name, sql.with_sessions(f"SELECT {LISTED} FROM v_sessions WHERE {where}"))
    def run(spark, sf):
        return _slim(filters.apply(views.listed(spark, sf), make()))

    return run


_filtered("filter_agent", "agent IN ('claude', 'pi', 'codex') AND agent <> 'codex'", lambda: filters.agent_filter(["Claude", "pi", "codex"], ["CoDex"]))
_filtered("filter_dir", "(contains(lower(directory), 'click') OR contains(lower(directory), 'view')) AND NOT contains(lower(directory), '/u3')", lambda: filters.dir_filter(["CLICK", "view"], ["/U3"]))
_filtered("filter_date_rel", f"timestamp >= {sql.NOW} - INTERVAL 6 DAY", lambda: filters.date_filter("<6d", views.AS_OF))
_filtered("filter_date_day", "timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-06'", lambda: filters.date_filter("yesterday", views.dt.datetime(2024, 1, 6, 9)))
_filtered("filter_date_neg", f"NOT (timestamp >= {sql.NOW} - INTERVAL '222 hours')", lambda: filters.date_filter("!<222h", views.AS_OF))
_filtered("filter_combined", f"agent <> 'kimi' AND contains(lower(directory), 'i') AND NOT (timestamp < {sql.NOW} - INTERVAL 7 DAY)",
          lambda: filters.all_of(filters.agent_filter((), ["kimi"]), filters.dir_filter(["I"]), filters.date_filter(">1w", views.AS_OF, True)))


@query("query_validity", f"""WITH {sql.V_DIM}, f AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'date' ELSE 'dir' END AS keyword,
  CASE turn % 3 WHEN 0 THEN 'claude,!PI' WHEN 1 THEN '<2d, today' ELSE role END AS value FROM conversations)
SELECT conv_id, turn, CASE keyword WHEN 'dir' THEN true WHEN 'agent' THEN value = 'claude,!PI' ELSE value = '<2d, today' END AS valid FROM f""")
def query_validity(spark, sf):
    t = views.table(spark, sf, "conversations")
    keyword = F.when(F.col("conv_id") % 3 == 0, "agent").when(F.col("conv_id") % 3 == 1, "date").otherwise("dir")
    value = F.when(F.col("turn") % 3 == 0, "claude,!PI").when(F.col("turn") % 3 == 1, "<2d, today").otherwise(F.col("role"))
    return t.select("conv_id", "turn", filters.query_validity(value, keyword, AGENT_NAMES).alias("valid"))


# -- search --------------------------------------------------------------------

_BEST = """SELECT query_id, rank, agent, id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, timestamp DESC, agent, id) AS rank FROM v_found) WHERE rank <= 10"""


_FILTERS = ("agent_include", "agent_exclude", "dir_include", "dir_exclude")


@query("parse_queries", f"""WITH {sql.V_LOG} SELECT query_id, text, {", ".join(f"coalesce(array_to_string({c}, '|'), '') AS {c}" for c in _FILTERS)}, op, cutoff, until,
  CASE WHEN cutoff IS NOT NULL THEN negated END AS negated FROM v_parsed""")
def parse_queries(spark, sf):
    parsed = search.parse_queries(views.query_log(views.configure(spark), sf), views.AS_OF)
    return parsed.select("query_id", "text", *[F.array_join(c, "|").alias(c) for c in _FILTERS], "date.op", "date.cutoff", "date.until", "date.negated")


@query("postings", sql.with_sessions("SELECT agent, id, field, term, tf, len FROM v_postings", sql.V_POSTINGS))
def postings(spark, sf):
    return search.postings(views.sessions(spark, sf)).drop("positions")


@query("vocab_df", sql.with_sessions("SELECT field, term, count(*) AS df FROM v_postings GROUP BY field, term", sql.V_POSTINGS))
def vocab_df(spark, sf):
    return search.vocabulary(search.postings(views.sessions(spark, sf)))


def _typed(spark):
    return search.parse_queries(views.queries(spark), views.AS_OF).where("text <> ''")


@query("bm25_exact", sql.with_sessions("SELECT query_id, agent, id, round(score / 5.0, 6) AS score FROM v_exact", *sql.SEARCH))
def bm25_exact(spark, sf):
    return search.bm25(_typed(spark), search.build_index(views.sessions(spark, sf))).withColumn("score", F.round("score", 6))


@query("phrase", sql.with_sessions(f"""SELECT agent, id FROM v_sessions WHERE contains(' ' || array_to_string({sql.tokens("title")}, ' ') || ' ', ' of the ')
  OR contains(' ' || array_to_string({sql.tokens("content")}, ' ') || ' ', ' of the ')"""))
def phrase(spark, sf):
    return search.phrase_filter(views.sessions(spark, sf), "of the").select("agent", "id")


@query("fuzzy_prefix", sql.with_sessions("SELECT query_id, agent, id, score FROM v_fuzzy", *sql.SEARCH))
def fuzzy_prefix(spark, sf):
    return search.fuzzy(_typed(spark), search.build_index(views.sessions(spark, sf)))


@query("dir_text", sql.with_sessions("SELECT query_id, agent, id, score FROM v_dirs", *sql.SEARCH))
def dir_text(spark, sf):
    return search.dir_text(_typed(spark), views.listed(spark, sf))


@query("search_score", sql.with_sessions("SELECT query_id, agent, id, round(score, 6) AS score FROM v_scores", *sql.SEARCH))
def search_score(spark, sf):
    return search.search_scores(_typed(spark), views.sessions(spark, sf)).withColumn("score", F.round("score", 6))


@query("search_topk", sql.with_sessions("""SELECT agent, id, title, timestamp, round(score, 6) AS score FROM v_found f JOIN v_sessions s USING (agent, id, timestamp)
WHERE query_id = 2 ORDER BY round(score, 6) DESC, timestamp DESC, agent, id LIMIT 10 OFFSET 2""", *sql.SEARCH))
def search_topk(spark, sf):
    found = search.search(views.sessions(spark, sf), views.QUERIES[1][1], views.AS_OF, limit=10, offset=2)
    return found.select("agent", "id", "title", "timestamp", F.round("score", 6).alias("score"))


@query("recent_topk", sql.with_sessions("SELECT agent, id, timestamp FROM v_sessions ORDER BY timestamp DESC, agent, id LIMIT 20"))
def recent_topk(spark, sf):
    return search.search(views.listed(spark, sf), "", views.AS_OF, limit=20).select("agent", "id", "timestamp")


@query("search_count", sql.with_sessions("SELECT query_id, count(*) AS matches FROM v_found GROUP BY query_id", *sql.SEARCH))
def search_count(spark, sf):
    s = views.sessions(spark, sf)
    return search.matches(search.parse_queries(views.queries(spark), views.AS_OF), s).groupBy("query_id").agg(F.count("*").alias("matches"))


@query("search_batch", sql.with_sessions(_BEST, *sql.SEARCH))
def search_batch(spark, sf):
    return search.search_batch(views.queries(spark), views.sessions(spark, sf), views.AS_OF, 10)


@query("search_boolean", sql.with_sessions(_BEST, *sql.CLAUSE_SEARCH))
def search_boolean(spark, sf):
    """Phrases, signs, joined clauses and fields."""
    return search.search_batch(views.clause_queries(spark), views.sessions(spark, sf), views.AS_OF, 10)


@query("search_phrase", sql.with_sessions("SELECT query_id, agent, id, round(score / 5.0, 6) AS score FROM v_exact", *sql.CLAUSE_SEARCH))
def search_phrase(spark, sf):
    """What the clauses themselves score, from a kept index: positions, and the files of the terms."""
    index = search.build_index(views.sessions(spark, sf), scratch(spark, "index"))
    return search.bm25(search.parse_queries(views.clause_queries(spark), views.AS_OF), index).withColumn("score", F.round("score", 6))


@query("search_kept_index", sql.with_sessions(_BEST, *sql.SEARCH))
def search_kept_index(spark, sf):
    """search_batch from an index that lies on disk."""
    s, path = views.sessions(spark, sf), scratch(spark, "index")
    search.build_index(s, path)
    return search.search_batch(views.queries(spark), s, views.AS_OF, 10, search.open_index(spark, path))


@query("search_index_update", sql.with_sessions(_BEST, *sql.SEARCH))
def search_index_update(spark, sf):
    """An index of older sessions (some with another text, some gone since, some not yet there), brought up to date by what changed."""
    s, path = views.sessions(spark, sf), scratch(spark, "index")
    kind = F.col("id").cast("long") % 20
    before = s.where(kind != 1).withColumn("content", F.when(kind == 2, F.concat(F.lit("of the things before "), "title")).otherwise(F.col("content")))
    gone = s.where(kind == 3).withColumn("id", F.concat(F.lit("gone-"), "id"))
    search.build_index(before.unionByName(gone), path)
    index = search.update_index(spark, path, s.where(kind.isin(1, 2)), gone.select("agent", "id"))
    return search.search_batch(views.queries(spark), s, views.AS_OF, 10, index)


@query("postings_positions", sql.with_sessions("SELECT agent, id, field, term, string_agg(CAST(pos - 1 AS VARCHAR), ',' ORDER BY pos) AS positions FROM v_places GROUP BY agent, id, field, term", sql.V_PLACES))
def postings_positions(spark, sf):
    return search.postings(views.sessions(spark, sf)).select("agent", "id", "field", "term", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query("page_meta", sql.with_sessions("""SELECT conv_id, turn, "offset", "limit", total, returned, CASE WHEN total > 0 AND "offset" >= total THEN 'past_end' WHEN "offset" + returned < total THEN 'more' ELSE 'complete' END AS state,
  CASE WHEN "offset" + returned < total THEN "offset" + returned END AS next_offset
FROM (SELECT *, greatest(0, least("limit", total - "offset")) AS returned FROM (
  SELECT conv_id, turn, turn * 3 AS "offset", CASE WHEN turn % 3 = 2 THEN greatest(total - turn * 3, 0) ELSE conv_id % 7 END AS "limit", total
  FROM conversations JOIN (SELECT agent, count(*) AS total FROM v_sessions GROUP BY agent) t ON t.agent = [""" + ", ".join(f"'{a}'" for a in AGENT_NAMES) + """][conv_id % 12 + 1]))"""))
def page_meta(spark, sf):
    """Pages over the sessions of the turn's agent."""
    totals = views.listed(spark, sf).groupBy("agent").agg(F.count("*").alias("total"))
    t = views.table(spark, sf, "conversations").withColumn("agent", views.agent_of(F.col("conv_id")))
    limit = F.when(F.col("turn") % 3 != 2, F.col("conv_id") % 7)
    pages = t.join(totals, "agent").select("conv_id", "turn", (F.col("turn") * 3).cast("long").alias("offset"), limit.cast("long").alias("limit"), "total")
    return search.page_meta(pages).select("conv_id", "turn", "offset", "limit", "total", "returned", "state", "next_offset")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("snippet", sql.with_sessions(f"""SELECT agent, id, CASE WHEN hit IS NULL THEN left(content, 6000) || CASE WHEN length(content) > 6000 THEN chr(10) || '...' ELSE '' END
  ELSE CASE WHEN start > 1 THEN '...' || chr(10) ELSE '' END || substr(content, start, hit - start + 5000) || CASE WHEN length(content) > hit - 1 + 5000 THEN chr(10) || '...' ELSE '' END END AS snippet
FROM (SELECT *, greatest(hit - 221, 1) AS start FROM (
  SELECT agent, id, content, least(nullif(strpos(translate(content, {_AZ}), 'thing'), 0), nullif(strpos(translate(content, {_AZ}), 'keit'), 0)) AS hit FROM v_sessions))"""))
def snippet(spark, sf):
    return views.sessions(spark, sf).select("agent", "id", text.snippet(F.col("content"), ["Thing", "keit"]).alias("snippet"))


@query("highlight", sql.with_sessions(r"SELECT agent, id, regexp_replace(title, '(the|in)', '[[\1]]', 'gi') AS marked FROM v_sessions"))
def highlight(spark, sf):
    return views.sessions(spark, sf).select("agent", "id", text.highlight(F.col("title"), ["the", "in"]).alias("marked"))


def _argv(agent: str, binary: str, yolo: tuple, resume: tuple, ok: bool) -> str:
    if agent == "opencode":
        return f"['{binary}', directory, '--session', id]"
    if agent == "copilot-vscode":
        return f"CASE WHEN directory = '' THEN ['{binary}'] ELSE ['{binary}', directory] END"
    flags, rest = (", ".join(f"'{x}'" for x in xs) for xs in (yolo, resume))
    return f"['{binary}'] || CASE WHEN yolo AND {ok} THEN [{flags}]::VARCHAR[] ELSE []::VARCHAR[] END || [{rest}]::VARCHAR[] || [id]"


_ARGV = " ".join(f"WHEN '{a}' THEN {_argv(a, b, yolo, resume, ok)}" for a, _, b, yolo, resume, ok in AGENTS)


@query("result_json", sql.with_sessions(f"""SELECT CAST(n - 1 AS INTEGER) AS place, 1 AS schema_version, id, agent, title, directory, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, message_count,
  array_to_string(CASE agent {_ARGV} END, ' ') AS resume_command, CASE WHEN 13 < total THEN 'more' ELSE 'complete' END AS state, total, least(10, total - 3) AS returned, CASE WHEN 13 < total THEN 13 END AS next_offset, 0 AS hidden
FROM (SELECT *, row_number() OVER (ORDER BY timestamp DESC, agent, id) - 3 AS n, count(*) OVER () AS total FROM v_sessions) WHERE n BETWEEN 1 AND 10"""))
def result_json(spark, sf):
    """The envelope of a page, read back from its JSON; `hidden` counts fields that an envelope never shows."""
    s = views.sessions(spark, sf)
    page = refresh.with_resume_command(search.search(s, "", views.AS_OF, limit=10, offset=3))
    made = search.result_json(page, s.count(), 3, 10)
    session = "struct<id: string, agent: string, title: string, directory: string, timestamp: string, message_count: bigint, resume_command: array<string>, content: string, mtime: string, yolo: string>"
    read = made.select(F.from_json("json", f"schema_version int, sessions array<{session}>, meta struct<state: string, total: bigint, offset: bigint, limit: bigint, returned: bigint, next_offset: bigint>").alias("j"))
    rows = read.select("j.schema_version", "j.meta", F.posexplode("j.sessions").alias("place", "s"))
    hidden = sum((F.col(f"s.{c}").isNotNull().cast("int") for c in ("content", "mtime", "yolo")), F.lit(0))
    return rows.select(
        "place", "schema_version", "s.id", "s.agent", "s.title", "s.directory", F.substring("s.timestamp", 1, 19).alias("timestamp"), "s.message_count", F.array_join("s.resume_command", " ").alias("resume_command"),
        "meta.state", "meta.total", "meta.returned", "meta.next_offset", hidden.alias("hidden"),
    )


# -- joins ---------------------------------------------------------------------


@query("enrich_title", sql.with_sessions("""SELECT s.id, s.agent, CASE WHEN CAST(s.id AS BIGINT) % 3 = 0 THEN 'named ' || s.id ELSE s.title END AS title, s.directory,
  CASE WHEN CAST(s.id AS BIGINT) % 3 <> 2 THEN greatest(s.mtime, 1704300000.0) ELSE s.mtime END AS mtime FROM v_sessions s"""))
def enrich_title(spark, sf):
    s = views.sessions(spark, sf)
    c = F.col("id").cast("long")
    lookup = views.listed(spark, sf).where(c % 3 != 2).select("agent", "id", F.when(c % 3 == 0, F.concat(F.lit("named "), "id")).otherwise(" ").alias("title"), F.lit("").alias("directory"), F.lit(1704300000.0).alias("mtime"))
    return refresh.enrich(s, lookup).select("id", "agent", "title", "directory", "mtime")


@query("latest_lookup", """SELECT user_id AS id, event_id AS line_no, event_type AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE value > 2) WHERE n = 1 AND NOT (event_type = 'error')""")
def latest_lookup(spark, sf):
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("line_no"), F.col("event_type").alias("name"), (F.col("value") > 2).alias("valid"), (F.col("event_type") == "error").alias("deleted"))
    return refresh.latest_lookup(e).select("id", "line_no", "name")


@query("join_session_message", """WITH s AS (SELECT conv_id, count(*) FILTER (role = 'user') AS message_count FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0)
SELECT CAST(s.conv_id AS VARCHAR) AS session_id, any_value(message_count) AS message_count, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content, count(*) AS n_messages, max(turn) AS last_message
FROM s JOIN conversations c ON c.conv_id = s.conv_id GROUP BY s.conv_id""")
def join_session_message(spark, sf):
    t = views.table(spark, sf, "conversations").withColumn("session_id", F.col("conv_id").cast("string"))
    s = t.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("message_count"))
    return refresh.sessions_messages(s, t.select("session_id", "role", "text", F.col("turn").alias("created_at"), F.col("turn").alias("seq")))


@query("join_session_parts", """SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS n_messages, string_agg(array_to_string(string_split(text, '. '), chr(10)), chr(10) || chr(10) ORDER BY turn) AS content
FROM conversations GROUP BY conv_id""")
def join_session_parts(spark, sf):
    s, m, p = views.parts(spark, sf)
    return refresh.sessions_parts(s.select("session_id"), m, p)


@query("activity_marker", """SELECT CAST(conv_id AS VARCHAR) AS session_id, max(greatest(conv_id * 1000 + 7, conv_id * 1000 + turn * 3, conv_id * 1000 + turn * 2 + len(string_split(text, '. ')) - 1)) AS marker
FROM conversations GROUP BY conv_id""")
def activity_marker(spark, sf):
    return refresh.activity_marker(*views.parts(spark, sf))


@query("detect_changes", sql.with_sessions("SELECT s.agent, s.id, s.mtime FROM v_sessions s LEFT JOIN v_known k ON k.agent = s.agent AND k.id = s.id WHERE k.mtime IS NULL OR abs(s.mtime - k.mtime) > 0.001", sql.V_KNOWN))
def detect_changes(spark, sf):
    return refresh.detect_changes(views.listed(spark, sf), views.known(spark, sf)).select("agent", "id", "mtime")


@query("detect_deletes", sql.with_sessions("""SELECT agent, id FROM v_known k WHERE NOT EXISTS (SELECT 1 FROM v_sessions s WHERE s.agent = k.agent AND s.id = k.id)
AND agent IN (SELECT agent FROM v_status WHERE complete AND NOT failed)""", sql.V_KNOWN))
def detect_deletes(spark, sf):
    return refresh.detect_deletes(views.known(spark, sf), views.listed(spark, sf), views.scan_status(spark))


_PLAN = """v_plan AS (
  SELECT agent, id, op, CASE WHEN op = 'upsert' THEN now END AS mtime FROM (
    SELECT coalesce(s.agent, k.agent) AS agent, coalesce(s.id, k.id) AS id, s.mtime AS now,
      CASE WHEN failed THEN NULL WHEN s.mtime IS NULL THEN CASE WHEN complete THEN 'delete' END
           WHEN NOT (k.mtime IS NULL OR abs(s.mtime - k.mtime) > 0.001) THEN NULL
           WHEN CAST(s.id AS BIGINT) % 4 = 0 THEN CASE WHEN k.mtime IS NOT NULL THEN 'delete' END
           WHEN CAST(s.id AS BIGINT) % 4 = 1 THEN 'keep' ELSE 'upsert' END AS op
    FROM v_sessions s FULL JOIN v_known k ON k.agent = s.agent AND k.id = s.id JOIN v_status t ON t.agent = coalesce(s.agent, k.agent)) WHERE op IS NOT NULL)"""


def _plan(spark, sf):
    current, known = views.listed(spark, sf), views.known(spark, sf)
    c = F.col("id").cast("long") % 4
    parsed = refresh.detect_changes(current, known).select("agent", "id", F.when(c == 0, "delete").when(c == 1, "retain").otherwise("session").alias("parse_outcome"))
    return refresh.plan_refresh(current, parsed, known, views.scan_status(spark)), known


@query("plan_refresh", sql.with_sessions("SELECT agent, id, op, mtime FROM v_plan", sql.V_KNOWN, _PLAN))
def plan_refresh(spark, sf):
    return _plan(spark, sf)[0]


@query("refresh_summary", sql.with_sessions("""SELECT (SELECT count(*) FROM v_known) + count(*) FILTER (op = 'upsert' AND NOT EXISTS (SELECT 1 FROM v_known k WHERE k.agent = p.agent AND k.id = p.id))
  - count(*) FILTER (op = 'delete') AS sessions, count(*) FILTER (op = 'upsert') AS new_or_modified, count(*) FILTER (op = 'delete') AS deleted FROM v_plan p""", sql.V_KNOWN, _PLAN))
def refresh_summary(spark, sf):
    return refresh.refresh_summary(*_plan(spark, sf))


@query("semi_changed", sql.with_sessions("""SELECT m.agent, m.session_id, m.seq FROM v_messages m JOIN (
  SELECT s.agent, s.id FROM v_sessions s LEFT JOIN v_known k ON k.agent = s.agent AND k.id = s.id WHERE k.mtime IS NULL OR abs(s.mtime - k.mtime) > 0.001) c ON c.agent = m.agent AND c.id = m.session_id""", sql.V_KNOWN))
def semi_changed(spark, sf):
    changed = refresh.detect_changes(views.listed(spark, sf), views.known(spark, sf)).select("agent", F.col("id").alias("session_id"))
    return refresh.semi_changed(views.messages(spark, sf), changed, ["agent", "session_id"]).select("agent", "session_id", "seq")


@query("resume_command", sql.with_sessions(f"SELECT agent, id, array_to_string(CASE agent {_ARGV} END, ' ') AS resume_command FROM v_sessions"))
def resume_command(spark, sf):
    return refresh.with_resume_command(views.sessions(spark, sf)).select("agent", "id", F.array_join("resume_command", " ").alias("resume_command"))


# -- statistics ----------------------------------------------------------------


@query("stats_totals", sql.with_sessions("""SELECT count(*) AS sessions, CAST(coalesce(sum(message_count), 0) AS BIGINT) AS messages, CAST(coalesce(round(avg(message_count), 1), 0) AS DOUBLE) AS avg_messages,
  min(timestamp) AS oldest, max(timestamp) AS newest FROM v_sessions WHERE contains(directory, '/work')"""))
def stats_totals(spark, sf):
    return stats.totals(filters.apply(views.listed(spark, sf), filters.stats_filter(None, "/work")))


@query("stats_by_agent", sql.with_sessions("SELECT agent, count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages, CAST(sum(octet_length(encode(content))) AS BIGINT) AS content_bytes FROM v_sessions GROUP BY agent"))
def stats_by_agent(spark, sf):
    return stats.by_agent(views.sessions(spark, sf))


@query("top_directories", sql.with_sessions("""SELECT CASE WHEN directory = '' THEN 'n/a' WHEN directory = '/work' OR starts_with(directory, '/work/') THEN '~' || substr(directory, 6) ELSE directory END AS directory,
  count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages FROM v_sessions GROUP BY 1 ORDER BY sessions DESC, messages DESC, directory LIMIT 10"""))
def top_directories(spark, sf):
    return stats.top_directories(views.listed(spark, sf), 10, "/work")


@query("by_weekday", sql.with_sessions("""SELECT ord, weekday, count(id) AS sessions FROM (VALUES (0, 'Mon'), (1, 'Tue'), (2, 'Wed'), (3, 'Thu'), (4, 'Fri'), (5, 'Sat'), (6, 'Sun')) d(ord, weekday)
LEFT JOIN v_sessions ON strftime(timestamp, '%a') = weekday GROUP BY ord, weekday"""))
def by_weekday(spark, sf):
    return stats.by_weekday(views.listed(spark, sf))


@query("by_hour", sql.with_sessions("SELECT CAST(h AS INTEGER) AS hour, count(id) AS sessions FROM range(24) r(h) LEFT JOIN v_sessions ON hour(timestamp) = h GROUP BY h"))
def by_hour(spark, sf):
    return stats.by_hour(views.listed(spark, sf))


@query("peak_hours", sql.with_sessions("SELECT CAST(hour(timestamp) AS INTEGER) AS hour, count(*) AS sessions FROM v_sessions GROUP BY 1 ORDER BY sessions DESC, hour LIMIT 3"))
def peak_hours(spark, sf):
    return stats.peak_hours(views.listed(spark, sf))


@query("activity_scale", sql.with_sessions("""SELECT hour, sessions, CASE WHEN sessions = 0 THEN 0 ELSE CAST(greatest(floor(sessions / top * 24 + 0.5), 1) AS BIGINT) END AS bar,
  CASE WHEN sessions = 0 THEN 0 ELSE CAST(ceil(sessions / top * 7) AS BIGINT) END AS level
FROM (SELECT *, max(sessions) OVER () AS top FROM (SELECT CAST(h AS INTEGER) AS hour, count(id) AS sessions FROM range(24) r(h) LEFT JOIN v_sessions ON hour(timestamp) = h GROUP BY h))"""))
def activity_scale(spark, sf):
    return stats.scaled(stats.by_hour(views.listed(spark, sf)))


_SETS = "count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS messages, CAST(sum(octet_length(encode(content))) AS BIGINT) AS content_bytes FROM v_sessions"


@query("stats_grouping_sets", sql.with_sessions(f"""SELECT 'agent' AS kind, agent AS key, {_SETS} GROUP BY agent
UNION ALL SELECT 'weekday', strftime(timestamp, '%a'), {_SETS} GROUP BY 2 UNION ALL SELECT 'hour', CAST(hour(timestamp) AS VARCHAR), {_SETS} GROUP BY 2 UNION ALL SELECT 'all', '', {_SETS}"""))
def stats_grouping_sets(spark, sf):
    return stats.grouping_sets(views.sessions(spark, sf))


@query("agent_facets", sql.with_sessions("SELECT ord, agent, badge, count(*) AS sessions FROM v_sessions JOIN v_dim USING (agent) GROUP BY ALL", sql.V_DIM))
def agent_facets(spark, sf):
    return stats.agent_facets(views.listed(spark, sf))


_RAW = "SELECT agent, count(*) AS file_count, CAST(sum(length(text)) AS BIGINT) AS total_bytes FROM (SELECT [" + ", ".join(f"'{a}'" for a in AGENT_NAMES[:7]) + "][doc_id % 7 + 1] AS agent, text FROM documents) GROUP BY agent"


def _files(spark, sf):
    d = views.table(spark, sf, "documents")
    agent = F.element_at(F.array(*[F.lit(a) for a in AGENT_NAMES[:7]]), (F.col("doc_id") % 7 + 1).cast("int"))
    return d.select(agent.alias("agent"), F.col("doc_id").cast("string").alias("path"), F.char_length("text").cast("long").alias("size"))


@query("raw_stats", f"WITH {sql.V_DIM}, r AS ({_RAW}) SELECT d.agent, r.agent IS NOT NULL AS available, coalesce(file_count, 0) AS file_count, coalesce(total_bytes, 0) AS total_bytes FROM v_dim d LEFT JOIN r ON r.agent = d.agent")
def raw_stats(spark, sf):
    return stats.raw_store_stats(_files(spark, sf))


def _human(c: str) -> str:
    return f"CASE WHEN {c} < 1024 THEN CAST({c} AS VARCHAR) || ' B' WHEN {c} < 1048576 THEN printf('%.1f KB', {c} / 1024.0) WHEN {c} < 1073741824 THEN printf('%.1f MB', {c} / 1048576.0) ELSE printf('%.1f GB', {c} / 1073741824.0) END"


@query("agent_report", sql.with_sessions(f"""SELECT *, {_human("content_bytes")} AS content_size, {_human("total_bytes")} AS raw_size FROM (
  SELECT coalesce(s.agent, r.agent) AS agent, coalesce(sessions, 0) AS sessions, coalesce(messages, 0) AS messages, coalesce(content_bytes, 0) AS content_bytes, coalesce(file_count, 0) AS file_count, coalesce(total_bytes, 0) AS total_bytes
  FROM (SELECT agent, {_SETS} GROUP BY agent) s FULL JOIN ({_RAW}) r ON r.agent = s.agent)"""))
def agent_report(spark, sf):
    return stats.agent_report(stats.by_agent(views.sessions(spark, sf)), stats.raw_store_stats(_files(spark, sf)))


# -- keeping sessions ----------------------------------------------------------


def _scanned_twice(spark, sf):
    s = views.sessions(spark, sf)
    c = F.col("id").cast("long")
    again = s.where(c % 3 != 2).withColumn("mtime", F.col("mtime") + F.when(c % 3 == 0, 10.0).otherwise(-10.0)).withColumn("title", F.concat(F.lit("again "), "title"))
    return s.unionByName(again)


@query("dedupe_sessions", sql.with_sessions("""SELECT id, agent, CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN 'again ' || title ELSE title END AS title, directory, timestamp, content, message_count,
  CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN mtime + 10.0 ELSE mtime END AS mtime, yolo FROM v_sessions"""))
def dedupe_sessions(spark, sf):
    return refresh.dedupe_sessions(_scanned_twice(spark, sf))


@query("precedence_union", sql.with_sessions("""SELECT agent, id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'store' ELSE 'log' END AS source,
  CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN greatest(mtime, CASE WHEN CAST(id AS BIGINT) % 5 <> 0 THEN mtime + 3 END) ELSE mtime + 3 END AS mtime
FROM v_sessions WHERE CAST(id AS BIGINT) % 2 = 0 OR CAST(id AS BIGINT) % 5 <> 0"""))
def precedence_union(spark, sf):
    s, c = views.listed(spark, sf).select("agent", "id", "mtime"), F.col("id").cast("long")
    store = s.where(c % 2 == 0).withColumn("source", F.lit("store"))
    log = s.where(c % 5 != 0).withColumn("source", F.lit("log")).withColumn("mtime", F.col("mtime") + 3)
    return refresh.union_by_precedence(store, log)


@query("prefer_file", """SELECT doc_id AS session_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN length(text) % 50 > 0 AND length(text) % 50 >= length(text) % 40 THEN 'full' ELSE 'regular' END
  WHEN doc_id % 3 = 1 THEN 'regular' WHEN length(text) % 50 > 0 THEN 'full' END AS chosen FROM documents WHERE doc_id % 3 < 2 OR length(text) % 50 > 0""")
def prefer_file(spark, sf):
    from sessionlake.sources.scan import prefer_file as prefer

    d = views.table(spark, sf, "documents").select(F.col("doc_id").alias("session_id"), F.char_length("text").cast("long").alias("n"))
    full = d.where("session_id % 3 in (0, 2)").select("session_id", F.lit("full").alias("variant"), (F.col("n") % 50).alias("size"), F.lit("full").alias("path"))
    regular = d.where("session_id % 3 in (0, 1)").select("session_id", F.lit("regular").alias("variant"), (F.col("n") % 40).alias("size"), F.lit("regular").alias("path"))
    return prefer(full.unionByName(regular)).select("session_id", F.col("path").alias("chosen"))


_HEALTH = """v_class AS (SELECT path, CASE WHEN bad = 0 THEN 'CLEAN' WHEN ok = 0 OR last_bad > last_ok THEN 'INVALID' ELSE 'PARTIAL' END AS health
FROM (SELECT path, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS bad, max(line_no) FILTER (ok) AS last_ok, max(line_no) FILTER (NOT ok) AS last_bad FROM v_health GROUP BY path))"""


@query("jsonl_health", f"WITH {sql.V_HEALTH}, {_HEALTH} SELECT path, health FROM v_class")
def jsonl_health(spark, sf):
    from sessionlake.sources.scan import jsonl_health as health

    views.configure(spark)
    return health(views.health_lines(spark, sf))


@query("gate_outcome", f"""WITH {sql.V_HEALTH}, {_HEALTH} SELECT path, CASE health WHEN 'INVALID' THEN 'retain' WHEN 'PARTIAL' THEN CASE WHEN CAST(path AS BIGINT) % 2 = 0 THEN 'session' ELSE 'retain' END
  ELSE CASE WHEN CAST(path AS BIGINT) % 3 > 0 THEN 'session' ELSE 'delete' END END AS outcome FROM (SELECT path, health FROM v_class)""".replace("CASE WHEN CAST(path AS BIGINT) % 2 = 0 THEN", "CASE WHEN CAST(path AS BIGINT) % 2 = 0 AND CAST(path AS BIGINT) % 3 > 0 THEN"))
def gate_outcome(spark, sf):
    p = F.col("path").cast("long")
    files = jsonl_health(spark, sf).withColumn("parsed", p % 3 > 0).withColumn("usable", p % 2 == 0)
    return refresh.gate_outcome(files).select("path", "outcome")


def _log(spark, sf):
    s = views.sessions(spark, sf)
    c = F.col("id").cast("long")
    first = refresh.log_rows(s, 1)
    second = refresh.log_rows(s.where(c % 4 == 0).withColumn("title", F.concat(F.lit("v2 "), "title")), 2)
    third = refresh.log_rows(s.where(c % 6 == 0).select("agent", "id"), 3, "delete")
    return first.unionByName(second).unionByName(third)


_SNAPSHOT = sql.with_sessions("""SELECT id, agent, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'v2 ' || title ELSE title END AS title, directory, timestamp, content, message_count, mtime, yolo
FROM v_sessions WHERE CAST(id AS BIGINT) % 6 <> 0""")


@query("latest_snapshot", _SNAPSHOT)
def latest_snapshot(spark, sf):
    return refresh.latest_snapshot(_log(spark, sf))
