"""DuckDB SQL of the session views, and helpers to write the queries' SQL."""

from __future__ import annotations

import re

from sessionlake.model import AGENT_NAMES, AGENTS
from sessionlake.plans.views import AS_OF, CLAUSE_QUERIES, QUERIES, SPREAD

NOW = f"TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}'"
_AGENTS = ", ".join(f"'{a}'" for a in AGENT_NAMES)
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def truncated(expr: str, limit: int, word_break: bool = True) -> str:
    t = _TRIM.format(expr)
    head = f"left({t}, {limit})"
    if word_break:
        head = f"regexp_replace({head}, ' [^ ]*$', '')"
    return f"CASE WHEN length({t}) <= {limit} THEN {t} ELSE {head} || '...' END"


def tokens(expr: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({expr}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '' AND octet_length(encode(t)) < 40)"


V_MESSAGES = f"""v_messages AS (
  SELECT [{_AGENTS}][conv_id % 12 + 1] AS agent, CAST(conv_id AS VARCHAR) AS session_id, conv_id, turn AS seq, role, text,
         CASE role WHEN 'user' THEN '» ' ELSE '  ' END || text AS rendered
  FROM conversations WHERE role IN ('user', 'assistant'))"""

V_SESSIONS = f"""{V_MESSAGES},
v_made AS (
  SELECT agent, session_id, conv_id, string_agg(rendered, chr(10) || chr(10) ORDER BY seq) AS content,
         arg_min(text, seq) FILTER (role = 'user') AS first_user, count(*) FILTER (role = 'user') AS message_count
  FROM v_messages GROUP BY agent, session_id, conv_id HAVING count(*) FILTER (role = 'user') > 0),
v_sessions AS (
  SELECT session_id AS id, agent, {truncated("first_user", 100)} AS title,
         CASE WHEN conv_id % 17 = 0 THEN '' ELSE '/work/' || event_type || '/u' || CAST(user_id % 10 AS VARCHAR) END AS directory,
         CAST(ts AS TIMESTAMP) AS timestamp, content, message_count, epoch_us(CAST(ts AS TIMESTAMP)) / 1000000.0 AS mtime, value > 20 AS yolo
  FROM v_made JOIN events ON event_id = conv_id * {SPREAD})"""

V_KNOWN = """v_known AS (
  SELECT agent, id, mtime + CASE CAST(id AS BIGINT) % 10 WHEN 1 THEN 5.0 WHEN 2 THEN 0.0005 ELSE 0.0 END AS mtime
  FROM v_sessions WHERE CAST(id AS BIGINT) % 10 <> 0
  UNION ALL SELECT CASE WHEN n % 2 = 0 THEN 'codex' ELSE 'kimi' END, 'gone-' || CAST(n AS VARCHAR), 1.0 FROM range(5) r(n)),
v_status AS (SELECT agent, agent <> 'kimi' AS complete, agent = 'grok' AS failed FROM unnest([""" + _AGENTS + """]) a(agent))"""

V_DIM = "v_dim(agent, badge, ord) AS (VALUES " + ", ".join(f"('{a[0]}', '{a[1]}', {i})" for i, a in enumerate(AGENTS)) + ")"



def _log(queries) -> str:
    return "v_queries(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in queries) + ")"


V_QUERIES = _log(QUERIES)

V_HEALTH = """v_health AS (
  SELECT CAST(c.conv_id AS VARCHAR) AS path, turn AS line_no,
         NOT ((c.conv_id % 5 = 0 AND turn = last) OR (c.conv_id % 5 = 1 AND turn = 0)) AS ok
  FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) e ON c.conv_id = e.conv_id)"""

V_POSTINGS = f"""v_tokens AS (
  SELECT agent, id, 'title' AS field, unnest({tokens("title")}) AS term FROM v_sessions
  UNION ALL SELECT agent, id, 'content', unnest({tokens("content")}) FROM v_sessions
  UNION ALL SELECT agent, id, 'directory', directory FROM v_sessions WHERE directory <> ''),
v_postings AS (
  SELECT agent, id, field, term, tf, CAST(sum(tf) OVER (PARTITION BY agent, id, field) AS BIGINT) AS len
  FROM (SELECT agent, id, field, term, count(*) AS tf FROM v_tokens GROUP BY ALL)),
v_totals AS (SELECT field, (SELECT count(*) FROM v_sessions) AS docs, sum(tf) / (SELECT count(*) FROM v_sessions) AS avg_len FROM v_postings GROUP BY field)"""

_ENTRY = "STRUCT(role VARCHAR, text VARCHAR, turn BOOLEAN, anchor BOOLEAN, summary BOOLEAN)[]"

#: Events made from the conversations, and their fold row by row: entries, held back ones, place of the open step (0: none).
V_HISTORY = f"""v_events AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role, text,
    CASE (turn + conv_id) % 9 WHEN 1 THEN 'step_begin' WHEN 2 THEN 'part' WHEN 3 THEN 'tool_call' WHEN 5 THEN CASE WHEN conv_id % 2 = 0 THEN 'tool_result' ELSE 'step_end' END
      WHEN 7 THEN CASE conv_id % 3 WHEN 0 THEN 'undo' WHEN 1 THEN 'clear' ELSE 'compaction' END WHEN 8 THEN 'part' ELSE CASE WHEN role = 'system' THEN 'none' ELSE 'message' END END AS kind
  FROM conversations),
v_fold AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, CAST([] AS {_ENTRY}) AS kept, CAST([] AS {_ENTRY}) AS held, CAST(0 AS BIGINT) AS open, false AS pending, CAST(0 AS BIGINT) AS floor, true AS allowed FROM conversations
  UNION ALL
  SELECT conv_id, n,
    CASE WHEN kind = 'message' AND NOT pending THEN list_append(kept, said) WHEN kind = 'step_begin' THEN list_append(kept || held, step)
      WHEN kind = 'part' AND open > 0 THEN kept[1:open - 1] || [struct_pack(role := 'assistant', text := kept[open].text || text, turn := false, anchor := false, summary := false)] || kept[open + 1:]
      WHEN kind = 'tool_result' AND pending OR kind = 'step_end' AND NOT pending THEN kept || held
      WHEN kind = 'compaction' THEN list_append(kept, brief) WHEN kind = 'undo' THEN kept[1:CASE WHEN len(anchors) > 0 THEN anchors[-1] - 1 ELSE base END] ELSE kept END,
    CASE WHEN kind = 'message' AND pending THEN list_append(held, said) WHEN kind IN ('step_begin', 'compaction', 'undo', 'clear') OR kind = 'tool_result' AND pending OR kind = 'step_end' AND NOT pending THEN CAST([] AS {_ENTRY}) ELSE held END,
    CASE WHEN kind = 'step_begin' THEN len(kept) + len(held) + 1 WHEN kind IN ('step_end', 'compaction', 'undo', 'clear') THEN 0 ELSE open END,
    CASE WHEN kind = 'tool_call' THEN pending OR open > 0 WHEN kind IN ('step_begin', 'tool_result', 'compaction', 'undo', 'clear') THEN false ELSE pending END,
    CASE WHEN kind = 'clear' THEN len(kept) ELSE floor END,
    CASE WHEN kind = 'message' AND role = 'user' THEN true WHEN kind IN ('undo', 'clear') THEN false ELSE allowed END
  FROM (SELECT *, list_filter(range(base + 1, len(kept) + 1), lambda i: kept[i].anchor) AS anchors FROM (
    SELECT f.conv_id, e.n, e.kind, e.role, e.text, kept, held, open, pending, floor, allowed,
      struct_pack(role := e.role, text := e.text, turn := e.role = 'user', anchor := e.role = 'user', summary := false) AS said,
      struct_pack(role := 'assistant', text := '', turn := false, anchor := false, summary := false) AS step,
      struct_pack(role := 'user', text := e.text, turn := false, anchor := false, summary := true) AS brief,
      greatest(floor, coalesce(list_max(list_filter(range(1, len(kept) + 1), lambda i: kept[i].summary)), 0)) AS base
    FROM v_fold f JOIN v_events e ON e.conv_id = f.conv_id AND e.n = f.n + 1))),
v_left AS (
  SELECT conv_id, allowed, CASE WHEN conv_id % 4 = 0 AND allowed AND len(list_filter(kept, lambda e: e.turn)) = 0
    THEN list_append(kept, struct_pack(role := 'user', text := 'last ' || CAST(conv_id AS VARCHAR), turn := true, anchor := true, summary := false)) ELSE kept END AS kept
  FROM (SELECT *, max(n) OVER (PARTITION BY conv_id) AS latest FROM v_fold) WHERE n = latest),
v_entries AS (
  SELECT conv_id, allowed, i - 1 AS place, kept[i].role AS role, kept[i].text AS text, kept[i].turn AS turn
  FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS i FROM v_left) WHERE kept[i].text <> '')"""

#: Parsed queries: filters as lists, date as cutoff, end and direction.
V_PARSED_OF = r"""v_hits AS (
  SELECT query_id, k, a[k] AS no, b[k] AS key, CASE WHEN c[k] <> '' THEN c[k] ELSE d[k] END AS value
  FROM (SELECT query_id, unnest(generate_series(1, len(a))) AS k, a, b, c, d FROM (
    SELECT query_id, regexp_extract_all(query, re, 1) AS a, regexp_extract_all(query, re, 2) AS b, regexp_extract_all(query, re, 3) AS c, regexp_extract_all(query, re, 4) AS d
    FROM v_queries, (SELECT '(-?)(agent|dir|date):(?:"([^"]+)"|(\S+))' AS re)))),
v_last AS (
  SELECT query_id, key, arg_max(no, k) = '-' AS no, arg_max(value, k) AS value FROM v_hits GROUP BY query_id, key),
v_values AS (
  SELECT query_id, key, regexp_replace(v, '^!', '') AS v, starts_with(v, '!') OR no AS ex, n
  FROM (SELECT query_id, key, no, trim(unnest(string_split(CASE key WHEN 'agent' THEN lower(value) ELSE value END, ','))) AS v,
               unnest(generate_series(1, len(string_split(value, ',')))) AS n FROM v_last WHERE key <> 'date') WHERE v <> ''),
v_dates AS (
  SELECT query_id, no OR starts_with(value, '!') AS negated, lower(trim(regexp_replace(value, '^!', ''))) AS word FROM v_last WHERE key = 'date'),
v_dated AS (
  SELECT query_id, negated, word, @NOW AS now,
         TRY_CAST(regexp_extract(word, '^[<>]?(\d+)', 1) AS DOUBLE) * CASE regexp_extract(word, '^[<>]?\d+(m|h|d|w|mo|y)$', 1)
           WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 WHEN 'w' THEN 604800 WHEN 'mo' THEN 2592000 WHEN 'y' THEN 31536000 END AS secs FROM v_dates),
v_cut AS (
  SELECT query_id, negated, word,
    CASE WHEN word IN ('today', 'yesterday') THEN 'exact' WHEN secs <= 60000000000 AND starts_with(word, '>') THEN 'greater' ELSE 'less' END AS op,
    CASE WHEN word = 'today' THEN date_trunc('day', now) WHEN word = 'yesterday' THEN date_trunc('day', now) - INTERVAL 1 DAY
         WHEN word = 'week' THEN now - INTERVAL 7 DAY WHEN word = 'month' THEN now - INTERVAL 30 DAY
         WHEN secs <= 60000000000 THEN make_timestamp(CAST(epoch_us(now) - secs * 1000000 AS BIGINT)) END AS cutoff,
    CASE WHEN word = 'yesterday' THEN date_trunc('day', now) END AS until FROM v_dated),
v_parsed AS (
  SELECT q.query_id, trim(regexp_replace(regexp_replace(query, '(-?)(agent|dir|date):(?:"([^"]+)"|(\S+))', '', 'g'), '\s+', ' ', 'g')) AS text,
    coalesce((SELECT list(v ORDER BY n) FROM v_values x WHERE x.query_id = q.query_id AND key = 'agent' AND NOT ex), []) AS agent_include,
    coalesce((SELECT list(v ORDER BY n) FROM v_values x WHERE x.query_id = q.query_id AND key = 'agent' AND ex), []) AS agent_exclude,
    coalesce((SELECT list(v ORDER BY n) FROM v_values x WHERE x.query_id = q.query_id AND key = 'dir' AND NOT ex), []) AS dir_include,
    coalesce((SELECT list(v ORDER BY n) FROM v_values x WHERE x.query_id = q.query_id AND key = 'dir' AND ex), []) AS dir_exclude,
    CASE WHEN cutoff IS NOT NULL THEN op END AS op, cutoff, until, negated
  FROM v_queries q LEFT JOIN v_cut c ON c.query_id = q.query_id)""".replace("@NOW", NOW)
V_PARSED = f"{V_QUERIES},\n{V_PARSED_OF}"

#: A search string from each turn, parsed.
V_LOG = f"""v_queries AS (
  SELECT conv_id * 100 + turn AS query_id, CASE (conv_id + turn) % 6 WHEN 0 THEN 'agent:' || role || ',!Pi ' || substr(text, 1, 20) WHEN 1 THEN '-dir:"' || substr(text, 1, 8) || '" ' || substr(text, 10, 12)
    WHEN 2 THEN 'date:<' || CAST(turn AS VARCHAR) || 'd ' || substr(text, 1, 10) WHEN 3 THEN 'xagent:claude,' || role || ' date:soon'
    WHEN 4 THEN substr(text, 1, 30) || ' date:yesterday agent:' || role ELSE 'dir:a dir:' || role || ' -date:>' || CAST(conv_id AS VARCHAR) || 'h' END AS query FROM conversations),
{V_PARSED_OF}"""

PASSES = """(len(agent_include) = 0 OR list_contains(agent_include, s.agent)) AND NOT list_contains(agent_exclude, s.agent)
  AND (len(dir_include) = 0 OR len(list_filter(dir_include, lambda x: contains(lower(s.directory), lower(x)))) > 0)
  AND len(list_filter(dir_exclude, lambda x: contains(lower(s.directory), lower(x)))) = 0
  AND (cutoff IS NULL OR CASE WHEN negated THEN NOT (CASE WHEN op = 'greater' THEN s.timestamp < cutoff ELSE s.timestamp >= cutoff AND (until IS NULL OR s.timestamp < until) END)
       ELSE (CASE WHEN op = 'greater' THEN s.timestamp < cutoff ELSE s.timestamp >= cutoff AND (until IS NULL OR s.timestamp < until) END) END)"""


def fuzzy_pattern(word: str) -> str:
    """Anchored pattern of all prefixes within one edit or swap of a word."""
    w = [re.escape(c) for c in word]
    out = ["".join(w)]
    for i in range(len(w)):
        out += ["".join(x) for x in ([*w[:i], ".", *w[i + 1 :]], [*w[:i], *w[i + 1 :]], [*w[:i], ".", *w[i:]])]
        if i + 1 < len(w):
            out.append("".join([*w[:i], w[i + 1], w[i], *w[i + 2 :]]))
    return "^(" + "|".join(dict.fromkeys(out)) + ")"


def _patterns(queries) -> str:
    text = [re.sub(r'(-?)(agent|dir|date):(?:"([^"]+)"|(\S+))', "", q) for _, q in queries]
    words = sorted({w.lower() for t in text for w in t.split() if len(w) >= 3})
    return "v_patterns(word, pattern) AS (VALUES " + ", ".join(f"('{w}', '{fuzzy_pattern(w)}')" for w in words) + ")"


_V_WORDS = rf"""v_words AS (
  SELECT query_id, unnest(list_filter(regexp_split_to_array(replace(text, '"', ' '), '\s+'), lambda w: w <> '')) AS word FROM v_parsed),
v_wanted AS (
  SELECT query_id, term, raw, count(*) AS times FROM (
    SELECT query_id, unnest({tokens("word")}) AS term, false AS raw FROM v_words UNION ALL SELECT query_id, word, true FROM v_words) GROUP BY ALL),
v_df AS (SELECT field, term, count(*) AS df FROM v_postings GROUP BY field, term),
v_exact AS (
  SELECT query_id, agent, id, 5.0 * sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM v_postings JOIN v_df USING (field, term) JOIN v_totals USING (field) JOIN v_wanted USING (term)
  WHERE (field = 'directory') = raw GROUP BY query_id, agent, id)"""

_V_REST = rf"""v_fwords AS (
  SELECT query_id, ws, len(ws) AS need FROM (
    SELECT query_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) >= 3) AS ws FROM v_parsed) WHERE len(ws) > 0),
v_fword AS (SELECT query_id, need, unnest(ws) AS word FROM v_fwords),
v_fterm AS (SELECT word, field, term FROM v_df JOIN v_patterns ON regexp_matches(term, pattern) WHERE field IN ('title', 'content')),
v_fdoc AS (SELECT agent, id, word, count(DISTINCT field) AS fields FROM v_postings JOIN v_fterm USING (field, term) GROUP BY agent, id, word),
v_fuzzy AS (
  SELECT query_id, agent, id, CAST(sum(fields) AS DOUBLE) AS score FROM v_fdoc JOIN v_fword USING (word)
  GROUP BY query_id, agent, id, need HAVING count(*) = need),
v_dirs AS (
  SELECT query_id, agent, id, 1.0 AS score FROM v_sessions JOIN v_parsed ON length(text) >= 3 AND NOT contains(text, ' ') AND contains(lower(directory), lower(text))),
v_scores AS (
  SELECT query_id, agent, id, sum(score) AS score FROM (
    SELECT * FROM v_exact UNION ALL SELECT * FROM v_fuzzy UNION ALL SELECT * FROM v_dirs) GROUP BY query_id, agent, id),
v_found AS (
  SELECT p.query_id, s.agent, s.id, s.timestamp, c.score
  FROM v_scores c JOIN v_sessions s ON s.agent = c.agent AND s.id = c.id JOIN v_parsed p ON p.query_id = c.query_id WHERE {PASSES}
  UNION ALL SELECT p.query_id, s.agent, s.id, s.timestamp, 0.0 FROM v_sessions s JOIN v_parsed p ON p.text = '' WHERE {PASSES})"""


def with_sessions(select: str, *views: str) -> str:
    return "WITH " + ",\n".join((V_SESSIONS, *views)) + "\n" + select


SEARCH = (V_PARSED, V_POSTINGS, _V_WORDS, _patterns(QUERIES), _V_REST)

#: The clauses of CLAUSE_QUERIES: query, clause, group of clauses joined by AND, sign, field, raw text, terms.
_CLAUSES = (
    (1, 0, 0, "", "", "of the", "of the"),
    (2, 0, 0, "+", "", "the", "the"), (2, 1, 0, "-", "", "of", "of"),
    (3, 0, 0, "", "title", "the of", "the of"), (3, 1, 0, "", "", "thing", "thing"),
    (4, 0, 1, "", "", "thing", "thing"), (4, 1, 1, "", "", "of", "of"), (4, 2, 0, "", "", "purchase", "purchase"),
    (5, 0, 1, "", "", "the", "the"), (5, 1, 1, "-", "", "of the", "of the"), (5, 2, 0, "", "", "retoin", "retoin"),
    (6, 0, 0, "", "", "in the", "in the"),
    (7, 0, 0, "-", "", "the", "the"),
    (8, 0, 0, "", "content", "the-of", "the of"),
    (9, 0, 0, "+", "", "thing", "thing"), (9, 1, 0, "+", "", "in the", "in the"), (9, 2, 0, "-", "", "zzz", "zzz"),
    (10, 0, 0, "", "", "/work/view/u3", "work view u3"), (10, 1, 0, "", "", "half", "half"), (10, 2, 0, "", "", "of", "of"),
)


def _places(field: str) -> str:
    every = tokens(field).replace(" AND octet_length(encode(t)) < 40", "")
    return f"SELECT agent, id, '{field}' AS field, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT agent, id, {every} AS w FROM v_sessions)"


V_PLACES = f"""v_places AS (
  SELECT * FROM ({_places("title")} UNION ALL {_places("content")}) WHERE octet_length(encode(term)) < 40
  UNION ALL SELECT agent, id, 'directory', directory, 1 FROM v_sessions WHERE directory <> '')"""

#: Scores of clauses: a clause occurs where all its terms stand at their places; then signs and groups decide.
V_CLAUSES = "v_clauses(query_id, clause, grp, sign, field, raw, terms) AS (VALUES " + ", ".join(str(c) for c in _CLAUSES) + """),
v_asked AS (
  SELECT query_id, clause, grp, sign, f.field, CASE f.field WHEN 'directory' THEN [raw] ELSE string_split(terms, ' ') END AS ts
  FROM v_clauses c JOIN (SELECT unnest(['title', 'content', 'directory']) AS field) f ON c.field IN ('', f.field)),
v_term AS (SELECT query_id, clause, grp, sign, field, len(ts) AS n, unnest(ts) AS term, generate_subscripts(ts, 1) AS k FROM v_asked),
v_df AS (SELECT field, term, count(*) AS df FROM v_postings GROUP BY field, term),
v_begin AS (
  SELECT query_id, clause, field, agent, id, pos - k AS begin FROM v_places JOIN v_term USING (field, term) GROUP BY ALL HAVING count(*) = any_value(n)),
v_gain AS (
  SELECT query_id, clause, field, sum(ln(1 + (docs - df + 0.5) / (df + 0.5))) AS gain FROM v_term JOIN v_df USING (field, term) JOIN v_totals USING (field) GROUP BY ALL),
v_lens AS (SELECT DISTINCT agent, id, field, len FROM v_postings),
v_hit AS (
  SELECT query_id, clause, agent, id, sum(gain * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
  FROM (SELECT query_id, clause, field, agent, id, count(*) AS tf FROM v_begin GROUP BY ALL) JOIN v_gain USING (query_id, clause, field) JOIN v_lens USING (agent, id, field) JOIN v_totals USING (field)
  GROUP BY query_id, clause, agent, id),
v_at AS (
  SELECT query_id, agent, id, grp, count(*) FILTER (sign = '+') AS must, count(*) FILTER (sign = '-') AS nots, count(*) FILTER (sign <> '-') AS yes, coalesce(sum(score) FILTER (sign <> '-'), 0) AS score
  FROM v_hit JOIN v_clauses USING (query_id, clause) GROUP BY ALL),
v_need AS (SELECT query_id, grp, count(*) FILTER (sign = '+') AS must, count(*) FILTER (sign <> '-') AS yes FROM v_clauses GROUP BY ALL),
v_sum AS (
  SELECT query_id, agent, id, sum(CASE WHEN grp = 0 THEN a.score WHEN a.nots = 0 AND a.yes = n.yes THEN a.score ELSE 0 END) AS score,
    coalesce(any_value(a.must) FILTER (grp = 0), 0) AS must, coalesce(any_value(a.nots) FILTER (grp = 0), 0) AS nots,
    bool_or(CASE WHEN grp = 0 THEN a.yes > 0 ELSE a.nots = 0 AND a.yes = n.yes END) AS any_yes
  FROM v_at a JOIN v_need n USING (query_id, grp) GROUP BY query_id, agent, id),
v_exact AS (
  SELECT query_id, agent, id, 5.0 * s.score AS score FROM v_sum s LEFT JOIN (SELECT query_id, must AS needed FROM v_need WHERE grp = 0) USING (query_id)
  WHERE must = coalesce(needed, 0) AND nots = 0 AND any_yes)"""

CLAUSE_SEARCH = (_log(CLAUSE_QUERIES), V_PARSED_OF, V_POSTINGS, V_PLACES, V_CLAUSES, _patterns(CLAUSE_QUERIES), _V_REST)
