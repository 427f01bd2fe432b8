"""Operators on small hand-written tables."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sessionlake.functions import json as fj
from sessionlake.functions import paths, text, times
from sessionlake.model import AGENT_NAMES, SESSIONS, configure
from sessionlake.operators import filters, messages, refresh, search, search_index, stats
from sessionlake.sources import scan

NOW = dt.datetime(2024, 5, 20, 12)


@pytest.fixture(scope="module", autouse=True)
def conf(spark):
    configure(spark)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def session(id, agent, title="", directory="", ts=NOW, content="", count=2, mtime=1.0, yolo=False):
    return (id, agent, title, directory, ts, content, count, mtime, yolo)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SESSIONS)


# -- columns


@pytest.mark.parametrize(
    ("raw", "ok"),
    [('{"a":1}', True), ('{"a":1} x', False), ('{"a":1}{"b":2}', False), ("1,2", False), ('{"a":1}],[2', False), ('{"a":1}]', False), ("", False), ("  ", False), ("null", True), ("[1,2]", True), ('{"a":1,"a":2}', True), ("{", False)],
)
def test_strict_json(spark, raw, ok):
    assert one(spark, fj.is_strict_json(F.lit(raw))) is ok


def test_health_classes(spark):
    files = {"clean": ['{"valid":true}'], "partial": ["{}", "{", "{}"], "trailing": ["{}", "{"], "invalid": ["{"], "blank": ["", " "]}
    value = [(f"/{p}.jsonl", 1.0, 1, "\n".join(x)) for p, x in files.items()] + [("/empty.jsonl", 1.0, 0, "")]
    df = spark.createDataFrame(value, "path string, mtime double, size bigint, value string")
    got = {r.path[1:-6]: r.health for r in scan.file_health(df).collect()}
    assert got == {"clean": "CLEAN", "partial": "PARTIAL", "trailing": "INVALID", "invalid": "INVALID", "blank": "CLEAN", "empty": "CLEAN"}


def test_content_texts(spark):
    def texts(raw):
        return one(spark, fj.content_texts(F.parse_json(F.lit(raw))))

    assert texts('"hi"') == ["hi"]
    assert texts('[{"text":"a"},{"input_text":"b"},"c",{"text":""},{"x":1},7]') == ["a", "b", "c"]
    assert texts("null") == [] and texts("5") == [] and texts('{"text":"a"}') == []


def test_tool_summaries(spark):
    def line(raw):
        return one(spark, fj.tool_summaries(F.lit(raw)))

    parts = '[{"type":"text","data":{"text":"hello"}},{"type":"tool_result","data":{"name":"ls","content":"out"}},{"type":"tool_call","data":{"name":"cat"}},{"type":"tool_result","data":{"content":"' + "x" * 500 + '"}}]'
    assert line(parts) == "hello [ls]: out [calling cat]"
    assert line('[{"type":"tool_result","data":{"content":"' + "y" * 300 + '"}}]') == "[tool]: " + "y" * 200
    assert line("[{") is None and line("[]") == ""


def test_titles(spark):
    def cut(s, n, wb=True):
        return one(spark, text.truncate_title(F.lit(s), n, wb))

    assert cut("  short \n", 10) == "short"
    assert cut("one two three", 9) == "one two..." and cut("one two three", 9, False) == "one two t..."
    assert cut("abcdefghijkl", 5) == "abcde..." and cut("éééééé", 3) == "ééé..."


def test_labels(spark):
    at = F.lit(NOW).cast("timestamp")
    ages = [(30, "now"), (90, "1m"), (7200, "2h"), (3 * 86400, "3d"), (65 * 86400, "2mo"), (800 * 86400, "2y")]
    for seconds, label in ages:
        assert one(spark, text.age_label(F.lit(NOW - dt.timedelta(seconds=seconds)).cast("timestamp"), at)) == label
    for n, label in ((0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (5 << 20, "5.0 MB"), (3 << 30, "3.0 GB"), (1 << 40, "1.0 TB"), (1 << 51, "2048.0 TB")):
        assert one(spark, text.human_bytes(F.lit(n))) == label
    for d, label in (("/home/u", "~"), ("/home/u/a", "~/a"), ("/home/user2", "/home/user2"), ("", "n/a")):
        assert one(spark, text.display_dir(F.lit(d), "/home/u")) == label


def test_timestamps(spark):
    def iso(s):
        return one(spark, times.parse_iso(F.lit(s)))

    assert iso("2024-01-02T03:04:05Z") == dt.datetime(2024, 1, 2, 3, 4, 5) == iso("2024-01-02T05:04:05.000+02:00")
    assert iso("2024-01-02 03:04:05.25") == dt.datetime(2024, 1, 2, 3, 4, 5, 250000)
    assert iso("2024") is None and iso("") is None and iso("soon") is None
    assert one(spark, times.epoch_ts(F.lit("1704067200"))) == one(spark, times.epoch_ts(F.lit("1704067200000"))) == dt.datetime(2024, 1, 1)
    assert one(spark, times.epoch_ts(F.lit("-5"))) is None and one(spark, times.epoch_ts(F.lit("x"))) is None


def test_paths(spark):
    uuid = "0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f"
    cases = [("/x/a.b.jsonl", "stem", "a.b"), ("/x/r-1-2.jsonl", "after_dash", "1-2"), (f"/x/rollout-2024-{uuid}.jsonl", "uuid_tail", uuid), ("/x/short.jsonl", "uuid_tail", "short"), ("/x/t_u_v.jsonl", "after_underscore", "v")]
    cases += [("/x/id/f.json", "parent", "id"), ("/id/a/b/f.json", "great_grandparent", "id"), ("/x/id/events.jsonl", "parent_or_stem", "id"), ("/x/id.jsonl", "parent_or_stem", "id")]
    for path, rule, want in cases:
        assert one(spark, paths.path_id(F.lit(path), rule)) == want
    assert one(spark, paths.percent_decode(F.lit("a%20b+c"))) == "a b+c" and one(spark, paths.percent_decode(F.lit("100%"))) == "100%"
    assert one(spark, paths.absolute_dir(F.lit("%2Fwork"))) == "/work" and one(spark, paths.absolute_dir(F.lit("work"))) is None
    assert one(spark, paths.uri_to_path(F.lit("file:///a%20b"))) == "/a b" and one(spark, paths.uri_to_path(F.lit("vscode://x"))) == ""
    assert one(spark, scan.source_path(F.lit("file:/r/dir=a/dir2=b/file=x.jsonl/part-00000-1.txt"))) == "file:/r/a/b/x.jsonl"


def test_snippets(spark):
    body = "a" * 300 + "NEEDLE" + "b" * 6000
    got = one(spark, text.snippet(F.lit(body), ["needle", "zz"]))
    assert got.startswith("...\n" + "a" * 221 + "NEEDLE") and got.endswith("b\n...") and len(got) == 4 + 221 + 5000 + 4
    assert one(spark, text.snippet(F.lit("short"), [])) == "short" and one(spark, text.snippet(F.lit("c" * 7000), ["x"])) == "c" * 6000 + "\n..."
    assert one(spark, text.snippet(F.lit("À needle"), ["à"])) == "À needle"
    assert one(spark, text.highlight(F.lit("Fast fastest a.b"), ["fast", "a.b"])) == "[[Fast]] [[fast]]est [[a.b]]"


# -- messages


def test_unwrap(spark):
    assert one(spark, messages.unwrap_request(F.lit("x <USER_REQUEST>\n do it \n</USER_REQUEST> y"))) == "do it"
    assert one(spark, messages.unwrap_request(F.lit("plain <ADDITIONAL_METADATA> z"))) == "plain"
    assert one(spark, messages.shell_input(F.lit("<bash-input>a &lt; &amp;lt;</bash-input>"))) == "a < &lt;" and one(spark, messages.shell_input(F.lit("x"))) is None


def test_coalesce_chunks(spark):
    rows = [("user", 1, "He"), ("user", 1, "llo"), ("agent", 1, "Hi"), ("other", None, ""), ("agent", 1, " there"), ("user", 2, "A"), ("bash", 2, "!"), ("user", 2, "B"), ("agent", 2, ""), ("user", 2, "C"), ("user", 3, "D")]
    df = spark.createDataFrame([("s", i, k, p, t) for i, (k, p, t) in enumerate(rows)], "session_id string, seq bigint, kind string, prompt int, text string")
    got = [(r.kind, r.text) for r in messages.coalesce_chunks(df).orderBy("first").collect()]
    assert got == [("user", "Hello"), ("agent", "Hi there"), ("user", "A"), ("user", "B"), ("user", "C"), ("user", "D")]


def test_rewinds_count_surviving_users(spark):
    rows = [("user", "u0", None), ("agent", "a0", None), ("user", "u1", None), ("agent", "a1", None), ("rewind", None, 1), ("user", "u2", None), ("user", "u3", None), ("rewind", None, 2), ("rewind", None, 9), ("agent", "end", None)]
    df = spark.createDataFrame([("s", i, k, t, n) for i, (k, t, n) in enumerate(rows)], "session_id string, seq bigint, kind string, text string, target int")
    assert [r.text for r in messages.fold_rewinds(df).orderBy("seq").collect()] == ["u0", "a0", "u2", "end"]


def folded(spark, *events):
    rows = [("s", i, *e) for i, e in enumerate(events)]
    return [(r.role, *r.texts) for r in messages.fold_history(spark.createDataFrame(rows, messages.HISTORY_EVENTS)).orderBy("place").collect()]


def event(kind, ref=None, call=None, role=None, texts=None, turn=False, anchor=False, summary=False, count=None):
    return (kind, ref, call, role, texts, turn, anchor, summary, count)


def u(t, **more):
    return event("message", role="user", texts=[t], **({"turn": True, "anchor": True} | more))


def a(t):
    return event("message", role="assistant", texts=[t])


def part(step, t):
    return event("part", ref=step, texts=[t])


def test_undo_clear_and_compaction(spark):
    undo, clear = event("undo", count=1), event("clear")
    assert folded(spark, u("u1"), a("a1"), u("u2"), a("a2"), undo) == [("user", "u1"), ("assistant", "a1")]
    assert folded(spark, u("u1"), event("compaction", texts=["sum"]), u("u2"), event("undo", count=5)) == [("user", "u1"), ("user", "sum")]
    assert folded(spark, u("u1"), clear, u("u2"), event("undo", count=5)) == [("user", "u1")]
    assert folded(spark, u("u1"), event("undo")) == folded(spark, u("u1"), event("undo", count=0)) == [("user", "u1")]
    assert folded(spark, u("u1"), u("note", turn=False, anchor=False), undo, a("end")) == [("assistant", "end")]
    begin, call = event("step_begin", "s"), event("tool_call", "s", "c")
    for discards in (undo, clear, event("compaction", texts=[""])):
        assert ("user", "held") not in folded(spark, begin, call, u("held"), discards, part("s", "late"), begin)
    assert folded(spark, u("gone"), undo, event("last_prompt", texts=["gone"])) == []
    assert folded(spark, event("last_prompt", texts=["only"])) == [("user", "only")]
    assert folded(spark, u("u1"), event("last_prompt", texts=["no"])) == [("user", "u1")]


def test_steps_and_what_they_hold_back(spark):
    begin, end, call, result = event("step_begin", "s"), event("step_end", "s"), event("tool_call", "s", "c"), event("tool_result", call="c")
    assert folded(spark, u("q"), begin, part("s", "Hel"), u("note"), part("s", "lo"), part("x", "nowhere"), end, part("s", "too late")) == [("user", "q"), ("assistant", "Hello"), ("user", "note")]
    assert folded(spark, begin, part("s", "x"), call, u("held"), a("also"), result, a("after")) == [("assistant", "x"), ("user", "held"), ("assistant", "also"), ("assistant", "after")]
    # a step that ends while a result is missing goes on holding back; the next step releases
    assert folded(spark, begin, call, u("held"), end, u("still")) == []
    assert folded(spark, begin, call, u("held"), end, u("still"), event("step_begin", "t"), part("t", "y")) == [("user", "held"), ("user", "still"), ("assistant", "y")]
    # calls count by their ids and only from open steps
    assert folded(spark, event("tool_call", "closed", "c"), u("at once")) == [("user", "at once")]
    assert folded(spark, begin, call, call, event("tool_call", "s", "d"), u("held"), result, u("too"), event("tool_result", call="d")) == [("user", "held"), ("user", "too")]
    assert folded(spark, event("step_begin", "a"), part("a", "failed"), event("step_begin", "b"), part("b", "retried"), end) == [("assistant", "failed"), ("assistant", "retried")]


def test_explode_and_code(spark):
    s = table(spark, session("1", "claude", content="» hi\n\n  ```Rust x\n  fn\n\n\n\nodd"))
    assert [(r.role, r.text) for r in messages.explode_messages(s).orderBy("pos").collect()] == [("user", "» hi"), ("assistant", "  ```Rust x\n  fn"), ("other", "odd")]
    df = spark.createDataFrame([(1, "a\n```Py x\nb\nc\n```\nd\n  ```\ne")], "k int, text string")
    assert [tuple(r) for r in messages.code_blocks(df, ["k"]).orderBy("block").collect()] == [(1, 0, "py", "b\nc"), (1, 1, "", "e")]


def test_assembly_needs_a_user_text(spark):
    rows = [("claude", "a", 2, "assistant", "r", None, False, False, False), ("claude", "a", 1, "user", "q", None, True, True, False), ("claude", "b", 1, "assistant", "x", None, False, False, False)]
    df = spark.createDataFrame(rows, "agent string, session_id string, seq bigint, role string, text string, ts timestamp, counts_as_turn boolean, title_candidate boolean, yolo boolean")
    assert [(r.session_id, r.content, r.message_count) for r in messages.assemble_sessions(df).collect()] == [("a", "» q\n\n  r", 1)]
    assert messages.assemble_sessions(df, 10).count() == 0


# -- filters and search


def filter_set(spark):
    return table(
        spark,
        session("claude-recent", "claude", "api one", "/work/web-app", NOW - dt.timedelta(hours=1)),
        session("codex-recent", "codex", "api two", "/work/web-api", NOW - dt.timedelta(hours=2)),
        session("vibe-old", "vibe", "api three", "/work/web-app", NOW - dt.timedelta(days=10)),
        session("opencode-recent", "opencode", "api four", "/work/cli", NOW - dt.timedelta(minutes=30)),
    )


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("agent:claude,codex", {"claude-recent", "codex-recent"}),
        ("agent:!claude", {"codex-recent", "vibe-old", "opencode-recent"}),
        ("-agent:claude,codex", {"vibe-old", "opencode-recent"}),
        ("dir:WEB", {"claude-recent", "codex-recent", "vibe-old"}),
        ("dir:web,!api", {"claude-recent", "vibe-old"}),
        ("date:<2d", {"claude-recent", "codex-recent", "opencode-recent"}),
        ("date:>1w", {"vibe-old"}),
        ("-date:<2d", {"vibe-old"}),
        ("date:!<2d", {"vibe-old"}),
        ("agent:claude,vibe dir:web-app date:<1w", {"claude-recent"}),
        ("agent:Claude,!CoDex three", set()),
        ("three agent:vibe", {"vibe-old"}),
        ("agent:,", {"claude-recent", "codex-recent", "vibe-old", "opencode-recent"}),
        ("date:999999999y", {"claude-recent", "codex-recent", "vibe-old", "opencode-recent"}),
    ],
)
def test_filters_in_search(spark, query, ids):
    got = search.matches(search.one_query(spark, query, NOW), filter_set(spark))
    assert {r.id for r in got.collect()} == ids


def test_filter_columns_agree_with_parsed_queries(spark):
    s = filter_set(spark)
    made = filters.apply(s, filters.agent_filter(["Claude"], ["codex"]), filters.dir_filter(["web"], ["cli"]), filters.date_filter("<2d", NOW))
    assert {r.id for r in made.collect()} == {"claude-recent"}
    assert filters.date_filter("soon", NOW) is None and filters.date_filter("999999999y", NOW) is None and filters.all_of(None, None) is None
    assert {r.id for r in filters.apply(s, filters.stats_filter("vibe", "/work/web")).collect()} == {"vibe-old"}
    assert filters.apply(s, filters.stats_filter(None, "WEB")).count() == 0


def test_query_parsing(spark):
    rows = [(0, 'agent:claude dir:"my project" auth'), (1, "agent:claude,!codex -dir:test api"), (2, "xagent:pi  a   b"), (3, "date:today date:nope"), (4, "-date:<2d"), (5, "agent:a agent:B"), (6, None)]
    got = {r.query_id: r for r in search.parse_queries(spark.createDataFrame(rows, "query_id int, query string"), NOW).collect()}
    assert (got[0].text, got[0].agent_include, got[0].dir_include) == ("auth", ["claude"], ["my project"])
    assert (got[1].text, got[1].agent_include, got[1].agent_exclude, got[1].dir_exclude) == ("api", ["claude"], ["codex"], ["test"])
    assert (got[2].text, got[2].agent_include) == ("x a b", ["pi"])
    assert got[3].date is None and got[4].date.negated and got[4].date.op == "less" and got[5].agent_include == ["b"] and got[6].text is None


def test_civil_days_follow_the_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        for day, seconds in (("2026-03-30", 82_800), ("2026-10-26", 90_000)):
            d = F.lit(day).cast("date")
            assert one(spark, F.unix_seconds(d.cast("timestamp")) - F.unix_seconds(F.date_sub(d, 1).cast("timestamp"))) == seconds
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_typos_and_half_typed_quotes(spark):
    s = table(spark, session("1", "claude", "Authentication bug"), session("2", "pi", "x", content="refresh token failure"), session("3", "vibe", "Fast resume search"), session("4", "kimi", "nothing here", "/srv/Website"))

    def ids(q):
        return {r.id for r in search.search(s, q, NOW).collect()}

    assert ids("authentcation") == {"1"} and ids("tokem") == {"2"} and ids("otken") == {"2"} and ids('"fast') == {"3"} and ids("website") == {"4"} and ids("zzzz") == set()
    assert ids("fast bug") == {"1", "3"} and ids("fust bugg") == set()
    assert {r.id for r in search.phrase_filter(s, "resume Search").collect()} == {"3"} and search.phrase_filter(s, "search resume").count() == 0
    assert [r.id for r in search.search(s, "", NOW, limit=2, offset=1).collect()] == ["4", "2"]
    assert search.search(s, "fast", NOW, limit=0).count() == 0


def osa_prefix(word, term):
    def osa(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    return any(osa(word, term[:k]) <= 1 for k in range(len(term) + 1))


@pytest.mark.parametrize("few,kept", [(0, False), (16, False), (16, True)])
def test_fuzzy_terms_match_brute_force(spark, monkeypatch, few, kept):
    import itertools

    monkeypatch.setattr(search, "FEW_WORDS", few)

    vocab = ["".join(p) for n in (1, 2, 3, 4, 5, 6, 7) for p in itertools.product("ab", repeat=n)] + ["abé", "xyz", "axbyc"]
    words = ["aba", "bbab", "éab", "ab-", "abab", "zzz", "babab", "aabba", "ababab", "bbabaab", "abbabbabb", "cababab"]
    v = spark.createDataFrame([("title", t, 1) for t in vocab], "field string, term string, df bigint")
    index = search.SearchIndex(None, None, v, None, search_index.fuzzy_keys(v) if kept else None)
    got = {(r.word, r.term) for r in search.fuzzy_terms(spark.createDataFrame([(w,) for w in words], "word string"), index).collect()}
    assert got == {(w, t) for w in words for t in vocab if osa_prefix(w, t)}


AUTH = (
    session("near", "claude", "x", content="an auth bug in the api"), session("apart", "codex", "x", content="a bug in the auth module"), session("alone", "pi", "x", content="auth alone"),
    session("title", "vibe", "Auth-bug", content="of the day"), session("none", "kimi", "x", "/srv/auth bug", content="nothing"),
)


@pytest.mark.parametrize("kept", [False, True])
def test_phrases_and_signs(spark, tmp_path, kept):
    s = table(spark, *AUTH)
    index = search.build_index(s, str(tmp_path / "index")) if kept else None
    texts = [
        "auth bug", '"auth bug"', "auth-bug", '"bug auth', "+auth +module", "auth AND alone", "alone OR module", "auth -bug", "+auth -bug", "title:auth", 'content:"in the"', "foo:auth", "-zz", 'module AND NOT "in the"',
        "of AND NOT bug", "of AND NOT module", '"/srv/auth bug"', 'directory:"/srv/auth bug"', "NOT auth alone", "NOT auth module", "NOT zzz module", "+zzz auth",
    ]
    queries = search.parse_queries(spark.createDataFrame(list(enumerate(texts)), "query_id int, query string"), NOW)
    found = {t: {} for t in texts}
    for r in search.search_scores(queries, s, index).collect():
        found[texts[r.query_id]][r.id] = r.score
    plain, phrase = found["auth bug"], found['"auth bug"']
    assert set(plain) == {"near", "apart", "alone", "title"}
    # the words apart match within an edit, a point for each of them in its field, and no more
    assert set(phrase) == {"near", "apart", "title"} and phrase["apart"] == 2.0 and min(phrase["near"], phrase["title"]) > 2.0
    assert found["auth-bug"].keys() == {"near", "title"} and found['"bug auth'].keys() == plain.keys()
    assert found["+auth +module"].keys() == {"apart"} and found["auth AND alone"].keys() == {"alone"} and found["alone OR module"].keys() == {"alone", "apart"}
    # the fuzzy part does not see signs: both words are there
    assert found["auth -bug"] == found["+auth -bug"] and found["auth -bug"] == {"alone": found["auth -bug"]["alone"], "near": 2.0, "apart": 2.0, "title": 2.0}
    # nor fields
    assert found["title:auth"].keys() == {"title"} and found['content:"in the"'].keys() == {"near", "apart"} and found["foo:auth"] == {} and found["-zz"] == {}
    assert found['module AND NOT "in the"'].keys() == set() and found["of AND NOT bug"] == {} and found["of AND NOT module"].keys() == {"title"}
    assert found['"/srv/auth bug"'].keys() == {"none"} and found['directory:"/srv/auth bug"'].keys() == {"none"}  # a directory is one raw term
    assert found["NOT auth alone"] == {} and found["NOT auth module"].keys() == set() and found["NOT zzz module"].keys() == {"apart"} and found["+zzz auth"] == {}


def test_phrase_is_found_from_positions_alone(spark, tmp_path):
    long = "x" * 50
    s = table(spark, session("a", "pi", "t", content="red red green red green"), session("b", "pi", "t", content=f"red {long} green"), session("c", "pi", "t", content="green red"))
    index = search.build_index(s, str(tmp_path / "index"))
    scores = search.search_scores(spark.createDataFrame([(0, '"red green"'), (1, '"red red green"')], "query_id int, text string"), s, index)
    got = search.bm25(spark.createDataFrame([(0, '"red green"'), (1, '"red red green"'), (2, '"green green"')], "query_id int, text string"), index)
    assert {(r.query_id, r.id) for r in got.collect()} == {(0, "a"), (1, "a")}
    read = scores._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1:]
    assert read and all("content" not in r.split("\n")[0] for r in read)
    idf = {w: math.log(1 + (3 - n + 0.5) / (n + 0.5)) for w, n in (("red", 3), ("green", 3))}
    mean = (5 + 2 + 2) / 3
    want = (idf["red"] + idf["green"]) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 5 / mean))
    assert got.where("query_id = 0").first().score == pytest.approx(want)


def test_a_kept_index_reads_the_files_of_its_terms(spark, tmp_path):
    def files(words):
        made = table(spark, *[session(str(i), "pi", "t", content=f"word{i} other{i} both") for i in range(words)])
        index = search.build_index(made, str(tmp_path / f"index{words}"))
        named = index.postings_of(spark.createDataFrame([("word3",), ("both",)], "term string"))
        shown = named._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [bucket" in shown and "PushedFilters: [" in shown and "term" in shown.split("PushedFilters")[1].split("]")[0]
        assert {r.term for r in named.select("term").distinct().collect()} == {"word3", "both"}
        near = index.terms_near(search.word_keys(spark.createDataFrame([("word",)], "word string")).select("key"))
        assert "PartitionFilters: [bucket" in near._jdf.queryExecution().executedPlan().toString()
        return named.select(F.input_file_name().alias("f")).distinct().count()

    assert files(40) <= 2 and files(400) <= 2
    reopened = search.open_index(spark, str(tmp_path / "index40"))
    s = table(spark, *[session(str(i), "pi", "t", content=f"word{i} other{i} both") for i in range(40)])
    assert [r.id for r in search.search(s, "word31 both", NOW, limit=1, index=reopened).collect()] == ["31"]


def test_an_updated_index_is_a_rebuilt_one(spark, tmp_path):
    import random

    rng, words = random.Random(6), ["auth", "bug", "module", "red", "green", "fast", "resume", "token", "the", "of"]

    def some(i, version=0):
        text = random.Random(i * 100 + version)
        return session(str(i), "pi" if i % 2 else "codex", " ".join(text.choices(words, k=3)), f"/w/{i % 3}", content=" ".join(text.choices([*words, f"own{i}v{version}"], k=12)))

    rows = {i: some(i) for i in range(60)}
    path = str(tmp_path / "index")
    search.build_index(table(spark, *rows.values()), path)
    queries = search.parse_queries(spark.createDataFrame(list(enumerate(['"red green"', "auth bug", "+the -of", "own3v1 token", "own7v0", "tokn", "own61v9"])), "query_id int, query string"), NOW)

    def scores(index, sessions):
        return {(r.query_id, r.agent, r.id): round(r.score, 9) for r in search.search_scores(queries, sessions, index).collect()}

    for step in range(3):
        changed = {i: some(i, step + 1) for i in rng.sample(sorted(rows), 3)} | {60 + step: some(60 + step, 9)}
        gone = rng.choice([i for i in rows if i not in changed])
        rows = {i: r for i, r in (rows | changed).items() if i != gone}
        index = search.update_index(spark, path, table(spark, *changed.values()), spark.createDataFrame([(some(gone)[1], str(gone))], "agent string, id string"))
        now = table(spark, *rows.values())
        assert scores(index, now) == scores(search.build_index(now), now)
        found = search_index.manifest(spark, path)["segments"]
        assert sum(s["docs"] for s in found) == len(rows) and found[0]["rows"] == 60 and found[-1]["rows"] <= 4 * (step + 1)
    # what was written for a change is in proportion to it
    size = [spark.read.parquet(f"{path}/{s['name']}/postings").count() for s in found]
    assert sum(size[1:]) < 0.35 * size[0] and len(found) <= 3
    search.merge_segments(spark, path)
    assert len(search_index.manifest(spark, path)["segments"]) == 1 and scores(search.open_index(spark, path), now) == scores(search.build_index(now), now)


def test_near_terms_of_a_word_are_one_row_before_anything_is_collected(spark, tmp_path):
    near = " ".join(f"thing{i}" for i in range(300))
    s = table(spark, session("a", "pi", "thing", content=near), session("b", "pi", "t", content="other thinx word"), session("c", "pi", "thing", content="word"))
    index = search.build_index(s, str(tmp_path / "index"))
    scores = search.search_scores(spark.createDataFrame([(0, "thing"), (1, "thing word word")], "query_id int, text string"), s, index)
    lines = scores._jdf.queryExecution().executedPlan().toString().split("\n")
    first = [line for line in lines if "HashAggregate(" in line and " tf#" not in line and "word#" in line]
    assert first and not any("ObjectHashAggregate" in line or "SortAggregate" in line for line in first)
    found = {(r.query_id, r.id): r.score for r in scores.collect()}
    # one point for a word and field, however many terms are near it; a word that comes twice counts twice
    assert set(found) == {(0, "a"), (0, "b"), (0, "c"), (1, "a"), (1, "b"), (1, "c")} and found[0, "b"] == 1.0
    bm25 = {(r.query_id, r.id): r.score for r in search.bm25(search.parse_queries(spark.createDataFrame([(0, "thing"), (1, "thing word word")], "query_id int, query string"), NOW), index).collect()}
    assert found[0, "a"] == pytest.approx(5 * bm25[0, "a"] + 2) and found[1, "b"] == pytest.approx(5 * bm25[1, "b"] + 3) and found[1, "c"] == pytest.approx(5 * bm25[1, "c"] + 3)


def test_hidden_postings_are_dropped_after_they_are_counted(spark, tmp_path, monkeypatch):
    rows = {i: session(str(i), "pi", "t", content=f"thing{i} old{i} word") for i in range(40)}
    path = str(tmp_path / "index")
    search.build_index(table(spark, *rows.values()), path)
    rows[3] = session("3", "pi", "t", content="new word")
    index = search.update_index(spark, path, table(spark, rows[3]), spark.createDataFrame([("pi", "5")], "agent string, id string"))
    del rows[5]
    seen = []
    for module in (search, search_index):
        monkeypatch.setattr(module, "live", lambda df, removed, live=search_index.live: seen.append(df.columns) or live(df, removed))
    queries = search.parse_queries(spark.createDataFrame([(0, "thing"), (1, "old3"), (2, "new"), (3, "word"), (4, "thing5")], "query_id int, query string"), NOW)

    def scores(index, sessions):
        return {(r.query_id, r.id): round(r.score, 9) for r in search.search_scores(queries, sessions, index).collect()}

    now = table(spark, *rows.values())
    got = scores(index, now)
    assert seen and not any("positions" in columns for columns in seen)
    assert got == scores(search.build_index(now), now) and (0, "3") not in got and (0, "5") not in got and (2, "3") in got


def test_same_id_in_two_agents(spark):
    s = table(spark, session("same", "claude", "apple"), session("same", "codex", "banana"))
    assert [(r.agent, r.id) for r in search.search(s, "banana", NOW).collect()] == [("codex", "same")]
    assert refresh.dedupe_sessions(s).count() == 2


def test_page_meta(spark):
    rows = [(3, 0, 2), (3, 2, 2), (3, 99, 2), (3, 1, None), (0, 0, 50)]
    got = search.page_meta(spark.createDataFrame(rows, "total bigint, offset bigint, limit bigint")).orderBy(F.desc("total"), "offset").collect()
    assert [(r.state, r.next_offset, r.returned) for r in got] == [("more", 2, 2), ("complete", None, 2), ("complete", None, 1), ("past_end", None, 0), ("complete", None, 0)]


def test_result_json(spark):
    import json

    page = refresh.with_resume_command(table(spark, session("1", "claude", "t", "/d", yolo=True)))
    got = json.loads(search.result_json(page, 5, 0, 1).first().json)
    assert got["schema_version"] == 1 and got["meta"]["state"] == "more" and got["meta"]["next_offset"] == 1
    assert "content" not in got["sessions"][0] and got["sessions"][0]["resume_command"] == ["claude", "--dangerously-skip-permissions", "--resume", "1"]


def test_resume_commands(spark):
    s = table(spark, *[session("7", a, directory="" if a == "claude" else "/d") for a in AGENT_NAMES], session("7", "copilot-vscode", directory=""), session("7", "new"))
    got = {(r.agent, r.directory): r.resume_command for r in refresh.with_resume_command(s, force=True).collect()}
    assert got["vibe", "/d"] == ["vibe", "--agent", "auto-approve", "--resume", "7"] and got["codex", "/d"] == ["codex", "--dangerously-bypass-approvals-and-sandbox", "resume", "7"]
    assert got["opencode", "/d"] == ["opencode", "/d", "--session", "7"] and got["pi", "/d"] == ["pi", "--session", "7"]
    assert got["copilot-vscode", "/d"] == ["code", "/d"] and got["copilot-vscode", ""] == ["code"] and got["new", ""] == []


# -- keeping sessions


def test_changed_markers(spark):
    known = spark.createDataFrame([("codex", "abc123", 10.0)], "agent string, id string, mtime double")
    for mtime, changed in ((10.0005, 0), (9.0, 1), (10.0, 0), (11.0, 1)):
        assert refresh.detect_changes(spark.createDataFrame([("codex", "abc123", mtime)], known.schema), known).count() == changed
    assert refresh.detect_changes(spark.createDataFrame([("codex", "new", 1.0)], known.schema), known).count() == 1


@pytest.mark.parametrize(
    ("current", "outcome", "complete", "failed", "op"),
    [
        (2.0, "session", True, False, "upsert"), (2.0, "delete", True, False, "delete"), (2.0, "retain", True, False, "keep"), (1.0, "delete", True, False, None),
        (None, None, True, False, "delete"), (None, None, False, False, None), (None, None, True, True, None), (2.0, "session", False, False, "upsert"), (2.0, "session", True, True, None),
    ],
)
def test_refresh_plan(spark, current, outcome, complete, failed, op):
    k = "agent string, id string, mtime double"
    now = spark.createDataFrame([("codex", "a", current)] if current else [], k)
    parsed = spark.createDataFrame([("codex", "a", outcome)] if outcome else [], "agent string, id string, parse_outcome string")
    status = spark.createDataFrame([("codex", complete, failed)], "agent string, complete boolean, failed boolean")
    got = refresh.plan_refresh(now, parsed, spark.createDataFrame([("codex", "a", 1.0)], k), status).collect()
    assert [r.op for r in got] == ([op] if op else [])


def test_gate(spark):
    rows = [("INVALID", True, True), ("PARTIAL", True, True), ("PARTIAL", True, False), ("PARTIAL", False, True), ("CLEAN", True, False), ("CLEAN", False, False)]
    df = spark.createDataFrame(rows, "health string, parsed boolean, usable boolean")
    assert [r.outcome for r in refresh.gate_outcome(df).collect()] == ["retain", "session", "retain", "retain", "session", "delete"]


def test_snapshot_and_dedupe_do_not_depend_on_order(spark):
    a, b = session("1", "pi", "old", mtime=1.0), session("1", "pi", "new", mtime=2.0)
    for rows in ((a, b), (b, a), (b, a, a)):
        assert [r.title for r in refresh.dedupe_sessions(table(spark, *rows)).collect()] == ["new"]
    log = refresh.log_rows(table(spark, a, session("2", "pi")), 1).unionByName(refresh.log_rows(table(spark, b), 2)).unionByName(refresh.log_rows(table(spark, session("2", "pi")), 2, "delete"))
    assert [(r.id, r.title) for r in refresh.latest_snapshot(log).collect()] == [("1", "new")]


def test_lookups(spark):
    log = spark.createDataFrame([("a", 1, "x", True, False), ("a", 2, "y", True, False), ("a", 3, "bad", False, False), ("b", 1, "z", True, False), ("b", 2, "", True, True)], "id string, line_no int, name string, valid boolean, deleted boolean")
    assert [(r.id, r.name) for r in refresh.latest_lookup(log).collect()] == [("a", "y")]
    files = spark.createDataFrame([("1", "full", 5, "f"), ("1", "regular", 5, "r"), ("2", "full", 0, "f"), ("2", "regular", 3, "r"), ("3", "full", 2, "f"), ("4", "full", 0, "f")], "session_id string, variant string, size bigint, path string")
    assert {r.session_id: r.path for r in scan.prefer_file(files).collect()} == {"1": "f", "2": "r", "3": "f"}


def test_statistics(spark):
    s = filter_set(spark)
    t = stats.totals(s).first()
    assert (t.sessions, t.messages, t.avg_messages) == (4, 8, 2.0) and stats.totals(s.limit(0)).first().sessions == 0
    assert [(r.directory, r.sessions) for r in stats.top_directories(s, 2).collect()] == [("/work/web-app", 2), ("/work/cli", 1)]
    assert sum(r.sessions for r in stats.by_weekday(s).collect()) == 4 and stats.by_weekday(s).count() == 7 and stats.by_hour(s).count() == 24
    assert [(r.sessions, r.bar, r.level) for r in stats.scaled(spark.createDataFrame([(0,), (1,), (100,)], "sessions int")).collect()] == [(0, 0, 0), (1, 1, 1), (100, 24, 7)]
    raw = stats.raw_store_stats(spark.createDataFrame([("pi", "/a", 3), ("pi", "/a", 3), ("pi", "/b", 4)], "agent string, path string, size bigint"))
    assert {r.agent: (r.available, r.file_count, r.total_bytes) for r in raw.collect()}["pi"] == (True, 2, 7) and raw.count() == 12
    assert [r.agent for r in stats.agent_report(stats.by_agent(s), raw).collect()] == ["claude", "codex", "opencode", "vibe", "pi"]
