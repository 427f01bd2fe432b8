"""Each source's file shapes, and the streaming refresh."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sessionlake.functions.paths import stem
from sessionlake.sources import agents
from sessionlake.sources.scan import RULES, list_source_files
from sessionlake.streaming import refresh as stream


def write(root, path, *records):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records), encoding="utf-8")


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_claude(spark, tmp_path):
    write(
        tmp_path, "p/one.jsonl",
        {"type": "user", "cwd": "/w", "message": {"content": "<command>x"}}, "{torn",
        {"type": "user", "message": {"content": "short"}}, {"type": "user", "message": {"content": "please fix the login bug"}}, "",
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "done"}, {"type": "tool_use"}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": "x"}]}}, {"type": "ai-title", "aiTitle": "Login"}, {"type": "ai-title", "aiTitle": " "},
    )
    write(tmp_path, "p/agent-2.jsonl", {"type": "user", "message": {"content": "this is a side chain of it"}})
    write(tmp_path, "p/three.jsonl", {"type": "user", "message": {"content": "tiny"}})
    s = only(agents.sessions_of("claude", agents.ingest_claude(spark, str(tmp_path))))
    assert (s.id, s.title, s.directory, s.message_count) == ("one", "Login", "/w", 4)
    assert s.content == "» short\n\n» please fix the login bug\n\n  done" and s.mtime > 0 and s.timestamp is not None
    index = spark.createDataFrame([("one", "From index", "2030-01-01T00:00:00Z", None, 5.0)], "session_id string, summary string, modified string, file_mtime double, index_mtime double")
    s = only(agents.sessions_of("claude", agents.ingest_claude(spark, str(tmp_path), index=index)))
    assert s.title == "From index" and s.mtime == 1893456000.0
    assert {r.session_id for r in list_source_files(spark, str(tmp_path), RULES["claude"]).collect()} == {"one", "three"}


def test_codex(spark, tmp_path):
    write(
        tmp_path, "2024/rollout-1-abc.jsonl",
        {"type": "session_meta", "payload": {"id": "real", "cwd": "/c"}}, {"type": "turn_context", "payload": {"approval_policy": "on-request", "sandbox_policy": {"mode": "danger-full-access"}}},
        {"type": "response_item", "payload": {"role": "user", "content": [{"text": " <environment_context>"}]}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "do it"}},
        {"type": "event_msg", "payload": {"type": "agent_reasoning", "text": "hm"}}, {"type": "response_item", "payload": {"role": "assistant", "content": [{"type": "output_text", "text": "ok"}]}},
    )
    write(tmp_path, "2024/rollout-2-none.jsonl", {"type": "session_meta", "payload": {"id": "empty"}})
    s = only(agents.sessions_of("codex", agents.ingest_codex(spark, str(tmp_path))))
    assert (s.id, s.title, s.directory, s.message_count, s.yolo, s.content) == ("real", "do it", "/c", 1, True, "» do it\n\n  hm\n\n  ok")
    names = spark.createDataFrame([("real", 1, "Named", "2030-01-01T00:00:00Z", True, False)], "id string, line_no int, thread_name string, updated_at string, valid boolean, deleted boolean")
    s = only(agents.sessions_of("codex", agents.ingest_codex(spark, str(tmp_path), names=names)))
    assert s.title == "Named" and s.mtime == 1893456000.0


def test_copilot_cli(spark, tmp_path):
    write(
        tmp_path, "x1/events.jsonl", {"type": "session.info", "data": {"infoType": "folder_trust", "message": "Folder /trusted ok"}}, {"type": "user.message", "data": {"content": "a longer question"}},
        {"type": "assistant.message", "data": {"content": "yes"}}, {"type": "assistant.message", "data": {"content": ""}},
    )
    s = only(agents.sessions_of("copilot-cli", agents.ingest_copilot_cli(spark, str(tmp_path))))
    assert (s.id, s.title, s.directory, s.message_count) == ("x1", "a longer question", "/trusted", 2)


def test_copilot_vscode(spark, tmp_path):
    write(tmp_path, "ws/chatSessions/v1.json", {"lastMessageDate": 1704067200000, "requests": [{"message": {"text": "q1"}, "response": [{"value": "r1"}, {"value": ""}, {"kind": "x"}]}, {"message": {"text": "q2"}}]})
    write(tmp_path, "ws/workspace.json", {"folder": "file:///my%20dir"})
    write(tmp_path, "v2.json", {"customTitle": "T", "creationDate": 1704067200000, "requests": [{"message": {"text": "q"}, "contentReferences": [{"reference": {"uri": {"fsPath": "/a/b.py"}}}]}]})
    write(tmp_path, "v3.json", {"requests": []})
    got = {r.id: r for r in agents.sessions_of("copilot-vscode", agents.ingest_copilot_vscode(spark, str(tmp_path))).collect()}
    assert set(got) == {"v1", "v2"} and got["v1"].content == "» q1\n\n  r1\n\n» q2" and got["v1"].message_count == 3
    assert got["v1"].directory == "/my dir" and got["v2"].directory == "/a" and got["v2"].title == "T" and str(got["v1"].timestamp) == "2024-01-01 00:00:00"


def test_landed_tables(spark):
    s = spark.createDataFrame([("c1", "", 2, 1704067200, 1704067200000), ("c2", "T", 0, 1, 1), ("c3", "T", 1, 1, 1)], "id string, title string, message_count int, created_at bigint, updated_at bigint")
    m = spark.createDataFrame([("c1", "user", '[{"type":"text","data":{"text":"question"}}]', 1), ("c1", "assistant", '[{"type":"tool_call","data":{"name":"ls"}}]', 2), ("c3", "user", "[{", 1)], "session_id string, role string, parts string, created_at bigint")
    r = only(agents.sessions_of("crush", agents.ingest_crush(s, m)))
    assert (r.id, r.title, r.content, r.message_count) == ("c1", "question", "» question\n\n  [calling ls]", 2)
    meta = spark.createDataFrame([("k", "m", '{"name":"Chat","createdAt":1704067200000}', 9.0, "%2Fw")], "session_id string, key string, value string, mtime double, directory string")
    blobs = spark.createDataFrame([("k", 0, '{"role":"user","content":[{"type":"text","text":"hi"}]}'), ("k", 1, '{"conversation":[{"type":2,"text":"yo"},{"messages":[{"role":"user","text":"deep"}]}]}'), ("k", 2, "junk"), ("k", 3, 'x{"role":"assistant","content":"sliced"}y'), ("k", 4, "typed text$0123-4567"), ("k", 5, '{"messages":[{"conversation":[{"messages":[{"role":"user","text":"bottom"}],"type":1,"text":"above"}]}]}'), ("k", 6, '{"type":"1","text":"no role"}')], "session_id string, seq bigint, value string")
    r = only(agents.sessions_of("cursor", agents.ingest_cursor(meta, blobs)))
    assert (r.title, r.directory, r.message_count, r.mtime) == ("Chat", "/w", 5, 9.0)
    assert r.content.split("\n\n") == ["» hi", "  yo", "» deep", "  sliced", "» typed text", "» bottom", "» above"]
    s = spark.createDataFrame([("o", "", "/o", 1000, 2000)], "id string, title string, directory string, time_created bigint, time_updated bigint")
    m = spark.createDataFrame([("m1", "o", 1, '{"role":"user"}'), ("m2", "o", 2, '{"role":"assistant"}')], "id string, session_id string, time_created bigint, data string")
    p = spark.createDataFrame([("p2", "m1", "o", 9000, '{"type":"text","text":"b"}'), ("p1", "m1", "o", 1, '{"type":"text","text":"a"}'), ("p3", "m2", "o", 1, '{"type":"tool"}')], "id string, message_id string, session_id string, time_created bigint, data string")
    r = only(agents.sessions_of("opencode", agents.ingest_opencode(s, m, p)))
    assert (r.title, r.content, r.message_count, r.mtime) == ("a\nb", "» a\nb", 2, 9.0)


def test_opencode_file_tree(spark, tmp_path):
    write(tmp_path, "session/p1/ses_a.json", {"id": "a", "title": "", "directory": "/o", "time": {"created": 1704067200000, "updated": 1704153600000}})
    write(tmp_path, "session/p1/ses_b.json", {"id": "b", "title": "Torn"})
    write(tmp_path, "session/p1/ses_c.json", {"id": "c", "title": "Empty"})
    write(tmp_path, "message/a/msg_2.json", {"id": "m2", "role": "assistant"})
    write(tmp_path, "message/a/msg_1.json", {"id": "m1", "role": "user"})
    write(tmp_path, "message/b/msg_3.json", {"id": "m3", "role": "user"})
    write(tmp_path, "part/m1/p1.json", {"type": "text", "text": "ask"})
    write(tmp_path, "part/m1/p2.json", {"type": "text", "text": "more"})
    write(tmp_path, "part/m2/p3.json", {"type": "tool"})
    write(tmp_path, "part/m2/p4.json", {"type": "text", "text": "answer"})
    write(tmp_path, "part/m3/p5.json", "{torn")
    got = {r.id: r for r in agents.sessions_of("opencode", agents.ingest_opencode_legacy(spark, str(tmp_path))).collect()}
    assert set(got) == {"a", "c"} and (got["c"].title, got["c"].content, got["c"].message_count) == ("Empty", "", 0)
    assert (got["a"].title, got["a"].content, got["a"].message_count, str(got["a"].timestamp)) == ("Untitled session", "» ask\n\n» more\n\n  answer", 2, "2024-01-02 00:00:00")
    write(tmp_path / "pi", "2024_u1.jsonl", {"type": "message", "message": {"role": "user", "content": "ask"}})
    both = agents.ingest_all(spark, {"opencode": str(tmp_path), "pi": str(tmp_path / "pi")})
    assert sorted(r.id for r in both.collect()) == ["a", "c", "u1"]


def chunk(kind, text, index=None, **more):
    meta = {"promptIndex": index} if index is not None else {}
    return {"params": {"update": {"sessionUpdate": kind, "content": {"text": text}, "_meta": meta | more.pop("meta", {}), **more}}}


def test_grok(spark, tmp_path):
    write(
        tmp_path, "%2Fwork/g1/updates.jsonl", chunk("user_message_chunk", "He", 0), chunk("user_message_chunk", "llo", 0), chunk("agent_message_chunk", "Hi"), chunk("tool_call", ""), chunk("agent_message_chunk", "!"),
        chunk("user_message_chunk", "ls", 1, meta={"bashCommand": "ls"}), chunk("user_message_chunk", "no index"), chunk("user_message_chunk", "again", 1), chunk("rewind_marker", "", target_prompt_index=1), chunk("user_message_chunk", "kept", 1),
    )
    write(tmp_path, "%2Fwork/g1/summary.json", {"info": {"id": "g1"}, "generated_title": "G", "created_at": "2024-01-01T00:00:00Z"})
    s = only(agents.sessions_of("grok", agents.ingest_grok(spark, str(tmp_path))))
    assert (s.id, s.title, s.message_count, s.content) == ("g1", "G", 2, "» Hello\n\n  Hi!\n\n» kept")


def said(role, text, **origin):
    return {"type": "context.append_message", "message": {"role": role, "content": [{"type": "text", "text": text}], "origin": origin or None}}


def loop(kind, **more):
    return {"type": "context.append_loop_event", "event": {"type": kind, **more}}


def kimi(spark, root, **more):
    return agents.sessions_of("kimi", agents.ingest_kimi(spark, str(root), **more))


def test_kimi(spark, tmp_path):
    write(
        tmp_path, "sessions/ws/k1/agents/main/wire.jsonl", {"type": "metadata"}, said("user", "hidden reminder", kind="injection"), said("user", "first question", kind="user"), loop("step.begin", uuid="s1"),
        loop("content.part", stepUuid="s1", part={"type": "text", "text": "Streamed "}), loop("content.part", stepUuid="s1", part={"type": "think", "text": "hm"}), loop("content.part", stepUuid="s1", part={"type": "text", "text": "answer"}),
        loop("tool.call", stepUuid="s1", toolCallId="c1", args={"path": "secret"}), loop("step.end", uuid="s1"), "{torn",
    )
    write(tmp_path, "sessions/ws/k1/state.json", {"id": "other", "title": "Named", "updatedAt": 1784110807000, "createdAt": 1})
    s = only(kimi(spark, tmp_path))
    assert (s.id, s.title, s.directory, s.message_count, str(s.timestamp)) == ("k1", "Named", "", 1, "2026-07-15 10:20:07")
    assert s.content == "» first question\n\n  Streamed answer"
    index = {"sessionId": "k1", "sessionDir": "/home/u/x/../sessions/ws/k1", "workDir": "/repo"}
    bad = [index | {"sessionDir": d, "workDir": "/no"} for d in ("/home/u/sessions/ws/k2", "/elsewhere/k1", "sessions/ws/k1")]
    write(tmp_path, "session_index.jsonl", "{", index, *bad, {"sessionId": "gone", "deleted": True})
    assert only(kimi(spark, tmp_path, origin="/home/u/sessions")).directory == "/repo"
    assert only(kimi(spark, tmp_path, origin="/home/other")).directory == ""
    write(tmp_path, "session_index.jsonl", index, {"sessionId": "k1", "deleted": True})
    assert only(kimi(spark, tmp_path, origin="/home/u/sessions")).directory == ""


def test_kimi_origins_and_commands(spark, tmp_path):
    write(
        tmp_path, "ws/k1/agents/main/wire.jsonl", said("user", "task done", kind="task"), said("user", "output", kind="shell_command", phase="output"), said("user", "<bash-input>\nls &lt;a&gt;\n</bash-input>", kind="shell_command", phase="input"),
        said("user", "TEMPLATE", kind="skill_activation", skillName="review", skillArgs="  src  ", trigger="user-slash"), said("user", "TEMPLATE", kind="skill_activation", skillName="auto", trigger="model"),
        said("user", "TEMPLATE", kind="plugin_command", pluginId="hub", commandName="issue", commandArgs=" 42 ", trigger="user-slash"), said("user", "kept as it is", kind="plugin_command", trigger="user-slash"), said("tool", "no"),
        {"type": "context.apply_compaction", "summary": {"content": [{"text": "brief "}, {"text": "text"}]}},
    )
    write(tmp_path, "ws/k1/state.json", {"isCustomTitle": False, "customTitle": "stale", "title": " ", "workDir": "/k"})
    s = only(kimi(spark, tmp_path))
    assert (s.title, s.directory, s.message_count) == ("ls <a>", "/k", 4)
    assert s.content.split("\n\n") == ["» task done", "» ls <a>", "» /review src", "» Activated skill: auto", "» /hub:issue 42", "» kept as it is", "» brief text"]


def test_kimi_states_and_last_prompts(spark, tmp_path):
    for name in ("undone", "cleared", "full"):
        more = {"undone": [{"type": "context.undo", "count": 1}], "cleared": [{"type": "context.clear"}], "full": []}[name]
        write(tmp_path, f"ws/{name}/agents/main/wire.jsonl", said("user", "the prompt"), *more)
        write(tmp_path, f"ws/{name}/state.json", {"lastPrompt": "the last prompt", "createdAt": "2026-07-15T10:00:00Z"})
    write(tmp_path, "ws/old/state.json", {"customTitle": "Pinned", "title": "made", "lastPrompt": "resume me", "custom": {"cwd": "/c"}})
    write(tmp_path, "ws/old/session-meta/state.json", {"title": "Legacy", "lastPrompt": "no"})
    write(tmp_path, "ws/legacy/session-meta/state.json", {"title": "Legacy", "lastPrompt": "yes"})
    write(tmp_path, "ws/empty/state.json", {"title": "Empty"})
    got = {r.id: (r.title, r.content, r.message_count) for r in kimi(spark, tmp_path).collect()}
    assert got == {"cleared": ("the prompt", "» the prompt", 1), "full": ("the last prompt", "» the prompt", 1), "old": ("Pinned", "» resume me", 1), "legacy": ("Legacy", "» yes", 1)}


def test_pi(spark, tmp_path):
    write(
        tmp_path, "ws/2024_u1.jsonl", {"type": "session", "id": "u1", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/p"}, {"type": "session_info", "name": "Named"},
        {"type": "message", "message": {"role": "user", "content": "ask", "timestamp": 1704153600000}}, {"type": "message", "message": {"role": "custom", "content": "no", "display": False}},
        {"type": "message", "message": {"role": "hookMessage", "content": [{"type": "text", "text": "shown"}], "display": True}}, {"type": "compaction", "summary": "sum"}, {"type": "session_info", "name": " "},
    )
    s = only(agents.sessions_of("pi", agents.ingest_pi(spark, str(tmp_path))))
    assert (s.id, s.title, s.directory, s.message_count, s.content) == ("u1", "ask", "/p", 1, "» ask\n\n  shown\n\n  sum") and str(s.timestamp) == "2024-01-02 00:00:00"


def test_vibe(spark, tmp_path):
    write(tmp_path, "session_1/meta.json", {"session_id": "v", "environment": {"working_directory": "/v"}, "config": {"auto_approve": True}, "start_time": "2024-01-01T00:00:00"})
    write(tmp_path, "session_1/messages.jsonl", {"role": "system", "content": "s"}, {"role": "user", "content": "hello"}, {"role": "assistant", "content": [{"text": "a"}, {"text": "b"}]})
    write(tmp_path, "session_2/meta.json", "{torn")
    s = only(agents.sessions_of("vibe", agents.ingest_vibe(spark, str(tmp_path))))
    assert (s.id, s.title, s.message_count, s.yolo, s.content) == ("v", "hello", 3, True, "» hello\n\n  a\n\n  b")


def test_antigravity(spark, tmp_path):
    logs = "brain/a1/.system_generated/logs"
    user = {"source": "USER_EXPLICIT", "type": "USER_INPUT", "created_at": "2024-01-01T00:00:00Z", "content": "<USER_REQUEST>go</USER_REQUEST>"}
    model = {"source": "MODEL", "type": "PLANNER_RESPONSE", "created_at": "2024-01-02T00:00:00Z", "thinking": "well"}
    write(tmp_path, f"{logs}/transcript.jsonl", user)
    write(tmp_path, f"{logs}/transcript_full.jsonl", user, model, {"source": "USER", "type": "EPHEMERAL_MESSAGE", "content": "x"})
    write(tmp_path, "history/history.jsonl", {"conversationId": "a1", "workspace": "file:///ws"})
    args = (spark, str(tmp_path / "brain" / "*" / ".system_generated" / "logs"))
    s = only(agents.sessions_of("antigravity", agents.ingest_antigravity(*args, history_root=str(tmp_path / "history"))))
    assert (s.id, s.title, s.directory, s.content, s.message_count) == ("a1", "go", "/ws", "» go\n\n  well", 1)
    steps = spark.createDataFrame([("a1", 0, 14, 3, "from the store"), ("a1", 1, 15, 1, "pending")], "session_id string, idx bigint, step_type int, status int, text string").withColumn("ts", F.lit("2024-01-03").cast("timestamp"))
    s = only(agents.sessions_of("antigravity", agents.ingest_antigravity(*args, steps=steps, history_root=str(tmp_path / "history"))))
    assert s.content == "» from the store"


def parse(files):
    return agents.sessions_of("claude", agents.ingest_claude(files.sparkSession, files))


def test_stream_equals_batch_and_keeps_torn_sessions(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")

    def line(t):
        return {"type": "user", "message": {"content": t}}

    for i in range(5):
        write(root, f"v1/s{i}.jsonl", line(f"the first version of {i}"))
    first = stream.refresh_once(spark, str(root), out, "claude", parse, stem(F.col("path")), batch_files=2)
    batch = agents.sessions_of("claude", agents.ingest_claude(spark, str(root)))
    assert sorted(map(str, first.drop("mtime", "timestamp").collect())) == sorted(map(str, batch.drop("mtime", "timestamp").collect()))
    write(root, "v2/s0.jsonl", line("the second version of 0"))
    write(root, "v2/s1.jsonl", line("the second version of 1"), "{torn")  # nothing good behind the torn line
    write(root, "v2/s2.jsonl", "{torn", line("the second version of 2"))
    write(root, "v2/s3.jsonl", {"type": "other"})  # clean, but no session any more
    got = {r.id: r.content for r in stream.refresh_once(spark, str(root), out, "claude", parse, stem(F.col("path"))).collect()}
    assert got == {"s0": "» the second version of 0", "s1": "» the first version of 1", "s2": "» the second version of 2", "s4": "» the first version of 4"}
    m = stream.read_metrics(spark, out).agg(F.sum("files"), F.sum("upserts"), F.sum("retained"), F.sum("deletes")).first()
    assert tuple(m) == (9, 7, 1, 1)
    stream.compact(spark, out)
    assert stream.read_snapshot(spark, out).count() == 4


def test_uncommitted_batches_are_unseen(spark, tmp_path):
    from sessionlake.model import SESSION_LOG

    row = [("pi", "1", 1, "upsert", "t", "", None, "", 1, 1.0, False)]
    spark.createDataFrame(row, SESSION_LOG).write.parquet(f"{tmp_path}/log/batch_id=3")
    assert stream.read_snapshot(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("partitions", [1, 8])
def test_results_do_not_depend_on_partitions(spark, tmp_path, partitions):
    for i in range(6):
        write(tmp_path, f"s{i}.jsonl", *[{"type": "user", "message": {"content": f"message number {k} of {i}"}} for k in range(5)])
    from sessionlake.sources.scan import scan_files

    files = scan_files(spark, str(tmp_path), "*.jsonl").repartition(partitions)
    assert {r.content.count("» ") for r in parse(files).collect()} == {5}


def test_lines_of_files_over_the_limit_are_read(spark, tmp_path, monkeypatch):
    from sessionlake.sources import scan

    big = ["" if i % 7 == 3 else '{"n": %d}' % i for i in range(3000)]
    (tmp_path / "big.jsonl").write_bytes("\r\n".join(big).encode())
    (tmp_path / "small.jsonl").write_text('{"n": 0}\n{"n": 1}\n')
    want = sorted((r.path, r.line_no, r.raw) for r in scan.scan_jsonl(spark, str(tmp_path)).collect())
    assert len(want) > 2500 and scan.unread_files(spark, str(tmp_path), "*.jsonl").count() == 0
    monkeypatch.setattr(scan, "MOST_BYTES", 1000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = sorted((r.path, r.line_no, r.raw) for r in scan.scan_jsonl(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want
    assert [r.path.rsplit("/", 1)[-1] for r in scan.unread_files(spark, str(tmp_path), "*.jsonl").collect()] == ["big.jsonl"]


def prompt(t):
    return {"type": "user", "message": {"content": t}}


def contents(spark, out):
    return {(r.agent, r.id): r.content for r in stream.read_snapshot(spark, out).collect()}


def test_stores_are_refreshed_by_their_markers(spark, tmp_path, monkeypatch):
    import dataclasses

    from sessionlake.sources.stores import STORES
    from sessionlake.streaming import incremental

    fetched = []

    def parse(*tables):
        fetched.append(tuple(t.count() for t in tables))
        return agents.ingest_opencode(*tables)

    monkeypatch.setitem(STORES, "opencode", dataclasses.replace(STORES["opencode"], parse=parse))
    out, said = str(tmp_path / "out"), '[{"type":"text","data":{"text":"%s"}}]'

    def opencode(texts, late=None):
        s = spark.createDataFrame([(i, f"T{i}", "/o", 1000, 2000, "x") for i in texts], "id string, title string, directory string, time_created bigint, time_updated bigint, key string")
        m = spark.createDataFrame([(f"m{i}", i, 1, '{"role":"user"}') for i in texts] + [("m-", None, 1, "{}")], "id string, session_id string, time_created bigint, data string")
        p = spark.createDataFrame([(f"p{i}", f"m{i}", i, 9000 if i == late else 1, json.dumps({"type": "text", "text": t})) for i, t in texts.items()], "id string, message_id string, session_id string, time_created bigint, data string")
        return s, m, p

    def crush(rows):
        s = spark.createDataFrame([(i, "T", n, at, at) for i, n, at, _ in rows], "id string, title string, message_count int, created_at bigint, updated_at bigint")
        return s, spark.createDataFrame([(i, "user", p, at) for i, _, at, p in rows], "session_id string, role string, parts string, created_at bigint")

    def cursor(rows):
        meta = spark.createDataFrame([(i, "m", '{"name":"Chat"}', at, "/w") for i, at, _ in rows], "session_id string, key string, value string, mtime double, directory string")
        return meta, spark.createDataFrame([(i, n, json.dumps({"role": "user", "content": t})) for i, _, texts in rows for n, t in enumerate(texts)], "session_id string, seq bigint, value string")

    def go(**landed):
        found = incremental.refresh_incremental(spark, {}, out, landed=landed)
        assert not any(r.error for r in found.values()), found
        return {a: r.parsed for a, r in found.items()}

    first = {"opencode": opencode({"a": "one", "b": "two", "c": "three"}), "crush": crush([("x", 1, 5000, said % "question x"), ("y", 1, 5000, said % "question y"), ("z", 0, 5000, said % "none")]), "cursor": cursor([("k", 9.0, ["hello"])])}
    assert go(**first) == {"opencode": 3, "crush": 2, "cursor": 1} and fetched == [(3, 3, 3)]
    want = {("opencode", "a"): "» one", ("opencode", "b"): "» two", ("opencode", "c"): "» three", ("crush", "x"): "» question x", ("crush", "y"): "» question y", ("cursor", "k"): "» hello"}
    assert contents(spark, out) == want
    assert go(**first) == {"opencode": 0, "crush": 0, "cursor": 0}
    # a later part, a torn session, one without messages, a blob more; c is gone
    second = {"opencode": opencode({"a": "one", "b": "changed"}, late="b"), "crush": crush([("x", 1, 6000, "[{"), ("y", 0, 6000, said % "gone")]), "cursor": cursor([("k", 9.0, ["hello", "more"])])}
    assert go(**second) == {"opencode": 1, "crush": 1, "cursor": 1} and fetched[1:] == [(1, 1, 1)]
    want = {("opencode", "a"): "» one", ("opencode", "b"): "» changed", ("crush", "x"): "» question x", ("cursor", "k"): "» hello\n\n» more"}
    assert contents(spark, out) == want
    assert go(**second) == {"opencode": 0, "crush": 1, "cursor": 0}  # what is torn is tried again
    stream.compact(spark, out)
    assert go(opencode=second["opencode"]) == {"opencode": 0}
    broken = incremental.refresh_incremental(spark, {}, out, landed={"crush": (spark.range(1),) * 2, "cursor": tuple(t.limit(0) for t in second["cursor"])})
    assert broken["crush"].error and broken["cursor"].error is None
    del want[("cursor", "k")]
    assert contents(spark, out) == want


def test_incremental_refresh_parses_what_changed(spark, tmp_path):
    from sessionlake.streaming import incremental

    def refresh_incremental(*args, **more):
        return {a: r.parsed for a, r in incremental.refresh_incremental(*args, **more).items() if r.error is None}

    c, g, v, out = tmp_path / "claude", tmp_path / "grok", tmp_path / "vibe", str(tmp_path / "out")
    for i in range(4):
        write(c, f"p/s{i}.jsonl", prompt(f"the first version of {i}"))
    write(c, "p/sessions-index.json", {"entries": [{"sessionId": "s0", "summary": "From the index"}, {"sessionId": "s1", "summary": " "}]})
    write(g, "%2Fw/g1/updates.jsonl", chunk("user_message_chunk", "Hello"))
    write(g, "%2Fw/g1/summary.json", {"info": {"id": "g1"}, "created_at": "2024-01-01T00:00:00Z"})
    write(v, "session_1/meta.json", {"session_id": "v", "start_time": "2024-01-01T00:00:00"})
    write(v, "session_1/messages.jsonl", {"role": "user", "content": "hello"})
    roots = {"claude": str(c), "grok": str(g), "vibe": str(v)}
    assert refresh_incremental(spark, roots, out, wave=2) == {"claude": 4, "grok": 2, "vibe": 2}
    want = {**{("claude", f"s{i}"): f"» the first version of {i}" for i in range(4)}, ("grok", "g1"): "» Hello", ("vibe", "v"): "» hello"}
    assert contents(spark, out) == want
    assert {r.title for r in stream.read_snapshot(spark, out).where("id = 's0'").collect()} == {"From the index"}
    assert refresh_incremental(spark, roots, out) == {"claude": 0, "grok": 0, "vibe": 0}

    def later(path, *records):
        write(path.parent, path.name, *records)
        os.utime(path, (path.stat().st_mtime + 9,) * 2)

    later(c / "p/s0.jsonl", prompt("the second version of 0"))
    later(c / "p/s1.jsonl", prompt("the second version of 1"), "{torn")  # nothing good behind it: the old one stays
    later(c / "p/s2.jsonl", {"type": "other"})  # clean, but no session any more
    (c / "p/s3.jsonl").unlink()
    later(g / "%2Fw/g1/updates.jsonl", chunk("user_message_chunk", "Hello again"))  # its summary did not change
    later(v / "session_1/messages.jsonl", "{torn", {"role": "assistant", "content": "no user any more"})
    assert refresh_incremental(spark, roots, out) == {"claude": 3, "grok": 2, "vibe": 2}
    want = {("claude", "s0"): "» the second version of 0", ("claude", "s1"): "» the first version of 1", ("grok", "g1"): "» Hello again", ("vibe", "v"): "» hello"}
    assert contents(spark, out) == want
    # what was retained is tried again
    assert refresh_incremental(spark, roots, out) == {"claude": 1, "grok": 0, "vibe": 2}
    assert contents(spark, out) == want


def test_a_new_generation_is_seen_only_when_it_is_current(spark, tmp_path, monkeypatch):
    from sessionlake.streaming import commits

    out = str(tmp_path / "out")
    stream.rebuild(spark, out, parse_rows(spark, tmp_path / "a", "one"))
    before = stream.current(spark, out)
    seen, real = [], commits.switch

    def watched(spark, out, generation):
        seen.append({r.id for r in stream.read_snapshot(spark, out).collect()})
        real(spark, out, generation)

    monkeypatch.setattr(commits, "switch", watched)
    stream.rebuild(spark, out, parse_rows(spark, tmp_path / "b", "two"))
    stream.compact(spark, out)
    assert seen == [{"one"}, {"two"}] and {r.id for r in stream.read_snapshot(spark, out).collect()} == {"two"} and stream.current(spark, out) != before
    # what is not current goes after its time
    assert commits.vacuum(spark, out) == [] and before in commits.vacuum(spark, out, 0) and {r.id for r in stream.read_snapshot(spark, out).collect()} == {"two"}


def claude_folder(tmp_path, n):
    for i in range(n):
        write(tmp_path / "claude", f"p/s{i}.jsonl", prompt(f"the first version of {i}"))
    return tmp_path / "claude"


@pytest.mark.parametrize("fresh", ["compact", "rebuild"])
def test_marks_survive_a_new_generation(spark, tmp_path, fresh):
    from sessionlake.streaming.incremental import refresh_source

    root, out = claude_folder(tmp_path, 3), str(tmp_path / "out")
    assert refresh_source(spark, str(root), out, "claude").parsed == 3
    if fresh == "compact":
        stream.compact(spark, out)
    else:
        stream.rebuild(spark, out, stream.read_snapshot(spark, out))
    (root / "p/s1.jsonl").unlink()
    assert refresh_source(spark, str(root), out, "claude").parsed == 0
    assert contents(spark, out).keys() == {("claude", "s0"), ("claude", "s2")}


def test_sessions_without_marks_go_with_their_files(spark, tmp_path):
    from sessionlake.streaming.incremental import refresh_source

    root, out = claude_folder(tmp_path, 2), str(tmp_path / "out")
    stream.rebuild(spark, out, agents.sessions_of("claude", agents.ingest_claude(spark, str(root))))
    (root / "p/s0.jsonl").unlink()
    assert refresh_source(spark, str(root), out, "claude").parsed == 1 and contents(spark, out).keys() == {("claude", "s1")}


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    """Two followers, a refresh and a compaction of one log, all at once."""
    from concurrent.futures import ThreadPoolExecutor

    from sessionlake.streaming import commits
    from sessionlake.streaming.incremental import refresh_source, start_following

    root, g, out = claude_folder(tmp_path, 4), tmp_path / "grok", str(tmp_path / "out")
    for k in range(3):
        write(g, f"%2Fw/g{k}/updates.jsonl", chunk("user_message_chunk", f"Hello {k}"))
        write(g, f"%2Fw/g{k}/summary.json", {"created_at": "2024-01-01T00:00:00Z"})
    write(tmp_path / "vibe", "session_1/meta.json", {"session_id": "v", "start_time": "2024-01-01T00:00:00"})
    write(tmp_path / "vibe", "session_1/messages.jsonl", {"role": "user", "content": "hello"})
    jobs = [lambda a=a, r=r: start_following(spark, str(r), out, a, None, batch_files=2).awaitTermination() for a, r in (("claude", root), ("grok", g))]
    jobs += [lambda: refresh_source(spark, str(tmp_path / "vibe"), out, "vibe"), lambda: refresh_source(spark, str(root), out, "claude", wave=1), lambda: commits.compact(spark, out)]
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(j) for j in jobs]:
            done.result()
    want = {("claude", f"s{i}"): f"» the first version of {i}" for i in range(4)} | {("grok", f"g{k}"): f"» Hello {k}" for k in range(3)} | {("vibe", "v"): "» hello"}
    assert contents(spark, out) == want
    assert [refresh_source(spark, str(r), out, a).parsed for a, r in (("claude", root), ("grok", g), ("vibe", tmp_path / "vibe"))] == [0, 0, 0]
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda _: commits.claim(spark, str(tmp_path / "claimed")), range(24)))
    assert sorted(numbers) == list(range(24))


def test_a_commit_between_the_reading_and_the_switch_of_a_compaction_stays(spark, tmp_path, monkeypatch):
    from sessionlake.streaming import commits
    from sessionlake.streaming.incremental import refresh_source

    root, out = claude_folder(tmp_path, 2), str(tmp_path / "out")
    refresh_source(spark, str(root), out, "claude")
    real = commits.switch

    def late(spark, out, generation):
        write(root, "p/late.jsonl", prompt("a prompt that came late"))
        (root / "p/s0.jsonl").unlink()
        refresh_source(spark, str(root), out, "claude")
        real(spark, out, generation)

    monkeypatch.setattr(commits, "switch", late)
    stream.compact(spark, out)
    assert contents(spark, out).keys() == {("claude", "s1"), ("claude", "late")}
    assert refresh_source(spark, str(root), out, "claude").parsed == 0


def test_sources_fail_alone_and_incomplete_listings_remove_nothing(spark, tmp_path, monkeypatch):
    from sessionlake.sources import scan
    from sessionlake.streaming import incremental

    root, out = claude_folder(tmp_path, 2), str(tmp_path / "out")
    write(root, "q/s9.jsonl", prompt("a prompt in another folder"))
    roots = {"claude": str(root), "codex": str(tmp_path / "missing"), "pi": str(root / "p/s0.jsonl")}
    found = incremental.refresh_incremental(spark, roots, out)
    assert found["claude"].parsed == 3 and {a: r.error is None for a, r in found.items()} == {"claude": True, "codex": False, "pi": False}
    assert {tuple(r) for r in incremental.scan_status(spark, found).collect()} == {("claude", True, False), ("codex", False, True), ("pi", False, True)}
    (root / "p/s0.jsonl").unlink()
    real = scan.listing

    def unreadable(spark, path, glob="*"):
        if path == str(root) or path.endswith("/q"):
            raise PySparkException("Permission denied")
        return real(spark, path, glob)

    monkeypatch.setattr(scan, "listing", unreadable)
    found = incremental.refresh_source(spark, str(root), out, "claude")
    assert not found.complete and contents(spark, out).keys() == {("claude", "s0"), ("claude", "s1"), ("claude", "s9")}
    monkeypatch.setattr(scan, "listing", real)
    (root / "p").rename(tmp_path / "aside")
    (tmp_path / "file").write_text("not a directory")
    assert incremental.refresh_incremental(spark, {"claude": str(tmp_path / "file")}, out)["claude"].error and len(contents(spark, out)) == 3
    assert incremental.refresh_source(spark, str(root), out, "claude").complete and contents(spark, out).keys() == {("claude", "s9")}


def test_following_looks_at_what_came_alone(spark, tmp_path, monkeypatch):
    from sessionlake.sources import registry
    from sessionlake.streaming.incremental import start_following

    c, k, out = claude_folder(tmp_path, 2), tmp_path / "kimi", str(tmp_path / "out")
    write(c, "p/sessions-index.json", {"entries": [{"sessionId": "s0", "summary": "From the index"}]})
    write(k, "h/one/state.json", {"title": "T"})
    write(k, "h/one/agents/main/wire.jsonl", {"type": "context.append_message", "message": {"role": "user", "content": [{"type": "text", "text": "hello"}], "origin": {"kind": "user"}}})
    monkeypatch.setattr(registry, "readable_listing", None)  # a listing of the root would fail
    seen, real = [], registry.listing
    monkeypatch.setattr(registry, "listing", lambda spark, paths, *glob: seen.extend(paths) or real(spark, paths, *glob))
    for agent, root in (("claude", c), ("kimi", k)):
        start_following(spark, str(root), out, agent, None).awaitTermination()
    assert contents(spark, out) == {("claude", "s0"): "» the first version of 0", ("claude", "s1"): "» the first version of 1", ("kimi", "one"): "» hello"}
    assert {r.title for r in stream.read_snapshot(spark, out).where("id = 's0'").collect()} == {"From the index"}
    seen.clear()
    write(c, "p/s7.jsonl", prompt("a prompt that came later"))
    start_following(spark, str(c), out, "claude", None).awaitTermination()
    assert ("claude", "s7") in contents(spark, out) and {p.rpartition("/")[2] for p in seen} == {"s7.jsonl", "sessions-index.json"}


def test_a_renamed_thread_is_seen_without_a_change_of_its_file(spark, tmp_path):
    from sessionlake.streaming.incremental import refresh_source

    def titles(out):
        return {r.id: r.title for r in stream.read_snapshot(spark, out).collect()}

    c, out = claude_folder(tmp_path, 3), str(tmp_path / "out")
    index = c / "p/sessions-index.json"
    write(c, "p/sessions-index.json", {"entries": [{"sessionId": "s0", "summary": "First name"}, {"sessionId": "s1", "summary": "Stays"}]})
    assert refresh_source(spark, str(c), out, "claude").parsed == 3
    write(c, "p/sessions-index.json", {"entries": [{"sessionId": "s0", "summary": "Second name"}, {"sessionId": "s1", "summary": "Stays"}]})
    os.utime(index, (index.stat().st_mtime + 9,) * 2)
    assert refresh_source(spark, str(c), out, "claude").parsed == 1 and titles(out)["s0"] == "Second name" and titles(out)["s1"] == "Stays"
    write(c, "p/sessions-index.json", {"entries": [{"sessionId": "s1", "summary": "Stays"}]})
    assert refresh_source(spark, str(c), out, "claude").parsed == 1 and titles(out)["s0"] == "the first version of 0"
    assert refresh_source(spark, str(c), out, "claude").parsed == 0

    x = tmp_path / "codex"
    for k in "ab":
        write(x, f"sessions/rollout-{k}.jsonl", {"type": "session_meta", "payload": {"id": f"thread-{k}", "cwd": "/w"}}, {"type": "event_msg", "payload": {"type": "user_message", "message": f"a prompt of {k}"}})
    write(x, "session_index.jsonl", {"id": "thread-a", "thread_name": "Old"})
    assert refresh_source(spark, str(x), out, "codex").parsed == 2 and titles(out)["thread-a"] == "Old"
    write(x, "session_index.jsonl", {"id": "thread-a", "thread_name": "Old"}, {"id": "thread-a", "thread_name": "New"})
    assert refresh_source(spark, str(x), out, "codex").parsed == 1 and titles(out)["thread-a"] == "New" and titles(out)["thread-b"] == "a prompt of b"


def test_kimi_index_in_a_refresh(spark, tmp_path):
    from sessionlake.streaming.incremental import refresh_incremental

    k, out = tmp_path / "kimi", str(tmp_path / "out")
    write(k, "sessions/h/one/state.json", {"title": "T"})
    write(k, "sessions/h/one/agents/main/wire.jsonl", {"type": "context.append_message", "message": {"role": "user", "content": [{"type": "text", "text": "hello"}], "origin": {"kind": "user"}}})
    write(k, "session_index.jsonl", {"sessionId": "one", "sessionDir": "/home/u/sessions/h/one", "workDir": "/work/a"})
    go = lambda: refresh_incremental(spark, {"kimi": str(k)}, out, origins={"kimi": "/home/u/sessions"})["kimi"]
    first = go()
    assert first.error is None and first.parsed == 2 and [r.directory for r in stream.read_snapshot(spark, out).collect()] == ["/work/a"]
    write(k, "session_index.jsonl", {"sessionId": "one", "sessionDir": "/home/u/sessions/h/one", "workDir": "/work/b"})
    assert go().parsed == 2 and [r.directory for r in stream.read_snapshot(spark, out).collect()] == ["/work/b"] and go().parsed == 0
    assert [r.directory for r in agents.ingest_all(spark, {"kimi": str(k)}, origins={"kimi": "/home/u/sessions"}).collect()] == ["/work/b"]


def test_an_uncertain_header_keeps_what_is_known(spark, tmp_path):
    from sessionlake.streaming.incremental import refresh_source

    root, out = tmp_path / "copilot", str(tmp_path / "out")
    said = {"type": "user.message", "data": {"content": "a prompt that is long enough"}}
    for name in ("one", "two"):
        write(root, f"{name}.jsonl", {"type": "session.start", "data": {"sessionId": f"id-{name}"}}, said)
    assert refresh_source(spark, str(root), out, "copilot-cli").parsed == 2
    (root / "two.jsonl").unlink()
    write(root, "one.jsonl", "{torn", said)
    os.utime(root / "one.jsonl", ((root / "one.jsonl").stat().st_mtime + 9,) * 2)
    found = refresh_source(spark, str(root), out, "copilot-cli")
    assert not found.complete and contents(spark, out).keys() == {("copilot-cli", "id-one"), ("copilot-cli", "id-two")}
    write(root, "one.jsonl", {"type": "session.start", "data": {"sessionId": "id-one"}}, said)
    os.utime(root / "one.jsonl", ((root / "one.jsonl").stat().st_mtime + 19,) * 2)
    assert refresh_source(spark, str(root), out, "copilot-cli").complete and contents(spark, out).keys() == {("copilot-cli", "id-one")}


def parse_rows(spark, root, name):
    write(root, f"{name}.jsonl", prompt(f"a long enough prompt of {name}"))
    return agents.sessions_of("claude", agents.ingest_claude(spark, str(root)))


def test_sessions_whose_files_come_apart_are_followed(spark, tmp_path):
    from sessionlake.streaming.incremental import refresh_source, start_following

    g, v, out = tmp_path / "grok", tmp_path / "vibe", str(tmp_path / "out")

    def follow():
        for agent, root in (("grok", g), ("vibe", v)):
            start_following(spark, str(root), out, agent, None, batch_files=1).awaitTermination()
        return contents(spark, out)

    write(g, "%2Fw/g1/updates.jsonl", chunk("user_message_chunk", "Hello"))
    write(v, "session_1/meta.json", {"session_id": "v", "start_time": "2024-01-01T00:00:00"})
    follow()
    write(g, "%2Fw/g1/summary.json", {"created_at": "2024-01-01T00:00:00Z"})
    write(v, "session_1/messages.jsonl", {"role": "user", "content": "hello"})
    want = {("grok", "g1"): "» Hello", ("vibe", "v"): "» hello"}
    assert follow() == want
    write(g, "%2Fw/g2/summary.json", {"created_at": "2024-01-01T00:00:00Z"})
    assert follow() == want
    write(g, "%2Fw/g2/updates.jsonl", chunk("user_message_chunk", "Late"))
    os.utime(g / "%2Fw/g2/updates.jsonl", (1.7e9,) * 2)
    # a stream passes over files with old times, a listing does not
    assert refresh_source(spark, str(g), out, "grok").parsed == 2 and contents(spark, out) == want | {("grok", "g2"): "» Late"}
