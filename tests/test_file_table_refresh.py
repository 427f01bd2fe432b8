"""Tables of landed files, refreshed and followed."""

from __future__ import annotations

import dataclasses
import json
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from sessionlake.plans import roundtrip, streams
from sessionlake.plans.registry import ORACLE_SQL, QUERIES
from sessionlake.sources import scan
from sessionlake.sources.scan import append_files
from sessionlake.sources.stores import STORES
from sessionlake.streaming import incremental, refresh
from sessionlake.streaming.commits import known_keys, last_rows
from tests.test_file_tables import data_files, put, said


@pytest.mark.parametrize("name", ("stream_retain", "stream_siblings", "rebuild_then_delete"))
def test_landed_files_do_not_grow_with_sessions(spark, monkeypatch, tmp_path, name):
    roots = []

    def here(_, part, *ending):
        roots.append(str(tmp_path / f"{part}-{len(roots)}{''.join(ending)}"))
        return roots[-1]

    monkeypatch.setattr(roundtrip, "scratch", here)
    monkeypatch.setattr(streams, "scratch", here)
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
    landed = [data_files(r) for r in roots if "-out" not in r]
    # 100 sessions, five lines each; four partitions a write
    assert landed and max(landed) <= 16


def test_refresh_of_rows(spark, tmp_path):
    root, out = str(tmp_path / "logs.files"), str(tmp_path / "out")
    put(spark, f"{root}/dir=old", one=said("question number one"), gone=said("question number two"))
    assert incremental.refresh_source(spark, root, out, "claude").parsed == 2
    put(spark, f"{root}/dir=new", torn=said("question number three") + "{\n", four=said("question number four"))
    assert incremental.refresh_source(spark, root, out, "claude").parsed == 2  # of the new table file alone
    assert incremental.refresh_source(spark, root, out, "claude").parsed == 1  # the torn one is tried again
    assert {r.id for r in refresh.read_snapshot(spark, out).collect()} == {"one", "gone", "four"}
    put(spark, f"{root}/dir=kept", one=said("question number one"))
    shutil.rmtree(f"{root}/dir=old")
    done = incremental.refresh_source(spark, root, out, "claude")
    assert done.complete and {r.id for r in refresh.read_snapshot(spark, out).collect()} == {"one", "four"}


def test_index_rows_name_sessions_again(spark, tmp_path):
    root, out = str(tmp_path / "logs.files"), str(tmp_path / "out")
    put(spark, f"{root}/p", one=said("question number one"), two=said("question number two"))
    incremental.refresh_source(spark, root, out, "claude")
    index = json.dumps({"entries": [{"sessionId": "one", "summary": "named", "modified": "2024-01-01T00:00:00Z"}]})
    append_files(spark.createDataFrame([(f"{root}/i/sessions-index.json", index)], "path string, value string"), f"{root}/i")
    assert incremental.refresh_source(spark, root, out, "claude").parsed == 1
    assert {(r.id, r.title) for r in refresh.read_snapshot(spark, out).collect()} == {("one", "named"), ("two", "question number two")}


def test_following_rows_takes_all_files_of_a_session(spark, tmp_path):
    """A session's files lie in different table files, and come in different batches."""
    root, out = str(tmp_path / "logs.files"), str(tmp_path / "out")
    line = json.dumps({"params": {"update": {"sessionUpdate": "user_message_chunk", "content": {"text": "a question"}}}}) + "\n"
    summary = json.dumps({"info": {"id": "s", "cwd": "/g"}}) + "\n"
    for name, value in (("s/updates.jsonl", line), ("s/summary.json", summary), ("t/updates.jsonl", line)):
        append_files(spark.createDataFrame([(f"{root}/{name}", value)], "path string, value string").coalesce(1), root)
    incremental.start_following(spark, root, out, "grok", None, batch_files=1).awaitTermination()
    rows = refresh.read_snapshot(spark, out).select("id", "directory", "content").collect()
    assert [tuple(r) for r in rows] == [("s", "/g", "» a question")]


def test_many_removed_keys_are_not_broadcast(spark, tmp_path):
    out = str(tmp_path / "out")
    keys = spark.range(3).select(F.lit("claude").alias("agent"), F.col("id").cast("string").alias("id"))
    explain = [refresh.read_snapshot(spark, out, keys, few)._jdf.queryExecution().logical().toString() for few in (True, False)]
    # the log is read twice; the numbers of its committed batches are broadcast either way
    assert [e.count("strategy=broadcast") for e in explain] == [4, 2]


def test_sources_are_refreshed_at_once(spark, tmp_path, monkeypatch):
    """Each of two stores waits until the other is parsed too; neither's failure is the other's."""
    both = threading.Barrier(2, timeout=60)

    def waiting(store):
        def parse(*tables, **more):
            both.wait()
            return store.parse(*tables, **more)

        return dataclasses.replace(store, parse=parse)

    for agent in ("crush", "opencode"):
        monkeypatch.setitem(STORES, agent, waiting(STORES[agent]))
    tables = {a: roundtrip._TABLES[a](spark, "/root/testdata/sf0.001") for a in ("crush", "opencode")}
    out = str(tmp_path / "out")
    done = incremental.refresh_incremental(spark, {}, out, landed={**tables, "cursor": (spark.range(1),) * 2})
    assert [a for a, r in done.items() if r.error] == ["cursor"]
    assert sorted(done) == ["crush", "cursor", "opencode"] and sorted(r.batch_id for r in refresh.read_metrics(spark, out).select("batch_id").collect()) == [0, 1]
    assert {r.agent for r in refresh.read_snapshot(spark, out).select("agent").distinct().collect()} == {"crush", "opencode"}


def test_known_keys_are_those_of_last_rows(spark):
    log = spark.createDataFrame([("a", "put", 1, "upsert"), ("a", "gone", 1, "upsert"), ("a", "gone", 2, "delete"), ("a", "back", 1, "delete"), ("a", "back", 2, "upsert"), ("b", "same", 3, "upsert"), ("b", "same", 3, "delete")], "agent string, id string, version bigint, op string")
    want = last_rows(log).where("op <> 'delete'").select("agent", "id").collect()
    assert sorted(known_keys(log).collect()) == sorted(want) and {r.id for r in want} == {"put", "back"}


def over(monkeypatch, most: int) -> None:
    for module in (scan, incremental):
        monkeypatch.setattr(module, "MOST_BYTES", most)


def kept(spark, out) -> list[tuple]:
    return sorted(tuple(r) for r in refresh.read_snapshot(spark, out).select("agent", *[c for c in roundtrip.KEPT if c != "agent"]).collect())


@pytest.mark.parametrize("ending", ("", ".files"))
def test_sessions_of_large_files_are_refreshed(spark, tmp_path, monkeypatch, ending):
    """What files over MOST_BYTES say is what they say below it; block ends lie within them."""
    root, found = tmp_path / f"logs{ending}", []
    start = json.dumps({"type": "session.start", "data": {"sessionId": "named"}}) + "\n"
    reply = [json.dumps({"type": "user.message", "data": {"content": f"a question of number {i}"}}) + "\n" * (1 + i % 3) for i in range(200)]
    texts = {"small": start.replace("named", "other") + reply[0], "long": "\n\n" + start + "".join(reply), "unsure": "{\n" + "".join(reply), "torn": start.replace("named", "torn") + "".join(reply) + "{\n"}
    if ending:
        put(spark, str(root), **texts)
    else:
        root.mkdir()
        for name, text in texts.items():
            (root / f"{name}.jsonl").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        for i, most in enumerate((1 << 20, 1000)):
            over(monkeypatch, most)
            out = str(tmp_path / f"out{i}")
            done = incremental.refresh_source(spark, str(root), out, "copilot-cli")
            marks = incremental.read_marks(spark, out, "copilot-cli").select("key", "id", "size").collect()
            found.append((done, kept(spark, out), sorted(tuple(r) for r in marks)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and found[1][0] == incremental.Refreshed(4, 0, False)
    assert [(r[1], r[5]) for r in found[1][1]] == [("named", 200), ("other", 1)]


def test_a_document_that_is_too_large_leaves_its_session(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "logs", str(tmp_path / "out")
    for name in ("one", "two"):
        (root / name).mkdir(parents=True)
        (root / name / "updates.jsonl").write_text(json.dumps({"params": {"update": {"sessionUpdate": "user_message_chunk", "content": {"text": "a question " * 30}}}}) + "\n")
        (root / name / "summary.json").write_text(json.dumps({"info": {"id": name}}))
    incremental.refresh_source(spark, str(root), out, "grok")
    before = kept(spark, out)
    (root / "one" / "summary.json").write_text(json.dumps({"info": {"id": "one"}, "more": "x" * 200}))
    over(monkeypatch, 100)
    assert incremental.refresh_source(spark, str(root), out, "grok") == incremental.Refreshed(0, 1) and kept(spark, out) == before
    over(monkeypatch, 300)
    assert incremental.refresh_source(spark, str(root), out, "grok") == incremental.Refreshed(2)


def test_files_with_odd_names_are_refreshed(spark, tmp_path, monkeypatch):
    root = tmp_path / "logs"
    names = ("plain", "a name", "br[a]cket", "st*r", "per%20cent", "pl+us", "ümlaut", "{a,b}", "back\\slash")
    root.mkdir()
    for name in names:
        (root / f"{name}.jsonl").write_text(said(f"a question of {name}"))
    for i, most in enumerate((1 << 20, 10)):
        over(monkeypatch, most)
        out = str(tmp_path / f"out{i}")
        assert incremental.refresh_source(spark, str(root), out, "claude") == incremental.Refreshed(len(names))
        assert {(r[1], r[2]) for r in kept(spark, out)} == {(n, f"a question of {n}") for n in names}


def test_refresh_incremental_takes_every_session(spark, tmp_path, monkeypatch):
    """Large files, numbers below zero, and a first run without sessions."""
    duckdb = pytest.importorskip("duckdb")
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id < 8")
    over(monkeypatch, 300)
    for name, shifted in (("mixed", F.col("conv_id") - 4), ("odd", -2 * F.col("conv_id") - 1)):
        sf = str(tmp_path / name)
        turns.withColumn("conv_id", shifted).coalesce(1).write.parquet(f"{sf}/conversations.parquet")
        columns = [*roundtrip.KEPT, "wave"]
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet/*.parquet'")
        want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['refresh_incremental']})").fetchall())
        got = sorted(tuple(r) for r in QUERIES["refresh_incremental"](spark, sf).select(columns).collect())
        assert got == want and len(got) == 16


def test_refresh_incremental_says_which_source_failed(spark, monkeypatch):
    monkeypatch.setattr(streams, "grok_files", lambda *args: None)
    with pytest.raises(RuntimeError, match="left out.*grok.*NotADirectoryError"):
        QUERIES["refresh_incremental"](spark, "/root/testdata/sf0.001")
