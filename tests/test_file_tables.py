"""Tables of landed files: rows read, listed, refreshed and followed as the files that they are."""

from __future__ import annotations

import json
import os

import pytest

from sessionlake.plans import roundtrip
from sessionlake.plans.registry import QUERIES
from sessionlake.sources import agents
from sessionlake.sources.scan import RULES, append_files, list_source_files, listing, scan_jsonl, unread_files

SF = "/root/testdata/sf0.001"


def data_files(root) -> int:
    return sum(not n.startswith((".", "_")) for _, _, names in os.walk(root) for n in names)


def put(spark, root: str, **texts: str) -> None:
    """One table file; keyword a__b is the path a/b.jsonl."""
    rows = [(f"{root}/{k.replace('__', '/')}.jsonl", v) for k, v in texts.items()]
    append_files(spark.createDataFrame(rows, "path string, value string").coalesce(1), root)


def said(text: str, **more) -> str:
    return json.dumps({"type": "user", "message": {"content": text}, **more}) + "\n"


@pytest.mark.parametrize("agent", sorted(roundtrip._FILES))
def test_rows_give_the_sessions_that_files_give(spark, tmp_path, agent):
    found = []
    for root in (str(tmp_path / "plain"), str(tmp_path / "rows.files")):
        roundtrip._FILES[agent](spark, SF, root)
        sessions = agents.sessions_of(agent, agents.FILE_SOURCES[agent](spark, root)).select(roundtrip.KEPT)
        found.append(sorted(tuple(r) for r in sessions.collect()))
    assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("name", ("ingest_grok", "list_files", "scan_docs", "scan_jsonl"))
def test_landed_files_do_not_grow_with_sessions(spark, monkeypatch, tmp_path, name):
    roots = []

    def here(_, part, *ending):
        roots.append(str(tmp_path / f"{part}-{len(roots)}{''.join(ending)}"))
        return roots[-1]

    monkeypatch.setattr(roundtrip, "scratch", here)
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
    landed = [data_files(r) for r in roots]
    # 100 sessions, five lines each; four partitions a write
    assert landed and max(landed) <= 16


def test_rows_are_listed_and_scanned_as_files(spark, tmp_path):
    root = str(tmp_path / "logs.files")
    put(spark, f"{root}/a", one=said("first question"), agent__x="", two="\n{\n" + said("second question"))
    put(spark, f"{root}/b", three=said("third question") * 2)
    files = list_source_files(spark, root, RULES["claude"]).collect()
    assert {(r.session_id, r.size) for r in files} == {("one", len(said("first question"))), ("two", len(said("second question")) + 3), ("three", 2 * len(said("third question")))}
    assert {(r.path.rsplit("/", 1)[-1], r.line_no) for r in scan_jsonl(spark, root).collect()} == {("one.jsonl", 0), ("two.jsonl", 2), ("three.jsonl", 0), ("three.jsonl", 1)}
    assert unread_files(spark, root).count() == 0
    plan = listing(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[1]
    with pytest.raises(ValueError, match="does not end"):
        append_files(spark.createDataFrame([("/a", "b")], "path string, value string"), str(tmp_path / "plain"))
