"""Schemas and the table of agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SESSIONS = "id string, agent string, title string, directory string, timestamp timestamp, content string, message_count bigint, mtime double, yolo boolean"
MESSAGES = "agent string, session_id string, seq bigint, role string, text string, ts timestamp, counts_as_turn boolean, title_candidate boolean, yolo boolean"
SESSION_LOG = f"agent string, id string, version bigint, op string, {SESSIONS.replace('id string, agent string, ', '')}"
SESSION_COLUMNS = [c.split()[0] for c in SESSIONS.split(", ")]

#: Agent, badge, binary, permission flags, resume flags, whether permission flags apply.
AGENTS = (
    ("antigravity", "agy", "agy", ("--dangerously-skip-permissions",), ("--conversation",), True),
    ("claude", "claude", "claude", ("--dangerously-skip-permissions",), ("--resume",), True),
    ("codex", "codex", "codex", ("--dangerously-bypass-approvals-and-sandbox",), ("resume",), True),
    ("copilot-cli", "copilot", "copilot", ("--yolo",), ("--resume",), True),
    ("crush", "crush", "crush", ("--yolo",), ("--session",), True),
    ("cursor", "cursor", "agent", ("--yolo",), ("--resume",), True),
    ("grok", "grok", "grok", ("--always-approve",), ("--resume",), True),
    ("kimi", "kimi", "kimi", ("--yolo",), ("--session",), True),
    ("opencode", "opencode", "opencode", (), ("--session",), False),
    ("pi", "pi", "pi", (), ("--session",), False),
    ("vibe", "vibe", "vibe", ("--agent", "auto-approve"), ("--resume",), True),
    ("copilot-vscode", "vscode", "code", (), (), False),
)
AGENT_NAMES = tuple(a[0] for a in AGENTS)

#: Settings that results depend on.
SESSION_CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """Set what the operators' results depend on; cluster sizing is left to the cluster."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def agent_dim(spark: SparkSession) -> DataFrame:
    """(agent, badge, ord, binary, yolo_flags, resume_flags, supports_yolo): twelve rows, safe to broadcast."""
    rows = [(a, badge, i, binary, list(yolo), list(resume), ok) for i, (a, badge, binary, yolo, resume, ok) in enumerate(AGENTS)]
    return spark.createDataFrame(rows, "agent string, badge string, ord int, binary string, yolo_flags array<string>, resume_flags array<string>, supports_yolo boolean")
