"""Message-level operators and the assembly of sessions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.text import blank_to_null, truncate_title

USER_MARK, OTHER_MARK = "» ", "  "
#: What a user record that is no prompt begins with.
NOISE_PREFIXES = ("<command", "<local-command", "<environment_context>")
#: Marks behind which a wrapped request's metadata begins.
METADATA_MARKS = ("<ADDITIONAL_METADATA>", "<EPHEMERAL_MESSAGE>")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.when(role == "user", F.lit(USER_MARK)).otherwise(F.lit(OTHER_MARK)), text)


def drop_noise(messages: DataFrame, prefixes: Sequence[str] = NOISE_PREFIXES) -> DataFrame:
    """Messages of users and assistants that are no command echo or environment note."""
    noisy = F.lit(False)
    for p in prefixes:
        noisy = noisy | F.startswith(F.ltrim("text"), F.lit(p))
    return messages.where(F.col("role").isin("user", "assistant") & F.col("text").rlike(r"\S") & ~noisy)


def unwrap_request(c: Column) -> Column:
    """Text inside <USER_REQUEST>, else what stands before the first metadata mark; trimmed."""
    inner = F.regexp_extract(c, r"(?s)<USER_REQUEST>(.*?)</USER_REQUEST>", 1)
    rest = c
    for mark in METADATA_MARKS:
        rest = F.substring_index(rest, mark, 1)
    return F.regexp_replace(F.when(c.rlike(r"(?s)<USER_REQUEST>.*?</USER_REQUEST>"), inner).otherwise(rest), r"^\s+|\s+$", "")


def shell_input(c: Column) -> Column:
    """Text inside <bash-input>, its four entities decoded, &amp; last; null without the tag."""
    inner = F.regexp_extract(c, r"(?s)<bash-input>(.*?)</bash-input>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        inner = F.replace(inner, F.lit(entity), F.lit(char))
    return F.when(c.rlike(r"(?s)<bash-input>.*?</bash-input>"), F.regexp_replace(inner, r"^\s+|\s+$", ""))


def coalesce_chunks(chunks: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "seq") -> DataFrame:
    """Streamed chunks of one turn joined into one message.

    `chunks` has kind (user, agent, bash, rewind, other), prompt and text. A
    user run ends at any other record; an agent run only at a user chunk or a
    rewind. A run also ends where its prompt key changes.
    Result: keys, run, kind, prompt, text, first (place of its first chunk).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    kind = F.col("kind")
    # an agent run looks through records that do not end it
    breaks = F.sum(F.when(kind.isin("user", "rewind"), 1).otherwise(0)).over(w)
    user_before, prompt_before = F.lag("kind").over(w), F.lag("prompt").over(w)
    marked = chunks.withColumn("__segment", breaks).withColumn("__before", user_before).withColumn("__prompt", prompt_before)
    new_user = (kind == "user") & (~F.col("__before").eqNullSafe(F.lit("user")) | ~F.col("__prompt").eqNullSafe(F.col("prompt")))
    marked = marked.withColumn("__user_run", F.sum(F.when(new_user, 1).otherwise(0)).over(w))
    own = marked.where(kind.isin("user", "agent"))
    agent_w = Window.partitionBy(*keys, "__segment").orderBy(order)
    agent_prompt = F.last(F.when(kind == "agent", F.col("prompt")), ignorenulls=True).over(agent_w.rowsBetween(Window.unboundedPreceding, -1))
    changed = (kind == "agent") & agent_prompt.isNotNull() & ~agent_prompt.eqNullSafe(F.col("prompt"))
    own = own.withColumn("__change", changed).withColumn("__agent_run", F.sum(F.when(F.col("__change"), 1).otherwise(0)).over(agent_w))
    run = F.when(kind == "user", F.struct(F.col("__user_run").alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(F.struct(F.col("__segment").alias("a"), F.col("__agent_run").alias("b")))
    grouped = own.withColumn("__run", run).groupBy(*keys, "kind", "__run")
    out = grouped.agg(F.min(order).alias("first"), F.min_by("prompt", order).alias("prompt"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "").alias("text"))
    return out.where(F.col("text") != "").select(*keys, "first", "kind", "prompt", "text")


def fold_rewinds(entries: DataFrame, keys: Sequence[str] = ("session_id",), order: str = "seq") -> DataFrame:
    """History after rewinds: `kind` rewind with target n drops all from the n-th surviving user entry (from 0).

    The fold depends on order, since a target counts the users that earlier
    rewinds left; its state is one session's list.
    """
    item = F.struct(F.col(order).alias("seq"), "kind", "text", F.col("target").cast("int").alias("target"))
    listed = entries.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    fold = F.expr("""
        aggregate(items, cast(array() as array<struct<seq: bigint, kind: string, text: string, target: int>>), (kept, x) ->
          if(x.kind <> 'rewind', array_append(kept, named_struct('seq', cast(x.seq as bigint), 'kind', x.kind, 'text', x.text, 'target', x.target)),
             transform(array(filter(transform(kept, (k, i) -> if(k.kind = 'user', i, -1)), i -> i >= 0)), users ->
               if(x.target < 0 or x.target >= size(users), kept, slice(kept, 1, users[x.target])))[0]))""")
    kept = listed.select(*keys, F.explode(fold).alias("e"))
    return kept.select(*keys, F.col("e.seq").alias(order), "e.kind", "e.text")


HISTORY_EVENTS = "session_id string, seq bigint, kind string, ref string, call string, role string, texts array<string>, turn boolean, anchor boolean, summary boolean, count bigint"


def fold_history(events: DataFrame) -> DataFrame:
    """(session_id, place, role, texts, turn): the entries left after steps, undo, clear and compaction.

    `events` has the columns of HISTORY_EVENTS. Kinds: message (role, texts,
    turn, anchor, summary), step_begin (ref), part (ref, texts), tool_call (ref,
    call), tool_result (call), step_end (ref), compaction (texts), undo (count),
    clear, last_prompt (texts). A step is an entry to which the parts that name
    it are added while it is open; other parts vanish. While calls of open steps
    await their results, messages are held back; they follow when the last
    result comes, when a step ends without one missing, or when a step begins.
    undo, clear and compaction close all steps and discard what is held back.
    undo walks back over entries to the count-th anchor, but not over a summary
    or the place of the last clear. last_prompt is a user's turn if no turn is
    left and nothing since the last turn has undone or cleared. Entries without
    texts are left out. The fold's state is one session.
    """

    def fold(session: str | None, rows: Iterable[dict]) -> list[dict]:
        entries: list[dict] = []
        held: list[dict] = []
        steps: dict[str, dict] = {}
        pending: set[str] = set()
        floor, restorable = 0, True

        def release() -> None:
            entries.extend(held)
            held.clear()

        def close() -> None:
            steps.clear()
            pending.clear()
            held.clear()

        for r in rows:
            texts = list(r["texts"] or [])
            if r["kind"] == "message":
                restorable = restorable or bool(r["turn"])
                (held if pending else entries).append({"role": r["role"], "texts": texts, "turn": bool(r["turn"]), "anchor": bool(r["anchor"]), "summary": bool(r["summary"])})
            elif r["kind"] == "step_begin":
                pending.clear()
                release()
                if r["ref"]:
                    steps[r["ref"]] = {"role": "assistant", "texts": [], "turn": False, "anchor": False, "summary": False}
                    entries.append(steps[r["ref"]])
            elif r["kind"] == "part" and r["ref"] in steps:
                said = steps[r["ref"]]["texts"]
                said[:] = ["".join(said + texts)]
            elif r["kind"] == "tool_call" and r["call"] and r["ref"] in steps:
                pending.add(r["call"])
            elif r["kind"] == "tool_result" and r["call"] in pending:
                pending.remove(r["call"])
                if not pending:
                    release()
            elif r["kind"] == "step_end":
                steps.pop(r["ref"], None)
                if not pending:
                    release()
            elif r["kind"] == "compaction":
                close()
                entries.append({"role": "user", "texts": texts, "turn": False, "anchor": False, "summary": True})
            elif r["kind"] == "clear":
                close()
                floor, restorable = len(entries), False
            elif r["kind"] == "undo":
                close()
                left = r["count"] or 0
                restorable = restorable and left <= 0
                while left > 0 and len(entries) > floor and not entries[-1]["summary"]:
                    left -= entries.pop()["anchor"]
            elif r["kind"] == "last_prompt" and restorable and not any(e["turn"] for e in entries):
                entries.append({"role": "user", "texts": texts, "turn": True, "anchor": True, "summary": False})
        return [{"session_id": session, "place": i, "role": e["role"], "texts": e["texts"], "turn": e["turn"]} for i, e in enumerate(entries) if any(e["texts"])]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("session_id", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("texts", pa.list_(pa.string())), ("turn", pa.bool_())])
        out: list[dict] = []
        for session, rows in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["session_id"]):
            out += fold(session, rows)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    # a call for each batch of rows, not for each session; rows of a session follow one another
    ordered = events.repartition("session_id").sortWithinPartitions("session_id", F.asc_nulls_last("seq"))
    return ordered.mapInArrow(each, "session_id string, place bigint, role string, texts array<string>, turn boolean")


def assemble_sessions(messages: DataFrame, min_user_chars: int = 0) -> DataFrame:
    """(agent, session_id, content, first_user, message_count, last_ts) of sessions that have a user text.

    content: rendered texts in order, joined by a blank line; first_user: first
    user text of more than min_user_chars code points; message_count: records
    that count as a turn. A session's messages are its unit of memory.
    """
    long_user = (F.col("role") == "user") & (F.char_length("text") > min_user_chars)
    return (
        messages.groupBy("agent", "session_id")
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", rendered(F.col("role"), F.col("text")).alias("r")))), lambda x: x["r"]), "\n\n").alias("content"),
            F.min_by(F.when(long_user, F.col("text")), F.when(long_user, F.col("seq"))).alias("first_user"),
            F.count_if("counts_as_turn").alias("message_count"),
            F.max("ts").alias("last_ts"),
        )
        .where(F.col("first_user").isNotNull())
    )


def resolve_title(*candidates: Column, first_user: Column, limit: int = 100, word_break: bool = True) -> Column:
    """The first candidate that is not blank, else the cut first user text."""
    return F.coalesce(*[blank_to_null(c) for c in candidates], truncate_title(first_user, limit, word_break))


def last_title(title: Column, order: Column) -> Column:
    """Aggregate: the last title that is not blank."""
    return F.max_by(blank_to_null(title), F.when(title.rlike(r"\S"), order))


def yolo_flag(approval: Column, sandbox: Column) -> Column:
    """Aggregate: whether any turn ran without approvals or with full access."""
    return F.coalesce(F.bool_or((approval == "never") | (sandbox == "danger-full-access")), F.lit(False))


def explode_messages(sessions: DataFrame) -> DataFrame:
    """Messages of a session's content: split at blank lines, blank pieces left out, role by their mark."""
    pieces = sessions.select("agent", "id", F.posexplode(F.split("content", "\n\n", -1)).alias("pos", "piece"))
    piece = F.col("piece")
    role = F.when(F.startswith(F.ltrim(piece), F.lit(USER_MARK)), "user").when(F.startswith(piece, F.lit(OTHER_MARK)), "assistant").otherwise("other")
    return pieces.where(piece.rlike(r"\S")).select("agent", "id", "pos", role.alias("role"), piece.alias("text"))


def code_blocks(messages: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Fenced blocks of each message: keys, block (from 0), language, code.

    Fence lines toggle; the language is the first word behind an opening fence.
    A block that is never closed ends with the message.
    """
    lines = messages.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    fence = F.startswith(F.ltrim("line"), F.lit("```"))
    w = Window.partitionBy(*keys).orderBy("n")
    counted = lines.withColumn("fence", fence).withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(w))
    inside = counted.where("fences % 2 = 1").withColumn("block", F.floor((F.col("fences") - 1) / 2))
    language = F.max(F.when(F.col("fence"), F.lower(F.regexp_extract("line", r"^\s*```+\s*(\S*)", 1))))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("fence"), F.struct("n", "line")))), lambda x: x["line"]), "\n")
    return inside.groupBy(*keys, "block").agg(language.alias("language"), code.alias("code"))


def _slash(command: Column, args: Column) -> Column:
    given = F.coalesce(args, F.lit(""))
    return F.concat(command, F.when(given.rlike(r"\S"), F.concat(F.lit(" "), F.regexp_replace(given, r"^\s+|\s+$", ""))).otherwise(""))


def project_commands(kind: Column, trigger: Column, skill: Column, skill_args: Column, plugin: Column, command: Column, command_args: Column) -> Column:
    """What was typed, for a message whose text is the expanded prompt of a skill or a plugin's command; null for any other."""
    typed = F.coalesce(trigger == "user-slash", F.lit(False))
    of_skill = F.when(typed, _slash(F.concat(F.lit("/"), skill), skill_args)).otherwise(F.concat(F.lit("Activated skill: "), skill))
    of_plugin = _slash(F.concat(F.lit("/"), plugin, F.lit(":"), command), command_args)
    return F.when((kind == "skill_activation") & (skill != ""), of_skill).when((kind == "plugin_command") & (plugin != "") & (command != ""), of_plugin)
