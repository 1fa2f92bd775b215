"""From lines of session logs to exchanges: what the user asked, with the final answer.

Two formats are known, each read by a small state machine whose state is plain JSON, so
that a stream can stop anywhere and go on. ``exchanges`` reads whole tables: lines are
sorted within files and a task streams over them, one record at a time; ``exchange_stream``
keeps the state of each file in the state store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

FORMATS = ("log_a", "log_b")
#: Fixed value: how many answered prompts of a file are remembered, to tell a new answer from a new question.
REMEMBERED = 256
OUT = "adapter string, source_key string, source_path string, anchor string, users array<string>, assistant string, timestamp string, session_id string, project string"


def _text(x) -> str | None:
    return (x.strip() or None) if isinstance(x, str) else None


def _dict(x) -> dict:
    return x if isinstance(x, dict) else {}


def _joined(parts, kind: str) -> str | None:
    if not isinstance(parts, list):
        return None
    return "\n".join(t for p in parts if isinstance(p, dict) and p.get("type") == kind and (t := _text(p.get("text")))) or None


class Turns:
    """Format A: questions wait until a final answer takes them all."""

    def __init__(self, state: dict | None = None) -> None:
        self.s = state or {"session": None, "project": None, "skip": False, "known": False, "waiting": []}

    def feed(self, r: dict, offset: int) -> dict | None:
        s, kind, load, at = self.s, r.get("type"), _dict(r.get("payload")), r.get("timestamp")
        at = at if isinstance(at, str) else None
        if kind == "session_meta" and s["session"] is None:
            s["session"], s["project"] = (load.get(k) if isinstance(load.get(k), str) else None for k in ("id", "cwd"))
            s["skip"] = load.get("thread_source") == "subagent" or _dict(load.get("source")).get("subagent") is not None
            return None
        if s["skip"]:
            return None
        if kind == "event_msg" and load.get("type") == "user_message":
            if question := _text(load.get("message")):
                anchor = load.get("client_id")
                s["waiting"].append([question, anchor if isinstance(anchor, str) else str(offset), at])
            return None
        final = kind == "response_item" and (load.get("type"), load.get("role"), load.get("phase")) == ("message", "assistant", "final_answer")
        answer = _joined(load.get("content"), "output_text") if final and s["waiting"] else None
        if answer is None:
            return None
        asked, s["waiting"] = s["waiting"], []
        return {"anchor": asked[0][1], "users": [q[0] for q in asked], "assistant": answer, "timestamp": at or asked[0][2], "session_id": s["session"], "project": s["project"]}


class Threads:
    """Format B: records name their parents; an answer belongs to the question its line of parents leads to."""

    def __init__(self, state: dict | None = None) -> None:
        self.s = state or {"session": None, "project": None, "root_of": {}, "asked": {}, "answered": []}

    @staticmethod
    def _said(message: dict) -> str | None:
        content = message.get("content")
        return _text(content) if isinstance(content, str) else _joined(content, "text")

    def feed(self, r: dict, offset: int) -> dict | None:
        s = self.s
        if r.get("isSidechain") is True or r.get("agentId") is not None:
            return None
        if s["session"] is None:
            session = r.get("sessionId", r.get("session_id"))
            s["session"] = session if isinstance(session, str) else None
        if s["project"] is None:
            s["project"] = r.get("cwd") if isinstance(r.get("cwd"), str) else None
        me, message, at = r.get("uuid"), _dict(r.get("message")), r.get("timestamp")
        me, at = me if isinstance(me, str) else None, at if isinstance(at, str) else None
        root = s["root_of"].get(r.get("parentUuid")) if isinstance(r.get("parentUuid"), str) else None
        role = message.get("role")
        if r.get("type") == "user" and role == "user" and r.get("isMeta") is not True and r.get("toolUseResult") is None and r.get("sourceToolAssistantUUID") is None:
            question = self._said(message)
            if me and question:
                root = root if root is not None and root not in s["answered"] else me
                s["root_of"][me] = root
                s["asked"].setdefault(root, []).append([question, me, at])
            return None
        if me and root is not None:
            s["root_of"][me] = root
        if not (r.get("type") == "assistant" and role == "assistant" and message.get("stop_reason") == "end_turn"):
            return None
        answer, asked = self._said(message), s["asked"].get(root)
        if answer is None or not asked:
            return None
        name = message.get("id") if isinstance(message.get("id"), str) else f"offset-{offset}"
        self._close(root, {q[1] for q in asked})
        return {"anchor": f"{asked[0][1]}:{name}", "users": [q[0] for q in asked], "assistant": answer, "timestamp": at or asked[0][2], "session_id": s["session"], "project": s["project"]}

    def _close(self, root: str, anchors: set[str]) -> None:
        """An answered question keeps only its own records in the line of parents; beyond the remembered number the oldest is forgotten."""
        s = self.s
        if root not in s["answered"]:
            s["answered"].append(root)
        s["root_of"] = {k: v for k, v in s["root_of"].items() if v != root or k in anchors}
        for old in s["answered"][:-REMEMBERED]:
            s["asked"].pop(old, None)
            s["root_of"] = {k: v for k, v in s["root_of"].items() if v != old}
        s["answered"] = s["answered"][-REMEMBERED:]


def machine(adapter: str, state: dict | None = None):
    return Turns(state) if adapter == FORMATS[0] else Threads(state)


def _parsed(line: str) -> dict | None:
    try:
        r = json.loads(line)
    except ValueError:
        return None
    return r if isinstance(r, dict) else None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def _row(key: tuple, x: dict) -> tuple:
    return (*key, x["anchor"], x["users"], x["assistant"], x["timestamp"], x["session_id"], x["project"])


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, m = None, None
    for pdf in frames:
        rows = []
        for adapter, source_key, path, start, line in zip(pdf.adapter, pdf.source_key, pdf.source_path, pdf.start_byte, pdf.raw_line):
            if (adapter, source_key) != key:
                key, m = (adapter, source_key), machine(adapter)
            r = _parsed(line)
            done = m.feed(r, int(start)) if r is not None else None
            if done:
                rows.append(_row((adapter, source_key, path), done))
        yield _frame(rows)


def exchanges(records: DataFrame) -> DataFrame:
    """Exchanges of complete lines ``adapter, source_key, source_path, start_byte, raw_line``, each file from its beginning. Malformed lines are passed over."""
    rows = records.select("adapter", "source_key", F.coalesce("source_path", "source_key").alias("source_path"), "start_byte", "raw_line").where("adapter is not null and source_key is not null and raw_line is not null")
    order = rows.repartition("adapter", "source_key").sortWithinPartitions("adapter", "source_key", "start_byte")
    return order.mapInPandas(_read, OUT)


def exchange_stream(records: DataFrame) -> DataFrame:
    """``exchanges`` of a stream; lines of a file must come in order, batch by batch."""

    def step(key, frames, state):
        saved = json.loads(state.get[0]) if state.exists else None
        m = machine(key[0], saved)
        rows = []
        every = pd.concat(list(frames)).sort_values("start_byte")
        for path, start, line in zip(every.source_path, every.start_byte, every.raw_line):
            r = _parsed(line)
            done = m.feed(r, int(start)) if r is not None else None
            if done:
                rows.append(_row((*key, path), done))
        state.update((json.dumps(m.s),))
        yield _frame(rows)

    return records.groupBy("adapter", "source_key").applyInPandasWithState(step, OUT, "cursor string", "append", "NoTimeout")


def _ids(adapter, path, session, anchor):
    names = (f"{a}:{p}:{s}:{x}" for a, p, s, x in zip(adapter, path, session, anchor))
    return pd.Series([f"drawer_session_{uuid.uuid5(uuid.NAMESPACE_URL, n).hex}" for n in names], dtype=object)


_ids.__annotations__ = {"adapter": pd.Series, "path": pd.Series, "session": pd.Series, "anchor": pd.Series, "return": pd.Series}


def as_drawers(rows: DataFrame, wing: str | Column) -> DataFrame:
    """Exchanges as drawers: the same exchange always gets the same id."""
    session = F.coalesce("session_id", F.lit("unknown-session"))
    content = F.concat(F.array_join(F.transform("users", lambda u: F.concat(F.lit("user: "), u)), "\n"), F.lit("\nassistant: "), F.col("assistant"))
    project = F.element_at(F.filter(F.split("project", r"[/\\]"), lambda p: p != ""), -1)
    room = F.coalesce(F.nullif(T.slug_hyphen(project), F.lit("")), F.lit("general"))
    context = F.concat_ws(
        "\n",
        F.lit("kind: conversation"),
        F.concat(F.lit("agent: "), "adapter"),
        F.concat(F.lit("session: "), session),
        F.concat(F.lit("project: "), "project"),
        F.when(F.length("timestamp") >= 10, F.concat(F.lit("date: "), F.left("timestamp", F.lit(10)))),
        content,
    )
    return rows.select(
        F.pandas_udf(_ids, "string")("adapter", "source_path", session, "anchor").alias("id"),
        content.alias("content"),
        context.alias("retrieval_text"),
        F.lit("conversation").alias("content_kind"),
        (F.lit(wing) if isinstance(wing, str) else wing).alias("wing"),
        room.alias("room"),
        F.col("source_path").alias("source_file"),
        F.lit(0).cast("long").alias("chunk_index"),
        F.col("adapter").alias("added_by"),
        F.col("timestamp").alias("filed_at"),
    )
