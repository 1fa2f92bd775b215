import json

from quillstone.sources.session_lines import SessionLines, discover
from quillstone.streaming import assembly

COLUMNS = "adapter string, source_key string, source_path string, start_byte long, raw_line string"


def user(text, at="2026-07-01T00:00:00Z"):
    return {"timestamp": at, "type": "event_msg", "payload": {"type": "user_message", "message": text}}


def final(text, phase="final_answer"):
    return {"timestamp": "2026-07-01T00:01:00Z", "type": "response_item", "payload": {"type": "message", "role": "assistant", "phase": phase, "content": [{"type": "output_text", "text": text}]}}


META = {"type": "session_meta", "payload": {"id": "s1", "cwd": "/home/me/My Project"}}


def b(kind, uid, parent, text, stop=None, **more):
    message = {"role": kind, "content": text, "id": f"m-{uid}"}
    return {"type": kind, "uuid": uid, "parentUuid": parent, "sessionId": "s2", "cwd": "/w/p", "timestamp": f"2026-07-02T00:00:0{len(uid) % 10}Z", "message": message | ({"stop_reason": stop} if stop else {}), **more}


def table(spark, logs):
    rows = []
    for (adapter, key), lines in logs.items():
        at = 0
        for line in lines:
            raw = line if isinstance(line, str) else json.dumps(line)
            rows.append((adapter, key, key, at, raw))
            at += len(raw.encode()) + 1
    return spark.createDataFrame(rows[::-1], COLUMNS)


def test_format_a(spark):
    logs = {
        ("log_a", "one"): [META, user("q1"), final("thinking", "commentary"), "{broken", "", user("q2"), final("done"), final("unasked"), user("open")],
        ("log_a", "sub"): [{"type": "session_meta", "payload": {"id": "s", "thread_source": "subagent"}}, user("q"), final("a")],
    }
    (x,) = assembly.exchanges(table(spark, logs)).collect()
    assert (x.users, x.assistant, x.session_id, x.timestamp) == (["q1", "q2"], "done", "s1", "2026-07-01T00:01:00Z")
    (d,) = assembly.as_drawers(assembly.exchanges(table(spark, logs)), "w").collect()
    assert d.content == "user: q1\nuser: q2\nassistant: done" and d.room == "my-project" and d.id.startswith("drawer_session_")
    assert d.retrieval_text.startswith("kind: conversation\nagent: log_a\nsession: s1\nproject: /home/me/My Project\ndate: 2026-07-01\nuser: q1")
    assert assembly.exchanges(table(spark, logs).where("false")).count() == 0


def test_format_b(spark):
    lines = [
        b("user", "u1", None, "first"), b("assistant", "t1", "u1", "working", "tool_use"), b("user", "r1", "t1", "result", toolUseResult={"x": 1}),
        b("user", "u2", "r1", "steer"), b("assistant", "a1", "u2", [{"type": "text", "text": "answer"}, {"type": "tool", "text": "no"}], "end_turn"),
        b("user", "u3", "a1", "next"), b("assistant", "a2", "u3", "two", "end_turn"), b("assistant", "a3", "u3", "again", "end_turn"), b("user", "m", None, "meta", isMeta=True), b("user", "s", None, "side", isSidechain=True),
    ]
    got = [(x.users, x.assistant, x.anchor) for x in assembly.exchanges(table(spark, {("log_b", "k"): lines})).collect()]
    assert got == [(["first", "steer"], "answer", "u1:m-a1"), (["next"], "two", "u3:m-a2"), (["next"], "again", "u3:m-a3")]


def test_state_is_bounded_and_resumes():
    m = assembly.Threads()
    for i in range(400):
        m.feed(b("user", f"u{i}", None, "q"), 0)
        m = assembly.Threads(json.loads(json.dumps(m.s)))
        assert m.feed(b("assistant", f"a{i}", f"u{i}", "x", "end_turn"), 0)
    assert len(m.s["answered"]) == len(m.s["asked"]) == len(m.s["root_of"]) == 256


def test_stream_tails_files(spark, tmp_path):
    logs = tmp_path / "logs" / "deep"
    logs.mkdir(parents=True)
    a = logs / "a.JSONL"
    dump = lambda *rs: "".join(json.dumps(r) + "\n" for r in rs)
    a.write_text(dump(META, user("q1"), final("a1"), user("q2")) + '{"half')
    (logs / "no.txt").write_text("x\n")
    assert discover(str(tmp_path / "logs")) == [str(a)] and discover(str(tmp_path / "logs"), 0) == []
    spark.dataSource.register(SessionLines)
    assert spark.read.format("session_lines").option("path", str(tmp_path / "logs")).load().count() == 4
    got = []

    def sync():
        lines = spark.readStream.format("session_lines").option("path", str(tmp_path / "logs")).load()
        run = assembly.exchange_stream(lines).writeStream.foreachBatch(lambda df, _: got.extend((r.users, r.assistant) for r in df.collect()))
        run.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    sync()
    assert got == [(["q1"], "a1")]
    sync()
    assert len(got) == 1
    a.write_text(dump(META, user("q1"), final("a1"), user("q2")) + dump(final("a2")))
    sync()
    assert got == [(["q1"], "a1"), (["q2"], "a2")]
