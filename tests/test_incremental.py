import datetime as dt
import json

import pytest

from quillstone.functions.fingerprint import fnv1a
from quillstone.sources.manifest import Conflict, Manifests
from quillstone.streaming import incremental as inc
from quillstone.streaming.incremental import Target

FILES = "adapter string, source_key string, source_path string, file_size long, modified_ns long, version string"
RECORDS = "adapter string, source_key string, start_byte long, raw_line string, has_newline boolean, read_at timestamp, upto long"
STATE = "adapter string, source_key string, byte_offset long, fingerprint string, updated_at string, file_size long, modified_ns long"


def tables(spark, contents, at=0):
    files, records = [], []
    for key, data in contents.items():
        raw = data.encode()
        files.append(("log_a", key, f"/{key}", len(raw), at, "clash"))
        start = 0
        for line in raw.splitlines(keepends=True):
            records.append(("log_a", key, start, line.rstrip(b"\n").decode(), line.endswith(b"\n"), dt.datetime(2026, 1, 1), 1))
            start += len(line)
    return spark.createDataFrame(files, FILES), spark.createDataFrame(records, RECORDS)


def print_of(data):
    return f"{int(fnv1a([data.encode()[-4096:]])[0]):016x}"


def found(spark, contents, state):
    f, r = tables(spark, contents)
    s = spark.createDataFrame(state, STATE)
    rows = inc.pending(inc.listed_files(f), inc.latest_records(r), inc.latest_checkpoints(s)).collect()
    return {(x.source_key, x.start_byte) for x in rows}


def test_resume_replace_and_new(spark):
    a, b, c = "one\ntwo\nthree\n", "x\nÿy\nz\nhalf", "\n  \t\r\nreal\n"
    state = [
        ("log_a", "a", 8, print_of("one\ntwo\n"), "2026-02-01T00:00:00+02:00", 1, 1),
        ("log_a", "a", 4, print_of("one\n"), "2026-01-31T23:00:00Z", 1, 1),  # later in time, though not as text
        ("log_a", "b", 2, "0" * 16, "2026-01-01T00:00:00Z", 1, 1),
        ("log_a", "c", 999, print_of(""), "2026-01-01T00:00:00Z", 1, 1),
        ("log_a", "gone", 1, print_of("q"), "2026-01-01T00:00:00Z", 1, 1),
    ]
    assert found(spark, {"a": a, "b": b, "c": c, "d": ""}, state) == {("a", 4), ("a", 8), ("b", 0), ("b", 2), ("b", 6), ("c", 6)}
    assert found(spark, {"a": a}, state[:1]) == {("a", 8)}
    assert found(spark, {"a": a}, []) == {("a", 0), ("a", 4), ("a", 8)}


def test_long_files_use_the_last_4096_bytes(spark):
    data = "".join(f"line {i} ünïcode\n" for i in range(900))
    cut = data[: data.index("line 800 ")]
    n = len(cut.encode())
    assert found(spark, {"a": data}, [("log_a", "a", n, print_of(cut), "2026-01-01T00:00:00Z", 1, 1)]) == {("a", s) for s in _starts(data) if s >= n}
    one = "x" * 10_000 + "\n" + "end\n"
    assert found(spark, {"a": one}, [("log_a", "a", 10_001, print_of("x" * 10_000 + "\n"), "2026-01-01T00:00:00Z", 1, 1)]) == {("a", 10_001)}


def _starts(data):
    at = 0
    for line in data.splitlines(keepends=True):
        yield at
        at += len(line.encode())


def test_rereads_and_nulls(spark):
    f = spark.createDataFrame([("log_a", "a", "/a", 8, 1, "x"), ("log_a", "a", "/a", 8, 1, "x"), (None, "a", None, 1, 1, "x")], FILES)
    t = dt.datetime
    r = spark.createDataFrame(
        [("log_a", "a", 0, "ab", False, t(2026, 1, 1), 1), ("log_a", "a", 0, "abc", True, t(2026, 1, 2), 1), ("log_a", "a", 4, "def", True, None, 1), ("log_a", "a", None, "q", True, None, 1), ("log_a", "z", 0, "unlisted", True, None, 1), ("log_a", "a", 8, None, True, None, 1)],
        RECORDS,
    )
    s = spark.createDataFrame([("log_a", "a", None, None, None, None, None)], STATE)
    rows = inc.pending(inc.listed_files(f), inc.latest_records(r), inc.latest_checkpoints(s)).collect()
    assert {(x.start_byte, x.raw_line) for x in rows} == {(0, "abc"), (4, "def")}
    assert inc.pending(inc.listed_files(f.where("false")), inc.latest_records(r), inc.latest_checkpoints(s)).count() == 0


def test_runs_skip_and_repeat_nothing(spark, tmp_path):
    target = Target(spark, str(tmp_path / "t"))
    first = {"a": "one\ntwo\nhal", "b": "x\n"}
    with pytest.raises(RuntimeError):
        target.run(*tables(spark, first), fail_before_publish=True)
    assert target.version() == 0 and target.rows().count() == 0
    assert target.run(*tables(spark, first)) == 1
    assert {(r.source_key, r.raw_line) for r in target.rows().collect()} == {("a", "one"), ("a", "two"), ("b", "x")}
    before = sorted(x.name for x in (tmp_path / "t").iterdir())
    assert target.run(*tables(spark, first)) == 1 and target.rows().count() == 3  # nothing new, nothing published or left behind
    assert sorted(x.name for x in (tmp_path / "t").iterdir()) == before
    second = {"a": "one\ntwo\nhalf\nnext\n", "b": "y\n", "c": "new\n"}
    target.run(*tables(spark, second))
    lines = sorted((r.source_key, r.start_byte, r.raw_line) for r in target.rows().collect())
    assert lines == [("a", 0, "one"), ("a", 4, "two"), ("a", 8, "half"), ("a", 13, "next"), ("b", 0, "y"), ("c", 0, "new")]
    assert {(r.source_key, r.raw_line) for r in target.all_rows().collect()} >= {("b", "x"), ("b", "y")}
    assert {r.source_key: r.byte_offset for r in target.state().collect()} == {"a": 18, "b": 2, "c": 4}
    assert target.rows(1).count() == 3
    n = target.all_rows().count()
    target.compact()
    assert target.rows().count() == 6 and target.all_rows().count() == n - 1 and len(target.manifest()["rows"]) == 1


def test_a_file_that_vanishes_and_returns_is_not_repeated(spark, tmp_path):
    target = Target(spark, str(tmp_path / "t"))
    target.run(*tables(spark, {"a": "one\ntwo\n", "b": "x\n"}))
    assert target.run(*tables(spark, {"b": "x\n"})) == 1  # a isn't listed; its checkpoint and rows stay
    assert target.run(*tables(spark, {"a": "one\ntwo\n", "b": "x\n"})) == 1
    target.run(*tables(spark, {"b": "x\nz\n"}))
    target.run(*tables(spark, {"a": "one\ntwo\nthree\n"}))
    lines = sorted((r.source_key, r.start_byte, r.raw_line) for r in target.all_rows().collect())
    assert lines == [("a", 0, "one"), ("a", 4, "two"), ("a", 8, "three"), ("b", 0, "x"), ("b", 2, "z")]


def test_the_targets_rows_decide(spark, tmp_path):
    """A row that is in the target under the file's version is not made again, whatever the checkpoint says; one of another version doesn't count."""
    target = Target(spark, str(tmp_path / "t"))
    target.run(*tables(spark, {"a": "one\n", "b": "x\n"}))
    target.run(*tables(spark, {"a": "ONE\ntwo\n", "b": "x\n \n"}))  # a replaced; b only grew by a blank line
    assert sorted((r.source_key, r.raw_line) for r in target.all_rows().collect()) == [("a", "ONE"), ("a", "one"), ("a", "two"), ("b", "x")]
    assert len({r.version for r in target.all_rows().where("source_key = 'a'").collect()}) == 2
    assert len(target.manifest()["rows"]) == 2


def test_only_one_writer_publishes(spark, tmp_path):
    m = Manifests(spark, str(tmp_path / "m"))
    m.publish({"version": 1, "x": 1})
    with pytest.raises(Conflict):
        m.publish({"version": 1, "x": 2})
    assert m.read() == {"version": 1, "x": 1} and json.dumps(m.read(0)) == '{"version": 0}'
