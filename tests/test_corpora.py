import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import dialect
from quillstone.sources import corpora
from quillstone.sources.session_lines import notes
from quillstone.sources.store import Lease, Store
from quillstone.streaming import passes


def entry(i, sessions):
    return {"question_id": i, "question": "q", "question_type": "t", "answer_session_ids": ["s0"], "haystack_sessions": sessions, "haystack_session_ids": [f"s{k}" for k in range(len(sessions))], "haystack_dates": ["2026-01-01"] * len(sessions)}


def test_questions_and_sessions(spark, tmp_path):
    turn = lambda r, c: {"role": r, "content": c}
    data = [entry("a", [[turn("user", "one"), turn("assistant", "no"), turn("user", "two")], [turn("assistant", "x")], [turn("user", "three")]]), entry("b", [[turn("user", "four")]])]
    (tmp_path / "q.json").write_text(json.dumps(data))
    rows = corpora.questions(spark, str(tmp_path / "q.json"))
    assert {(r.id, r.content, r.chunk_index) for r in corpora.session_drawers(rows).collect()} == {("a:0:s0", "one\ntwo", 0), ("a:2:s2", "three", 2), ("b:0:s0", "four", 0)}
    assert corpora.questions(spark, str(tmp_path / "q.json"), 1).count() == 1
    split = spark.createDataFrame([("b",), ("b",)], "id string")
    assert [r.question_id for r in corpora.of_split(rows, split).collect()] == ["b"] and corpora.of_split(rows, None).count() == 2
    with pytest.raises(Exception, match="differ in number: a"):
        corpora.session_drawers(rows.withColumn("haystack_dates", F.array(F.lit("x")))).collect()


def test_record_files_and_sinks(spark, tmp_path):
    (tmp_path / "z" / "deep").mkdir(parents=True)
    for name in ("b.json", "a.json", "deep/c.json", "n.txt"):
        (tmp_path / "z" / name).write_text(json.dumps({"source_file": f"{name[0]}-x.txt"}))
    rows = dialect.encoded_files(corpora.record_files(spark, str(tmp_path / "z")))
    assert [r.dialect for r in rows.orderBy("path").collect()] == ["a|???|unknown|x", "b|???|unknown|x"]
    corpora.write_dialect(rows, str(tmp_path / "d"), "path")
    corpora.write_results(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2 and spark.read.text(str(tmp_path / "d")).where("value != ''").count() == 2


def test_first_pass_is_asked_for(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    (root / "a.jsonl").write_text("{}\n")
    roots, lease = passes.Roots(spark, str(tmp_path / "roots")), Lease(spark, str(tmp_path / "lease"), "me")
    go = lambda by_hand, read=lambda: 7: passes.one_pass(roots, lease, "log_a", str(root), read, by_hand=by_hand)
    assert go(False) == passes.Report(discovered=1, waiting_for_first_run=1)
    assert go(True, lambda: 1 / 0).errors == ["division by zero"] and not roots.initialised("log_a", str(root))
    assert go(True).imported == 7 and go(False).imported == 7 and not roots.initialised("log_b", str(root))
    other = Lease(spark, str(tmp_path / "lease"), "other")
    assert other.acquire() and go(True).busy
    ran = []
    assert passes.poll(lambda: ran.append(1), 0) == 1 and passes.poll(lambda: ran.append(1), 5, stop=lambda: len(ran) >= 3, sleep=lambda s: None) == 2


def test_notes(spark, tmp_path):
    folder = tmp_path / "root" / "proj" / "memory"
    folder.mkdir(parents=True)
    (folder / "n.md").write_text("---\nkey: v\n---\n# Ferry\n\nThe ferry stops twice a day near the old pier, said the guide.\n")
    (folder / "x.txt").write_text("no")
    assert notes(str(tmp_path / "root")) == [str(folder / "n.md")]
    store = Store(spark, str(tmp_path / "s"))
    assert passes.sync_notes(store, str(tmp_path / "root"), "w", "agent") == 1 and passes.sync_notes(store, str(tmp_path / "root"), "w", "agent") == 0
    (d,) = store.drawers().collect()
    assert d.content.startswith("# Ferry") and d.source_file == str(folder / "n.md") and "title: Ferry" in d.retrieval_text
    (folder / "n.md").write_text("# Gone\n\nThe ferry has not been seen here since the first week of the long winter.\n")
    assert passes.sync_notes(store, str(tmp_path / "root"), "w", "agent") == 1
    assert [r.content[:6] for r in store.drawers().collect()] == ["# Gone"]
