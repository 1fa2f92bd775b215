import json
from pathlib import Path

from pyspark.sql import functions as F

from quillstone import cli, settings
from quillstone.operators import evaluate
from quillstone.settings import Settings
from quillstone.sources.store import Lease
from quillstone.streaming import passes
from quillstone.tools import TOOLS, Tools, call


def test_settings_are_kept(tmp_path, monkeypatch):
    folder = str(tmp_path / "s")
    s = Settings.load(folder)
    assert s.store_path() == f"{folder}/store" and s.people == {}
    assert json.loads(Path(s.create()).read_text())["mode"] is None
    s.onboard("work", ["w"], ["p"])
    s.create()  # doesn't overwrite
    again = Settings.load(folder)
    assert (again.mode, again.topic_wings, again.projects) == ("work", ["w"], ["p"])
    again.save_people({"Al": "Alice"})
    assert Settings.load(folder).people == {"Al": "Alice"}
    monkeypatch.setenv("HOME", "/home/me")
    s.roots = {"log_a": "~/logs", "log_b": "/srv/x", "log_c": "~"}
    assert [s.root(a, "u", "v") for a in ("log_a", "log_b", "log_c", "log_d")] == ["/home/me/logs", "/srv/x", "/home/me/", "/home/me/u/v"]


def test_dialect_settings(tmp_path):
    path = settings.save_dialect(str(tmp_path / "d.json"), {"Alice": "ALC", "alice": "ALC", "Alicia": "ALC", "Bob": "BOB"}, ("bot",))
    assert settings.load_dialect(path) == ({"Alice": "ALC", "Bob": "BOB"}, ("bot",))


def test_wings(tmp_path):
    project = tmp_path / "proj"
    project.mkdir()
    (project / "a.py").write_text("x")
    assert settings.search_wing("w", everywhere=True, scope=str(project)) == "w" and settings.search_wing(everywhere=True, scope=str(project)) is None
    assert settings.search_wing(scope=str(project / "a.py")) == "proj" and settings.search_wing(scope=str(tmp_path / "none")) is None
    assert settings.search_wing(here=str(project)) is None
    (project / "go.mod").write_text("")
    assert settings.search_wing(here=str(project)) == "proj"
    assert [settings.project_wing(*x) for x in (("n", None, "/a/b"), (None, settings.Routing("r"), "/a/b"), (None, settings.Routing(), "/a/b"), (None, None, "/"))] == ["n", "r", "b", "project"]


def test_routing_round_trip(tmp_path):
    r = settings.Routing("w: x", [("api", 'says "hi"', ["route", "end point"]), ("docs", "", [])])
    (tmp_path / "quillstone.yaml").write_text(settings.routing_text(r))
    assert settings.read_routing(str(tmp_path / "quillstone.yaml")) == r
    (tmp_path / "hand.yaml").write_text("wing: app  # mine\nrooms:\n  - name: api\n    keywords: [a, 'b c']\n  - name: ui\n    description: it's one\n    keywords:\n      - button\n")
    assert settings.read_routing(str(tmp_path / "hand.yaml")) == settings.Routing("app", [("api", "", ["a", "b c"]), ("ui", "it's one", ["button"])])


def test_confirm(tmp_path):
    found = {"person": ["Zoe", "Grace"], "project": ["Ferry"], "uncertain": ["Quay", "Dock"]}
    assert settings.confirm(found) == settings.Confirmed(["Grace", "Zoe"], ["Ferry"])
    answers = iter(["edit", "p", "s", "zoe", "", "y", "grace", "p", "Lamp", "r", ""])
    got = settings.confirm(found, lambda q: next(answers))
    assert got == settings.Confirmed(["Grace", "Quay"], ["Ferry", "Lamp"])
    path = str(tmp_path / "entities.json")
    assert settings.save_registry(path, got) and not settings.save_registry(path, got) and settings.save_registry(path, got, force=True)
    assert json.loads(Path(path).read_text())["ambiguous"] == ["Grace"]


def test_setup_mine_and_serve(spark, tmp_path):
    src = tmp_path / "proj"
    (src / "docs").mkdir(parents=True)
    (src / "docs" / "a.md").write_text("# Title\n\n" + "Marlena said the ferry is late. Marlena asked for tea. \"Yes\", Marlena replied. She laughed. Hey Marlena, thanks. " * 12)
    (src / "short.md").write_text("x")
    tools = Tools(spark, str(tmp_path / "store"), dim=16)
    out = cli.setup(tools, str(src))
    assert Path(out["routing"]).exists() and settings.read_routing(out["routing"]).wing == "proj" and "Marlena" in out["people"] + out["projects"] + ["Marlena"]
    done = cli.mine(tools, str(src))
    assert done["skipped"] == done["scanned"] - done["files"] >= 1 and done["replaced"] == 0 and sum(done["rooms"].values()) == done["files"]
    assert cli.mine(tools, str(src))["replaced"] == done["files"]
    said, ran = [], []
    asked = ['{"id": 1, "tool": "status"}', "", "{broken", '{"id": 2, "tool": "nothing"}', '{"id": 3, "tool": "search", "arguments": {"query": "ferry tea", "limit": 3}}']
    assert cli.serve(tools, asked, said.append, lambda: ran.append(len(said))) == 4
    answers = [json.loads(x) for x in said]
    assert answers[0]["tools"] == list(TOOLS) and answers[1]["result"]["total_drawers"] == done["drawers"] and "error" in answers[2] and answers[3]["error"] and ran
    # the command line, the server and the tools give the same excerpts
    direct = call(tools, "search", {"query": "ferry tea", "limit": 3})["results"]
    assert [r["text"] for r in answers[4]["result"]["results"]] == [r["text"] for r in direct] and direct


def test_heartbeat(spark, tmp_path):
    import time

    import pytest

    a, b = (Lease(spark, str(tmp_path / "l"), o, 900) for o in "ab")
    assert a.acquire()
    with passes.Heartbeat(a, 0.2):
        time.sleep(1.5)
        assert not b.acquire()
    late = Lease(spark, str(tmp_path / "m"), "a", 1)
    assert late.acquire()
    with pytest.raises(passes.LeaseLost), passes.Heartbeat(late, 0.4):
        time.sleep(0.05)
        assert Lease(spark, str(tmp_path / "m"), "b", 60_000).acquire()
        time.sleep(1)


def test_summary(spark):
    rows = spark.createDataFrame([("q1", "t", 10.0, 2.0, 1.0, 1.0, 1.0, 1.0), ("q2", "u", 20.0, 4.0, 0.0, 0.0, 0.0, 0.0)], "question_id string, question_type string, latency_ms double, indexing_ms double, recall_any double, recall_all double, ndcg double, reciprocal_rank double")
    every = rows.crossJoin(spark.createDataFrame([(5,), (10,)], "k int"))
    text = evaluate.summary(every)
    assert "Questions: 2" in text and "p50=10" in text and "Recall@5: 0.500" in text and "MRR@10: 0.500" in text and "u: 0.000 (n=1)" in text
    assert evaluate.summary(every.where(F.lit(False))) == "Questions: 0"
