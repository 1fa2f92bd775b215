import pytest
from pyspark.sql import functions as F

from quillstone.cli import mine
from quillstone.functions.vectors import hash_embed
from quillstone.sources.store import DuplicateId, Lease, ModelMismatch, Store, migrated
from quillstone.tools import TOOLS, Tools, call


def rows(spark, ids, wing="w", source="f"):
    return spark.createDataFrame([(i, f"content of {i}", wing, "r", source) for i in ids], "id string, content string, wing string, room string, source_file string")


def test_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), encode=lambda x: hash_embed(x, 8))
    assert s.drawers().count() == 0
    s.insert(rows(spark, "abc"))
    before = s.drawers()
    with pytest.raises(DuplicateId):
        s.insert(rows(spark, "cd"))
    with pytest.raises(DuplicateId):
        s.insert(rows(spark, "dd"))
    assert s.drawers().count() == 3
    s.upsert(rows(spark, "cd", source="g"), replaced_sources=["f"])
    assert {r.id for r in s.drawers().collect()} == {"c", "d"} and before.count() == 3
    assert s.delete("c") and not s.delete("c") and s.delete_source("none") == 0 and s.has_source("g")
    assert s.delete_wing("w") == 1 and s.drawers().count() == 0


def test_models_and_reembedding(spark, tmp_path):
    path = str(tmp_path / "s")
    Store(spark, path, model="one", encode=lambda x: hash_embed(x, 4)).insert(rows(spark, "ab"))
    two = Store(spark, path, model="two", encode=lambda x: hash_embed(x, 8))
    with pytest.raises(ModelMismatch, match="'one'"):
        two.insert(rows(spark, "c"))
    with pytest.raises(ModelMismatch):
        two.reembed("w")
    assert two.reembed() == 2 and {len(r.embedding) for r in two.drawers().collect()} == {8}
    two.check_model()


def test_migration(spark):
    old = spark.createDataFrame([("a", "x", "w", "r", "a.py"), ("b", "x", "w", "r", None)], "id string, content string, wing string, room string, source_file string")
    assert {r.id: r.content_kind for r in migrated(old).collect()} == {"a": "code", "b": "unknown"}
    assert migrated(old.withColumn("content_kind", F.lit("Odd"))).first().content_kind == "unknown"


def test_lease(spark, tmp_path):
    a, b = (Lease(spark, str(tmp_path / "l"), o, 1000) for o in "ab")
    assert a.acquire(0) and not b.acquire(1000) and a.renew(500) and b.acquire(1501) and not a.acquire(1600)
    b.release()
    assert a.acquire(1700)


def test_tools(spark, tmp_path):
    assert len(TOOLS) == len(set(TOOLS)) == 20
    t = Tools(spark, str(tmp_path / "p"), dim=64)
    added = call(t, "add_drawer", {"wing": "w", "room": "backend", "content": "the ferry stops twice near the pier"})
    assert added["success"] and not call(t, "add_drawer", {"wing": "w", "room": "x", "content": "the ferry stops twice near the pier"})["success"]
    assert call(t, "diary_write", {"agent": "My Agent", "entry": "quiet day"})["success"]
    assert call(t, "diary_read", {"agent": "My Agent"})["entries"][0]["topic"] == "general"
    assert call(t, "status", {})["total_drawers"] == 2 and call(t, "list_wings", {})["wings"] == {"w": 1, "wing_my_agent": 1}
    assert call(t, "list_rooms", {"wing": "w"}) == {"wing": "w", "rooms": {"backend": 1}} and call(t, "get_taxonomy", {})["taxonomy"]["w"] == {"backend": 1}
    assert call(t, "search", {"query": "ferry pier", "limit": 1})["results"][0]["room"] == "backend"
    assert call(t, "kg_add", {"subject": "Alice", "predicate": "works at", "obj": "NewCo"})["triple_id"] == call(t, "kg_add", {"subject": "Alice", "predicate": "works at", "obj": "NewCo"})["triple_id"]
    assert call(t, "kg_query", {"entity": "Alice"})["count"] == 1 and call(t, "kg_timeline", {})["count"] == 1
    call(t, "kg_invalidate", {"subject": "Alice", "predicate": "works at", "obj": "NewCo", "ended": "2026-01-01"})
    assert call(t, "kg_stats", {})["expired_facts"] == 1
    assert call(t, "traverse", {"start_room": "back"})["suggestions"] == ["backend"] and call(t, "traverse", {"start_room": "diary"})[0]["hop"] == 0
    assert call(t, "find_tunnels", {}) == [] and call(t, "graph_stats", {})["total_rooms"] == 2 and "dialect" in call(t, "get_dialect_spec", {})
    assert call(t, "delete_drawer", {"drawer_id": added["drawer_id"]})["success"] and call(t, "delete_wing", {"wing": "wing_my_agent"})["deleted"] == 1
    with pytest.raises(ValueError):
        call(t, "nothing", {})


def test_mine(spark, tmp_path):
    src = tmp_path / "proj"
    (src / "docs").mkdir(parents=True)
    (src / "docs" / "a.md").write_text("# Title\n\n" + "A sentence about lanterns. " * 60)
    (src / "b.py").write_text("def run():\n    return 1  # long enough to be kept as a chunk of code\n")
    t = Tools(spark, str(tmp_path / "store"), dim=16)
    first = mine(t, str(src), "proj")
    assert first["files"] == 2 and first["replaced"] == 0 and mine(t, str(src), "proj") == first | {"replaced": 2}
    d = {r.source_file: r for r in t.store.drawers().collect()}
    assert d["b.py"].content_kind == "code" and d["docs/a.md"].room == "docs" and d["docs/a.md"].retrieval_text.startswith("kind: documentation\nsource: docs/a.md\ntitle: Title")
