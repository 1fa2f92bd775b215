from pyspark.sql import functions as F

from quillstone.operators import facts, rooms

SEED = [("Alice", "parent_of", "Max", "2015-04-01", None), ("Max", "does", "swimming", "2025-01-01", None), ("Max", "does", "chess", "2024-06-01", None), ("Alice", "works at", "Acme Corp", "2020-01-01", "2024-12-31"), ("Alice", "works_at", "NewCo", "2025-01-01", None)]


def seeded(spark, rows=SEED):
    schema = "id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, source_closet string, source_file string, extracted_at timestamp"
    raw = spark.createDataFrame([(f"t{i}", *r, 1.0, None, None, None) for i, r in enumerate(rows)], schema)
    return facts.normalised(raw), facts.entities_of(raw)


def test_as_of_and_names(spark):
    t, e = seeded(spark)
    got = facts.about(t, e, "Alice", "outgoing", "2025-06-01").where("predicate = 'works_at'").collect()
    assert [(r.subject, r.object) for r in got] == [("Alice", "NewCo")]
    on_the_edge = facts.about(t, e, "Alice", "outgoing", "2024-12-31").where("predicate = 'works_at'").collect()
    assert [r.object for r in on_the_edge] == ["Acme Corp"]
    assert {(r.direction, r.subject) for r in facts.about(t, e, "MAX").collect()} == {("outgoing", "MAX"), ("incoming", "Alice")}
    assert facts.about(t, e, "Max", "sideways").count() == 0
    assert facts.as_id("Dr. Chen's") == "dr._chens"


def test_invalidate_add_and_timeline(spark):
    t, e = seeded(spark)
    chess = facts.invalidate(t, "Max", "does", "chess", "2026-01-01").where("object = 'chess'").first()
    assert chess.valid_to == "2026-01-01"
    new = t.where("predicate = 'does'").withColumn("id", F.lit(None).cast("string"))
    assert facts.add(t, new.unionByName(new)).count() == 5
    moved = facts.add(t, new.withColumn("object", F.lit("Judo")))
    assert moved.count() == 6 and facts.add(facts.invalidate(t, "Max", "does", "chess", "2026-01-01"), new).count() == 6
    many, names = seeded(spark, [("A", "p", f"B{i:03d}", None if i % 2 else f"2020-{i % 12 + 1:02d}", None) for i in range(105)])
    order = facts.timeline(many, names).collect()
    assert len(order) == 100 and order[0].valid_from == "2020-01" and order[-1].valid_from is None
    assert facts.stats(t, e).first().asDict() == {"triples": 5, "current_facts": 4, "expired_facts": 1, "relationship_types": ["does", "parent_of", "works_at"], "entities": 6}


def nodes(spark, rows):
    return rooms.nodes(spark.createDataFrame(rows, "room string, wing string, filed_at string"))


def test_rooms(spark):
    n = nodes(spark, [("a", "w1", "2026-01-01T1"), ("a", "w2", None), ("b", "w2", "x"), ("c", "w3", None), ("d", "w3", None), ("d", "w2", None), ("general", "w1", None), ("", "w1", None), (None, "w1", None)])
    assert {r.room: (r.wings, r.dates, r["count"]) for r in n.collect()}["a"] == (["w1", "w2"], ["2026-01-01"], 2)
    assert rooms.edge_count(n).first()[0] == 2
    walked = {r.room: (r.hop, r.connected_via) for r in rooms.traverse(n, "a", 2).collect()}
    assert walked == {"a": (0, None), "b": (1, ["w2"]), "d": (1, ["w2"]), "c": (2, ["w3"])}
    assert rooms.traverse(n, "zzz").count() == 0
    assert [r.room for r in rooms.tunnels(n, "w2").collect()] == ["a", "d"] and [r.room for r in rooms.tunnels(n, "w1", "w3").collect()] == []
    assert [(r.room, r.match) for r in rooms.suggestions(n, "a-q").collect()] == [("a", 0.5)]


def test_nearest_parent_decides_the_way(spark):
    n = nodes(spark, [("s", "w1", None), ("s", "w2", None), ("m", "w1", None), ("m", "x", None), ("k", "w2", None), ("k", "x", None), ("k", "y", None), ("z", "x", None), ("z", "y", None)])
    walked = {r.room: (r.hop, r.connected_via) for r in rooms.traverse(n, "s", 3).collect()}
    assert walked["z"] == (2, ["x", "y"])  # k comes before m
