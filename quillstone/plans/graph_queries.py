"""Facts and rooms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import dialect, facts, rooms
from quillstone.plans.catalogue import query
from quillstone.plans.sqltext import FACTS, ROOMS
from quillstone.plans.tables import drawers, table

WHO, DAY, PREDICATE = "drasalang", "2025-06-01", "works_on"
VALID = f"(valid_from IS NULL OR valid_from <= '{DAY}') AND (valid_to IS NULL OR valid_to >= '{DAY}')"
OUT = f"SELECT 'outgoing' AS direction, '{WHO}' AS subject, predicate, e.name AS object, valid_from, valid_to, confidence, source_closet, valid_to IS NULL AS current FROM t JOIN e ON t.object = e.id WHERE t.subject = '{WHO}'"
INTO = f"SELECT 'incoming' AS direction, e.name AS subject, predicate, '{WHO}' AS object, valid_from, valid_to, confidence, source_closet, valid_to IS NULL AS current FROM t JOIN e ON t.subject = e.id WHERE t.object = '{WHO}'"


def _facts(spark, folder):
    raw = table(spark, folder, "triples")
    return facts.normalised(raw), facts.entities_of(raw)


@query(f"WITH {FACTS} SELECT * FROM e")
def entities(spark, folder):
    return _facts(spark, folder)[1]


@query(f"WITH {FACTS} {OUT}")
def facts_outgoing(spark, folder):
    return facts.about(*_facts(spark, folder), WHO, "outgoing")


@query(f"WITH {FACTS} {INTO}")
def facts_incoming(spark, folder):
    return facts.about(*_facts(spark, folder), WHO, "incoming")


@query(f"WITH {FACTS} {OUT} UNION ALL {INTO}")
def facts_both(spark, folder):
    return facts.about(*_facts(spark, folder), WHO)


@query(f"WITH {FACTS} {OUT} AND {VALID} UNION ALL {INTO} AND {VALID}")
def facts_as_of(spark, folder):
    return facts.about(*_facts(spark, folder), WHO, as_of=DAY)


NAMED = "SELECT s.name AS subject, predicate, o.name AS object, valid_from, valid_to, valid_to IS NULL AS current FROM t JOIN e s ON t.subject = s.id JOIN e o ON t.object = o.id"


@query(f"WITH {FACTS} {NAMED} WHERE predicate = '{PREDICATE}' AND {VALID}")
def facts_relationship(spark, folder):
    return facts.relationship(*_facts(spark, folder), PREDICATE, DAY)


@query(f"WITH {FACTS} {NAMED} ORDER BY valid_from NULLS LAST, predicate, s.name, o.name, t.id LIMIT 100")
def facts_timeline(spark, folder):
    return facts.timeline(*_facts(spark, folder))


@query(f"WITH {FACTS} {NAMED} WHERE t.subject = '{WHO}' OR t.object = '{WHO}' ORDER BY valid_from NULLS LAST, predicate, s.name, o.name, t.id LIMIT 100")
def facts_timeline_of(spark, folder):
    return facts.timeline(*_facts(spark, folder), WHO)


@query(f"""WITH {FACTS} SELECT count(*) AS triples, count(*) FILTER (valid_to IS NULL) AS current_facts, count(*) FILTER (valid_to IS NOT NULL) AS expired_facts,
    array_to_string(list_sort(list(DISTINCT predicate)), ',') AS relationship_types, (SELECT count(*) FROM e) AS entities FROM t""")
def facts_stats(spark, folder):
    return facts.stats(*_facts(spark, folder)).withColumn("relationship_types", F.array_join("relationship_types", ","))


@query(f"""WITH {FACTS}, n AS (SELECT subject, 'knows' AS predicate, object, extracted_at, id FROM t WHERE predicate = 'reviews'
        UNION ALL SELECT subject, predicate, object, extracted_at, id FROM t WHERE predicate = 'likes'),
    one AS (SELECT DISTINCT subject, predicate, object FROM n)
    SELECT predicate, count(*) AS n FROM (SELECT predicate FROM t UNION ALL SELECT predicate FROM one WHERE NOT EXISTS (
        SELECT 1 FROM t WHERE t.valid_to IS NULL AND t.subject = one.subject AND t.predicate = one.predicate AND t.object = one.object)) GROUP BY ALL""")
def facts_add_dedupe(spark, folder):
    t, _ = _facts(spark, folder)
    new = t.where("predicate = 'reviews'").withColumn("predicate", F.lit("Knows")).unionByName(t.where("predicate = 'likes'"))
    new = new.withColumns({"valid_to": F.lit(None).cast("string"), "id": F.lit(None).cast("string")})
    return facts.add(t, new).groupBy("predicate").agg(F.count("*").alias("n"))


@query(f"""WITH {FACTS}, f AS (SELECT subject, predicate, object FROM t WHERE valid_to IS NULL ORDER BY subject, predicate, object LIMIT 1)
    SELECT id, subject, predicate, object, CASE WHEN valid_to IS NULL AND (subject, predicate, object) = (SELECT (subject, predicate, object) FROM f) THEN '2026-01-01' ELSE valid_to END AS valid_to FROM t""")
def facts_invalidate(spark, folder):
    t, _ = _facts(spark, folder)
    s, p, o = t.where(facts.current()).orderBy("subject", "predicate", "object").select("subject", "predicate", "object").first()
    return facts.invalidate(t, s, p, o, "2026-01-01").select("id", "subject", "predicate", "object", "valid_to")


def _rooms(spark, folder):
    return rooms.nodes(drawers(spark, folder))


def _flat(rows):
    """Lists as text: a comparison of values reads them alike everywhere."""
    return rows.withColumns({c: F.array_join(c, ",") for c in ("wings", "dates", "connected_via") if c in rows.columns})


WINGS = "array_to_string(wings, ',') AS wings"


@query(f"WITH {ROOMS} SELECT room, {WINGS}, array_to_string(coalesce(dates, []), ',') AS dates, count FROM rooms")
def room_nodes(spark, folder):
    return _flat(_rooms(spark, folder))


@query(f"WITH {ROOMS} SELECT coalesce(sum(len(wings) * (len(wings) - 1) // 2), 0)::BIGINT AS total_edges FROM rooms")
def room_edges(spark, folder):
    return rooms.edge_count(_rooms(spark, folder))


@query(f"WITH {ROOMS} SELECT wing, count(*) AS rooms FROM (SELECT unnest(wings) AS wing FROM rooms) GROUP BY ALL")
def rooms_per_wing(spark, folder):
    return rooms.per_wing(_rooms(spark, folder))


@query(f"WITH {ROOMS} SELECT count(*) AS total_rooms, count(*) FILTER (len(wings) >= 2) AS tunnel_rooms, coalesce(sum(len(wings) * (len(wings) - 1) // 2), 0)::BIGINT AS total_edges FROM rooms")
def graph_stats(spark, folder):
    return rooms.stats(_rooms(spark, folder))


@query(f"WITH {ROOMS} SELECT room, {WINGS}, count, coalesce(list_max(dates), '') AS recent FROM rooms WHERE len(wings) >= 2 AND list_contains(wings, 'larkspur') ORDER BY count DESC, room LIMIT 50")
def tunnels(spark, folder):
    return _flat(rooms.tunnels(_rooms(spark, folder), "larkspur"))


@query(f"WITH {ROOMS} SELECT room, {WINGS}, count FROM rooms WHERE len(wings) >= 2 ORDER BY len(rooms.wings) DESC, room LIMIT 10")
def top_tunnels(spark, folder):
    return _flat(rooms.widest(_rooms(spark, folder)))


@query(f"""WITH RECURSIVE {ROOMS}, pairs AS (SELECT DISTINCT a.room AS x, b.room AS y FROM (SELECT room, unnest(wings) AS w FROM rooms) a JOIN (SELECT room, unnest(wings) AS w FROM rooms) b USING (w)),
    walk AS (SELECT 'backend' AS room, 0 AS hop UNION SELECT y, hop + 1 FROM walk JOIN pairs ON walk.room = pairs.x WHERE hop < 2)
    SELECT room, {WINGS}, count, min(hop) AS hop FROM walk JOIN rooms USING (room) GROUP BY ALL""")
def traverse(spark, folder):
    return _flat(rooms.traverse(_rooms(spark, folder), "backend", 2).drop("connected_via"))


@query(f"""WITH {ROOMS}, seats AS (SELECT room, unnest(wings) AS wing FROM rooms),
    f1 AS (SELECT DISTINCT room, 'backend' AS parent FROM seats WHERE wing IN (SELECT wing FROM seats WHERE room = 'backend') AND room <> 'backend'),
    led AS (SELECT wing, min(room) AS lead FROM seats WHERE room IN (SELECT room FROM f1) GROUP BY wing),
    f2 AS (SELECT room, min(lead) AS parent FROM seats JOIN led USING (wing) WHERE room <> 'backend' AND room NOT IN (SELECT room FROM f1) GROUP BY room),
    walk AS (SELECT 'backend' AS room, 0 AS hop, NULL AS parent UNION ALL SELECT room, 1, parent FROM f1 UNION ALL SELECT room, 2, parent FROM f2)
    SELECT r.room AS room, array_to_string(r.wings, ',') AS wings, r.count AS count, hop, CASE WHEN hop > 0 THEN array_to_string(list_filter(r.wings, lambda x: list_contains(p.wings, x)), ',') END AS connected_via
    FROM walk JOIN rooms r ON r.room = walk.room LEFT JOIN rooms p ON p.room = walk.parent""")
def traverse_connected(spark, folder):
    return _flat(rooms.traverse(_rooms(spark, folder), "backend", 2))


@query(f"WITH {ROOMS} SELECT room, CASE WHEN contains(room, 'end') THEN 1.0 END AS match FROM rooms WHERE contains(room, 'end') ORDER BY room LIMIT 5")
def fuzzy_rooms(spark, folder):
    return rooms.suggestions(_rooms(spark, folder), "end")


@query(f"WITH {FACTS} SELECT id, name, 'unknown' AS type, '{{}}' AS properties FROM e WHERE id <> '{WHO}' UNION ALL SELECT '{WHO}', '{WHO.title()}', 'project', '{{\"seen\": 1}}'")
def entity_replaced(spark, folder):
    known = _facts(spark, folder)[1].select("id", "name", F.lit("unknown").alias("type"), F.lit("{}").alias("properties"))
    return facts.add_entity(known, WHO.title(), "project", '{"seen": 1}')


@query("SELECT DISTINCT name, nullif(upper(left(regexp_replace(name, '[^A-Za-z]', '', 'g'), 3)), '') AS code FROM (SELECT subject AS name FROM triples UNION ALL SELECT object FROM triples) WHERE name IS NOT NULL")
def entity_name_codes(spark, folder):
    return _facts_names(spark, folder).select("name", dialect.entity_code(F.col("name")).alias("code"))


def _facts_names(spark, folder):
    raw = table(spark, folder, "triples")
    return raw.select(F.col("subject").alias("name")).unionByName(raw.select(F.col("object").alias("name"))).where("name is not null").distinct()


@query("SELECT DISTINCT id, confidence, regexp_replace(regexp_replace(printf('%.3f', confidence), '0+$', ''), '\\.$', '') AS weight FROM triples WHERE confidence IS NOT NULL AND id IS NOT NULL")
def weight_texts(spark, folder):
    return table(spark, folder, "triples").where("confidence is not null and id is not null").select("id", "confidence", dialect.weight_texts(F.col("confidence")).alias("weight")).distinct()
