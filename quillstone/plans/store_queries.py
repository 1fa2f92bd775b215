"""Changes to a store, each published as a version of its own, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions.vectors import hash_embed
from quillstone.plans.catalogue import query
from quillstone.plans.sqltext import DRAWERS
from quillstone.plans.staging import scratch
from quillstone.plans.tables import drawers
from quillstone.sources.store import Store


def _store(spark, **options) -> Store:
    return Store(spark, scratch(spark, "store"), model="as delivered", **options)


@query(f"""WITH {DRAWERS} SELECT id, CASE WHEN wing = 'larkspur' THEN 'moved' ELSE room END AS room, wing FROM d
    UNION ALL SELECT 'new-' || id, 'moved', wing FROM d WHERE wing = 'larkspur'""")
def upsert(spark, folder):
    store, d = _store(spark), drawers(spark, folder)
    store.insert(d)
    mine = d.where("wing = 'larkspur'").withColumn("room", F.lit("moved"))
    store.upsert(mine.unionByName(mine.withColumn("id", F.concat(F.lit("new-"), "id"))))
    return store.drawers().select("id", "room", "wing")


@query(f"WITH {DRAWERS} SELECT id, source_file FROM d WHERE source_file IS DISTINCT FROM (SELECT min(source_file) FROM d)")
def delete_source(spark, folder):
    store, d = _store(spark), drawers(spark, folder)
    store.insert(d)
    store.delete_source(d.agg(F.min("source_file")).first()[0])
    return store.drawers().select("id", "source_file")


@query(f"WITH {DRAWERS} SELECT id, wing FROM d WHERE wing IS DISTINCT FROM 'larkspur' AND id <> (SELECT min(id) FROM d)")
def delete_wing(spark, folder):
    store, d = _store(spark), drawers(spark, folder)
    store.insert(d)
    store.delete(d.agg(F.min("id")).first()[0])
    store.delete_wing("larkspur")
    return store.drawers().select("id", "wing")


@query(f"WITH {DRAWERS} SELECT wing, count(*) AS n, count(*) FILTER (coalesce(trim(coalesce(retrieval_text, content)), '') <> '') > 0 AS encoded FROM d GROUP BY wing")
def reembed(spark, folder):
    store, d = _store(spark, encode=lambda body: hash_embed(body, 64)), drawers(spark, folder)
    store.insert(d)
    store.reembed()
    return store.drawers().groupBy("wing").agg(F.count("*").alias("n"), F.max(F.exists("embedding", lambda x: x != 0)).alias("encoded"))
