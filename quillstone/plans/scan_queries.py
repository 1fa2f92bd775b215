"""Scans, filters and aggregates over drawers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.plans.catalogue import query
from quillstone.plans.sqltext import DRAWERS, excerpt, kind, memory_date
from quillstone.plans.tables import drawers, table

WING = "larkspur"


@query(f"WITH {DRAWERS} SELECT id, content, content_kind, wing, room, source_file, chunk_index FROM d WHERE wing = '{WING}'")
def scan_wing(spark, folder):
    return drawers(spark, folder, F.col("wing") == WING).select("id", "content", "content_kind", "wing", "room", "source_file", "chunk_index")


@query(f"WITH {DRAWERS} SELECT id, content, wing, room FROM d WHERE id = (SELECT min(id) FROM drawers)")
def point_lookup(spark, folder):
    first = table(spark, folder, "drawers").agg(F.min("id")).first()[0]
    return drawers(spark, folder, F.col("id") == first).select("id", "content", "wing", "room").limit(1)


@query("SELECT DISTINCT source_file FROM drawers WHERE source_file IS NOT NULL")
def distinct_sources(spark, folder):
    return table(spark, folder, "drawers").select("source_file").where("source_file is not null").distinct()


@query("SELECT count(*) > 0 AS found FROM drawers WHERE source_file = (SELECT max(source_file) FROM drawers)")
def has_source(spark, folder):
    rows = table(spark, folder, "drawers")
    last = rows.agg(F.max("source_file")).first()[0]
    return rows.where(F.col("source_file") == last).limit(1).agg((F.count("*") > 0).alias("found"))


@query("SELECT count(DISTINCT id) AS total_drawers FROM drawers")
def status_counts(spark, folder):
    return table(spark, folder, "drawers").agg(F.countDistinct("id").alias("total_drawers"))


@query(f"WITH {DRAWERS} SELECT wing, room, count(*) AS n FROM d GROUP BY ALL")
def room_counts(spark, folder):
    return drawers(spark, folder).groupBy("wing", "room").agg(F.count("*").alias("n"))


@query(f"WITH {DRAWERS} SELECT wing, count(*) AS n FROM d GROUP BY ALL")
def wing_totals(spark, folder):
    return room_counts(spark, folder).groupBy("wing").agg(F.sum("n").alias("n"))


@query(f"WITH {DRAWERS} SELECT 'all' AS wing, room, count(*) AS n FROM d GROUP BY ALL")
def room_totals(spark, folder):
    return room_counts(spark, folder).groupBy("room").agg(F.sum("n").alias("n")).select(F.lit("all").alias("wing"), "room", "n")


@query(f"WITH {DRAWERS} SELECT wing, string_agg(room || '=' || n, ',' ORDER BY room) AS rooms FROM (SELECT wing, room, count(*) AS n FROM d GROUP BY ALL) GROUP BY wing")
def taxonomy(spark, folder):
    rows = room_counts(spark, folder).where("room is not null").groupBy("wing").agg(F.array_sort(F.collect_list(F.struct("room", "n"))).alias("r"))
    return rows.select("wing", F.array_join(F.transform("r", lambda x: F.concat(x["room"], F.lit("="), x["n"].cast("string"))), ",").alias("rooms"))


@query(f"WITH {DRAWERS} SELECT wing, room, count(*) AS n, grouping(wing, room) AS level FROM d GROUP BY GROUPING SETS ((wing), (room), ())")
def status_rollup(spark, folder):
    rows = drawers(spark, folder).groupingSets([["wing"], ["room"], []], "wing", "room")
    return rows.agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query(f"WITH {DRAWERS} SELECT wing, room, count(*) AS n FROM d GROUP BY ALL ORDER BY wing DESC, room")
def migration_distribution(spark, folder):
    return room_counts(spark, folder).orderBy(F.desc("wing"), "room")


@query(f"WITH {DRAWERS} SELECT id, {kind('source_file', 'wing', 'room', 'unknown')} AS kind, {kind('source_file', 'wing', 'room', 'prose')} AS mined_kind FROM d")
def kind_inference(spark, folder):
    args = (F.col("source_file"), F.col("wing"), F.col("room"))
    return drawers(spark, folder).select("id", T.content_kind(*args, missing="unknown").alias("kind"), T.content_kind(*args).alias("mined_kind"))


@query(f"WITH {DRAWERS} SELECT id, trim(regexp_replace(lower(coalesce(source_file, room)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM d")
def slug_hyphen(spark, folder):
    return drawers(spark, folder).select("id", T.slug_hyphen(F.coalesce("source_file", "room")).alias("slug"))


@query(f"WITH {DRAWERS} SELECT id, trim(regexp_replace(lower(coalesce(source_file, room)), '[^a-z0-9]', '_', 'g'), '_') AS slug FROM d")
def slug_underscore(spark, folder):
    return drawers(spark, folder).select("id", T.slug_underscore(F.coalesce("source_file", "room")).alias("slug"))


@query(f"""WITH {DRAWERS} SELECT id, array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(content,
    '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda t: t <> ''), ' ') AS words FROM d WHERE content_kind = 'code'""")
def identifier_split(spark, folder):
    return drawers(spark, folder, F.col("content_kind") == "code").select("id", F.array_join(T.split_identifier(F.col("content")), " ").alias("words"))


@query(f"WITH {DRAWERS} SELECT id, {excerpt('content', 80)} AS excerpt FROM d")
def excerpts(spark, folder):
    return drawers(spark, folder).select("id", T.excerpt(F.col("content"), 80).alias("excerpt"))


@query(f"WITH {DRAWERS} SELECT id, strftime({memory_date('filed_at')}, '%Y-%m-%d') AS day, left(filed_at, 10) AS short_date FROM d")
def date_parse(spark, folder):
    return drawers(spark, folder).select("id", T.memory_date(F.col("filed_at")).cast("string").alias("day"), T.short_date(F.col("filed_at")).alias("short_date"))


@query(f"""WITH {DRAWERS}, n AS (SELECT *, count(*) OVER () AS total FROM d WHERE room = 'diary')
    SELECT left(filed_at, 10) AS date, filed_at AS timestamp, coalesce(regexp_replace(source_file, '^diary/', ''), 'general') AS topic, content, total FROM n ORDER BY filed_at DESC NULLS LAST, id LIMIT 10""")
def diary_latest(spark, folder):
    rows = drawers(spark, folder, F.col("room") == "diary")
    total = rows.agg(F.count("*").alias("total"))
    last = rows.orderBy(F.desc_nulls_last("filed_at"), "id").limit(10)
    return last.crossJoin(F.broadcast(total)).select(T.short_date(F.col("filed_at")).alias("date"), F.col("filed_at").alias("timestamp"), F.coalesce(T.diary_topic(F.col("source_file")), F.lit("general")).alias("topic"), "content", "total")


@query(f"WITH {DRAWERS} SELECT id, content FROM d WHERE id > (SELECT min(id) FROM drawers) ORDER BY id LIMIT 256")
def keyset_page(spark, folder):
    first = table(spark, folder, "drawers").agg(F.min("id")).first()[0]
    return drawers(spark, folder, F.col("id") > first).select("id", "content").orderBy("id").limit(256)


@query(f"""WITH {DRAWERS} SELECT id, max(value) FILTER (key = 'document') AS document, max(value) FILTER (key = 'wing') AS wing, max(value) FILTER (key = 'chunk') AS chunk
    FROM (SELECT id, unnest(['document', 'wing', 'chunk']) AS key, unnest([content, wing, chunk_index::VARCHAR]) AS value FROM d) GROUP BY id""")
def eav_pivot(spark, folder):
    from quillstone.sources.legacy import pivoted

    d = drawers(spark, folder)
    rows = d.select("id", F.explode(F.create_map(F.lit("document"), F.struct(F.col("content").alias("s"), F.lit(None).cast("long").alias("i")), F.lit("wing"), F.struct(F.col("wing").alias("s"), F.lit(None).cast("long").alias("i")), F.lit("chunk"), F.struct(F.lit(None).cast("string").alias("s"), F.col("chunk_index").alias("i")))))
    metadata = rows.select("id", "key", F.col("value.s").alias("string_value"), F.col("value.i").alias("int_value"), F.lit(None).cast("double").alias("float_value"), F.lit(None).cast("boolean").alias("bool_value"))
    return pivoted(metadata, ["document", "wing", "chunk"])
