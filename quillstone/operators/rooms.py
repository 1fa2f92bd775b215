"""Graph of rooms: two rooms are neighbours when they have a wing in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import short_date
from quillstone.plans.staging import stage


def nodes(drawers: DataFrame) -> DataFrame:
    """``room, wings, dates, count``: rooms with their sorted wings and days. Empty rooms, nulls and ``general`` are none."""
    rows = drawers.where((F.col("room") != "") & (F.col("room") != "general"))
    return rows.groupBy("room").agg(F.array_sort(F.collect_set("wing")).alias("wings"), F.array_sort(F.collect_set(short_date(F.col("filed_at")))).alias("dates"), F.count("*").alias("count"))


def edge_count(rooms: DataFrame) -> DataFrame:
    """One row: how many pairs of wings meet in rooms."""
    n = F.size("wings")
    return rooms.agg(F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0)).alias("total_edges"))


def per_wing(rooms: DataFrame) -> DataFrame:
    return rooms.select(F.explode("wings").alias("wing")).groupBy("wing").agg(F.count("*").alias("rooms"))


def stats(rooms: DataFrame) -> DataFrame:
    """One row: rooms, rooms of two wings or more, edges."""
    n = F.size("wings")
    return rooms.agg(F.count("*").alias("total_rooms"), F.count_if(n >= 2).alias("tunnel_rooms"), F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0)).alias("total_edges"))


def tunnels(rooms: DataFrame, wing_a: str | None = None, wing_b: str | None = None, limit: int = 50) -> DataFrame:
    """Rooms of two wings or more, with either or both of the given wings, the fullest first."""
    rows = rooms.where(F.size("wings") >= 2)
    for wing in (wing_a, wing_b):
        if wing is not None:
            rows = rows.where(F.array_contains("wings", wing))
    recent = F.coalesce(F.array_max("dates"), F.lit(""))
    return rows.select("room", "wings", "count", recent.alias("recent")).orderBy(F.desc("count"), "room").limit(limit)


def widest(rooms: DataFrame, limit: int = 10) -> DataFrame:
    return rooms.where(F.size("wings") >= 2).select("room", "wings", "count").orderBy(F.desc(F.size("wings")), "room").limit(limit)


def suggestions(rooms: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """``room, match``: rooms that contain the query (1.0) or one of its parts between hyphens (0.5)."""
    q = query.lower()
    part = F.lit(False)
    for p in q.split("-"):
        if p:
            part = part | F.contains("room", F.lit(p))
    score = F.when(F.contains("room", F.lit(q)), 1.0).when(part, 0.5)
    return rooms.select("room", score.alias("match")).where("match is not null").orderBy(F.desc("match"), "room").limit(limit)


def traverse(rooms: DataFrame, start: str, max_hops: int = 2) -> DataFrame:
    """``room, wings, count, hop, connected_via``: rooms within ``max_hops`` of one, breadth first.

    ``connected_via`` holds the wings shared with the first room, in order of discovery, that leads there; it is null
    for the start. An unknown start gives no rows. Each hop joins the frontier's wings, of which every one is
    followed once: rooms are reached through their wings, never compared with each other. Hops are staged tables.
    """
    seats = rooms.select("room", F.explode("wings").alias("wing"))
    reached = stage(rooms.where(F.col("room") == start).select("room", F.lit(0).alias("hop"), F.lit("").alias("order"), F.lit(None).cast("string").alias("parent")), "hop")
    frontier = reached
    for hop in range(1, max_hops + 1):
        lead = frontier.join(seats, "room").groupBy("wing").agg(F.min(F.struct("order", "room")).alias("lead"))
        found = seats.join(lead, "wing").groupBy("room").agg(F.min("lead").alias("lead"))
        found = found.join(reached.select("room"), "room", "left_anti")
        # rooms found by one parent follow each other by name, parents by their own order
        frontier = stage(found.select("room", F.lit(hop).alias("hop"), F.concat("lead.order", F.lit("\0"), "room").alias("order"), F.col("lead.room").alias("parent")), "hop")
        reached = reached.unionByName(frontier)
        if frontier.isEmpty():
            break
    parents = rooms.select(F.col("room").alias("parent"), F.col("wings").alias("_w"))
    rows = reached.join(rooms, "room").join(parents, "parent", "left")
    return rows.select("room", "wings", "count", "hop", F.when(F.col("hop") > 0, F.array_intersect("wings", "_w")).alias("connected_via"))
