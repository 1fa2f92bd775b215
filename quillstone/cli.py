"""Command line: setup, mine, search, status, sync, compress, reembed, delete-wing, tool, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import settings
from quillstone.functions import text as T
from quillstone.operators import chunking, dialect, entities
from quillstone.plans.staging import stage
from quillstone.sources import files
from quillstone.sources.session_lines import SessionLines
from quillstone.streaming import assembly
from quillstone.tools import TOOLS, Tools, call


def mined(spark: SparkSession, folder: str, wing: str, rooms: list[tuple[str, list[str]]] | None = None, limit: int | None = None) -> DataFrame:
    """Drawers of a project: readable files, cut into chunks, with kind, room and retrieval text. Ids follow from file and position."""
    rows = files.project_files(spark, folder, limit=limit).where(F.octet_length(F.btrim("content")) >= chunking.LEAST)
    path = F.col("source_file")
    room = files.routed_room(path, F.col("content"), rooms) if rooms else T.room_of_path(path)
    rows = rows.select("source_file", "content", room.alias("room"), F.lit(wing).alias("wing"))
    rows = rows.withColumn("content_kind", T.content_kind(path, F.col("wing"), F.col("room")))
    rows = chunking.chunked(rows)
    kind, chunk = F.col("content_kind"), F.col("chunk")
    text = F.when(kind == "code", T.code_retrieval_text(path, T.language(path), F.col("enclosing"), F.col("symbol"), chunk))
    text = text.when(kind == "conversation", T.conversation_retrieval_text(path, F.col("wing"), F.col("room"), chunk))
    text = text.when(kind == "documentation", T.documentation_retrieval_text(path, F.col("content"), chunk))
    text = text.when(kind == "diary", T.diary_retrieval_text(path, F.col("room"), F.lit("miner"), F.lit(None).cast("string"), chunk)).otherwise(T.prose_retrieval_text(path, chunk))
    name = F.concat(F.lit("drawer_"), F.left(F.sha2(F.concat_ws("\0", "wing", "source_file", F.col("chunk_index_new").cast("string")), 256), F.lit(32)))
    return rows.select(
        name.alias("id"), chunk.alias("content"), text.alias("retrieval_text"), "content_kind", "room", "source_file", F.col("chunk_index_new").cast("long").alias("chunk_index"), F.lit("miner").alias("added_by"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("filed_at"), "wing"
    )


def mine(tools: Tools, folder: str, wing: str | None = None, limit: int | None = None) -> dict:
    """Replace what the store has of the folder's files; the summary counts files looked at, cut, passed over and replaced, drawers, and files by room."""
    path = files.routing_config(folder)
    routing = settings.read_routing(path) if path else None
    rows = stage(mined(tools.spark, folder, settings.project_wing(wing, routing, folder), routing.pairs() if routing else None, limit), "mined")
    sources = rows.select("source_file").distinct()
    replaced = sources.join(tools.store.drawers().select("source_file").distinct(), "source_file", "left_semi").count()
    tools.store.upsert(rows, replaced_sources=sources)
    seen = files.project_files(tools.spark, folder, limit=limit).count()
    n = rows.agg(F.countDistinct("source_file").alias("files"), F.count("*").alias("drawers")).first()
    by_room = rows.groupBy("room").agg(F.countDistinct("source_file").alias("n")).orderBy("room").collect()
    return {"files": n.files, "drawers": n.drawers, "scanned": seen, "skipped": seen - n.files, "replaced": replaced, "rooms": {r.room: r.n for r in by_room}}


def sync(tools: Tools, folder: str, adapter: str, wing: str, checkpoint: str) -> dict:
    """One pass over session logs: new lines become exchanges, exchanges drawers; the stream's checkpoint remembers what was read."""
    spark = tools.spark
    spark.dataSource.register(SessionLines)
    lines = spark.readStream.format("session_lines").option("path", folder).option("adapter", adapter).load()

    def write(batch: DataFrame, _: int) -> None:
        tools.store.upsert(assembly.as_drawers(batch, wing))

    run = assembly.exchange_stream(lines).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return {"batches": len(run.recentProgress)}


def detect(tools: Tools, folder: str, most: int = 10) -> dict[str, list[str]]:
    """Names in a project's files by kind: people, projects and uncertain ones."""
    texts = files.for_detection(files.project_files(tools.spark, folder), most)
    found = entities.detected(texts.select(F.col("source_file").alias("id"), "content"))
    out: dict[str, list[str]] = {}
    for r in found.orderBy(F.desc("confidence"), "name").collect():  # at most as many as entities.CAPS
        out.setdefault(r["kind"], []).append(r["name"])
    return out


def setup(tools: Tools, folder: str, ask: Callable[[str], str] | None = None, *, force: bool = False) -> dict:
    """Names to confirm and rooms by folders; written as ``entities.json`` and ``quillstone.yaml`` unless they are there."""
    confirmed = settings.confirm(detect(tools, folder), ask)
    saved = bool(confirmed.people or confirmed.projects) and settings.save_registry(os.path.join(folder, "entities.json"), confirmed, force=force)
    path = os.path.join(folder, "quillstone.yaml")
    rooms = files.project_files(tools.spark, folder).select(T.room_of_path(F.col("source_file")).alias("room")).distinct().orderBy("room").limit(200)
    if force or not os.path.exists(path):
        routing = settings.Routing(settings.project_wing(None, None, folder), [(r[0], f"Files of {r[0]}", [r[0]]) for r in rooms.collect()])
        with open(path, "w", encoding="utf-8") as f:
            f.write(settings.routing_text(routing))
    return {"people": confirmed.people, "projects": confirmed.projects, "saved": saved, "routing": path}


def serve(tools: Tools, lines: Iterable[str], out: Callable[[str], None], background: Callable[[], None] | None = None) -> int:
    """Answer one JSON request a line, ``{"id", "tool", "arguments"}``, over one session; returns how many.

    ``background``, such as ``passes.poll``, starts once requests are taken, and ends with the process.
    """
    out(json.dumps({"ready": True, "tools": list(TOOLS)}))
    if background:
        threading.Thread(target=background, daemon=True).start()
    n = 0
    for line in lines:
        if not line.strip():
            continue
        n += 1
        asked = None
        try:
            asked = json.loads(line)
            answer = {"id": asked.get("id"), "result": call(tools, asked["tool"], asked.get("arguments", {}))}
        except Exception as e:  # noqa: BLE001  the next request is answered
            answer = {"id": asked.get("id") if isinstance(asked, dict) else None, "error": str(e)[:500]}
        out(json.dumps(answer, ensure_ascii=False, default=str))
    return n


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillstone")
    p.add_argument("--store", default="quillstone-store")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("mine")
    a.add_argument("folder")
    a.add_argument("--wing")
    a.add_argument("--limit", type=int)
    a = sub.add_parser("setup")
    a.add_argument("folder")
    a.add_argument("--force", action="store_true")
    sub.add_parser("serve")
    a = sub.add_parser("search")
    a.add_argument("query")
    for option in ("--wing", "--room", "--as-of", "--scope"):
        a.add_argument(option)
    a.add_argument("--all-wings", action="store_true")
    a.add_argument("--limit", type=int, default=5)
    sub.add_parser("status")
    a = sub.add_parser("sync")
    a.add_argument("folder")
    a.add_argument("--adapter", default="log_a")
    a.add_argument("--wing", default="sessions")
    a = sub.add_parser("compress")
    a.add_argument("--wing")
    a.add_argument("--output")
    a = sub.add_parser("reembed")
    a.add_argument("--wing")
    a = sub.add_parser("delete-wing")
    a.add_argument("wing")
    a = sub.add_parser("tool")
    a.add_argument("name", choices=TOOLS)
    a.add_argument("arguments", nargs="?", default="{}")
    o = p.parse_args(argv)
    tools = Tools(SparkSession.builder.appName("quillstone").getOrCreate(), o.store)
    if o.command == "mine":
        out = mine(tools, o.folder, o.wing, o.limit)
    elif o.command == "setup":
        out = setup(tools, o.folder, input if sys.stdin.isatty() else None, force=o.force)
    elif o.command == "serve":
        out = {"answered": serve(tools, sys.stdin, lambda x: print(x, flush=True))}
    elif o.command == "search":
        out = tools.search(o.query, o.limit, settings.search_wing(o.wing, everywhere=o.all_wings, scope=o.scope, here=os.getcwd()), o.room, as_of=o.as_of)
    elif o.command == "sync":
        out = sync(tools, o.folder, o.adapter, o.wing, f"{tools.path}/sync-{o.adapter}")
    elif o.command == "compress":
        d = tools.store.drawers()
        rows = dialect.compressed(d if o.wing is None else d.where(F.col("wing") == o.wing))
        out = dialect.totals(rows).first().asDict()
        if o.output:
            rows.select(F.concat("dialect", F.lit("\n"))).write.text(o.output)
    elif o.command == "reembed":
        out = {"encoded": tools.store.reembed(o.wing)}
    elif o.command == "delete-wing":
        out = tools.delete_wing(o.wing)
    elif o.command == "status":
        out = tools.status()
    else:
        out = call(tools, o.name, json.loads(o.arguments))
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
