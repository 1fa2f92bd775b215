"""Twenty tools over a store and a fact graph; each returns plain data for JSON."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.vectors import hash_embed, hash_embed_text
from quillstone.functions.words import KINDS
from quillstone.operators import facts, rooms, search
from quillstone.sources.manifest import Manifests
from quillstone.sources.store import COLUMNS, Store, as_json

SPEC = """One header line wing|room|date|title, then entries number:ENTITIES|topics|"sentence"|moods|FLAGS.
Entities are three-letter codes joined by +, topics are joined by _, moods and flags by +. ??? and misc stand for none.
T: lines link two entries, an ARC: line gives the course of a file. The form is lossy."""
TRIPLES = "id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, source_closet string, source_file string, extracted_at timestamp"
NAMES = "id string, name string, type string, properties string"


def slug(name: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else "_" for c in name.lower()).strip("_")


class Tools:
    def __init__(self, spark: SparkSession, path: str, dim: int = 256) -> None:
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim
        self.store = Store(spark, f"{self.path}/drawers", model=f"hash-{dim}", encode=lambda body: hash_embed(body, dim), index=True)
        self._graph = Manifests(spark, f"{self.path}/facts")

    def _encode(self, text: str) -> list[float]:
        return hash_embed_text(text, self.dim)

    # --- overview ---

    def status(self) -> dict:
        d = self.store.drawers()
        return {"total_drawers": d.count(), "wings": self._counts(d, "wing"), "rooms": self._counts(d, "room"), "path": self.path, "dialect": SPEC}

    @staticmethod
    def _counts(d: DataFrame, column: str) -> dict:
        return {r[0]: r[1] for r in d.groupBy(column).count().orderBy(column).collect()}

    def list_wings(self) -> dict:
        return {"wings": self._counts(self.store.drawers(), "wing")}

    def list_rooms(self, wing: str | None = None) -> dict:
        return {"wing": wing or "all", "rooms": self._counts(search.scoped(self.store.drawers(), wing, None), "room")}

    def get_taxonomy(self) -> dict:
        out: dict = {}
        for wing, room, n in self.store.drawers().groupBy("wing", "room").count().orderBy("wing", "room").collect():
            out.setdefault(wing, {})[room] = n
        return {"taxonomy": out}

    def get_dialect_spec(self) -> dict:
        return {"dialect": SPEC}

    # --- retrieval ---

    def search(self, query: str, limit: int = 5, wing: str | None = None, room: str | None = None, min_score: float | None = None, as_of: str | None = None) -> dict:
        self.store.check_model()
        hits = search.hybrid(self.store.drawers(), search.Query(query, limit, wing, room, min_score, as_of), self._encode, self.store.inverted())
        return {"query": query, "filters": {"wing": wing, "room": room}, "results": as_json(search.shown(hits))}

    def check_duplicate(self, content: str, threshold: float = 0.9) -> dict:
        rows = search.duplicates(self.store.drawers(), content, self._encode, threshold, self.store.inverted())
        found = as_json(rows.select("id", "wing", "room", F.round("score", 3).alias("similarity"), T.excerpt(F.col("content"), 200).alias("content")))
        return {"is_duplicate": bool(found), "matches": found}

    def add_drawer(self, wing: str, room: str, content: str, source_file: str | None = None, content_kind: str = "unknown", added_by: str = "tools") -> dict:
        """Refused where the content is much like what is there."""
        kind = content_kind.strip().lower()
        if kind not in KINDS:
            raise ValueError(f"unknown kind of content: {content_kind}")
        same = self.check_duplicate(content)
        if same["is_duplicate"]:
            return {"success": False, "reason": "duplicate", "matches": same["matches"]}
        return {"success": True, "drawer_id": self._file(wing, room, content, source_file, kind, added_by, None), "wing": wing, "room": room}

    def _file(self, wing, room, content, source_file, kind, added_by, retrieval_text) -> str:
        now = dt.datetime.now(dt.timezone.utc).isoformat()
        name = "drawer_" + hashlib.sha256("\0".join((wing, room, content, now)).encode()).hexdigest()[:32]
        row = (name, content, retrieval_text, kind, room, source_file, 0, added_by, now, None, wing)
        schema = "id string, content string, retrieval_text string, content_kind string, room string, source_file string, chunk_index long, added_by string, filed_at string, embedding array<float>, wing string"
        self.store.insert(self.spark.createDataFrame([row], schema).select(*COLUMNS))
        return name

    def delete_drawer(self, drawer_id: str) -> dict:
        return {"success": self.store.delete(drawer_id), "drawer_id": drawer_id}

    def delete_wing(self, wing: str) -> dict:
        return {"wing": wing, "deleted": self.store.delete_wing(wing)}

    # --- facts ---

    def _facts(self) -> tuple[DataFrame, DataFrame]:
        m = self._graph.read()
        if not m["version"]:
            return self.spark.createDataFrame([], TRIPLES), self.spark.createDataFrame([], NAMES)
        return self.spark.read.schema(TRIPLES).parquet(f"{self.path}/facts/{m['triples']}"), self.spark.read.schema(NAMES).parquet(f"{self.path}/facts/{m['entities']}")

    def _keep(self, triples: DataFrame, entities: DataFrame) -> None:
        version = self._graph.version() + 1
        mark = hashlib.sha256(f"{version}{dt.datetime.now()}".encode()).hexdigest()[:12]
        names = {"triples": f"triples-{version}-{mark}", "entities": f"entities-{version}-{mark}"}
        triples.write.parquet(f"{self.path}/facts/{names['triples']}")
        entities.write.parquet(f"{self.path}/facts/{names['entities']}")
        self._graph.publish({"version": version, **names})

    def kg_query(self, entity: str, as_of: str | None = None, direction: str = "both") -> dict:
        rows = facts.about(*self._facts(), entity, direction if direction in ("outgoing", "incoming") else "both", as_of)
        found = as_json(rows)
        return {"entity": entity, "as_of": as_of, "facts": found, "count": len(found)}

    def kg_add(self, subject: str, predicate: str, obj: str, valid_from: str | None = None, source_closet: str | None = None) -> dict:
        triples, names = self._facts()
        new = self.spark.createDataFrame([(None, subject, predicate, obj, valid_from, None, 1.0, source_closet, None, dt.datetime.now())], TRIPLES)
        both = self.spark.createDataFrame([(facts.as_id(n), n, "unknown", "{}") for n in dict.fromkeys((subject, obj))], NAMES)
        names = names.unionByName(both.join(names.select("id"), "id", "left_anti").dropDuplicates(["id"]))
        self._keep(facts.add(triples, new), names)
        row = self._facts()[0].where((F.col("subject") == facts.as_id(subject)) & (F.col("object") == facts.as_id(obj)) & (F.col("predicate") == predicate.lower().replace(" ", "_")) & facts.current()).first()
        return {"success": True, "triple_id": row["id"], "fact": f"{subject} → {predicate} → {obj}"}

    def kg_invalidate(self, subject: str, predicate: str, obj: str, ended: str | None = None) -> dict:
        triples, names = self._facts()
        self._keep(facts.invalidate(triples, subject, predicate, obj, ended or dt.datetime.now(dt.timezone.utc).date().isoformat()), names)
        return {"success": True, "fact": f"{subject} → {predicate} → {obj}", "ended": ended or "today"}

    def kg_timeline(self, entity: str | None = None) -> dict:
        found = as_json(facts.timeline(*self._facts(), entity))
        return {"entity": entity or "all", "timeline": found, "count": len(found)}

    def kg_stats(self) -> dict:
        return facts.stats(*self._facts()).first().asDict()

    # --- diary ---

    def diary_write(self, agent: str, entry: str, topic: str = "general") -> dict:
        wing, now = f"wing_{slug(agent)}", dt.datetime.now(dt.timezone.utc)
        text = f"kind: diary\ndate: {now.date()}\nagent: {agent}\ntopic: {topic}\nverbatim:\n{entry}"
        return {"success": True, "entry_id": self._file(wing, "diary", entry, f"diary/{topic}", "diary", agent, text), "agent": agent, "topic": topic, "timestamp": now.isoformat()}

    def diary_read(self, agent: str, last_n: int = 10) -> dict:
        rows = self.store.drawers().where((F.col("wing") == f"wing_{slug(agent)}") & (F.col("room") == "diary"))
        last = rows.orderBy(F.desc_nulls_last("filed_at"), "id").limit(last_n)
        entries = as_json(last.select(F.left("filed_at", F.lit(10)).alias("date"), F.col("filed_at").alias("timestamp"), F.coalesce(T.diary_topic(F.col("source_file")), F.lit("general")).alias("topic"), "content"))
        return {"agent": agent, "entries": entries, "total": rows.count(), "showing": len(entries)}

    # --- rooms ---

    def _rooms(self) -> DataFrame:
        return rooms.nodes(self.store.drawers())

    def traverse(self, start_room: str, max_hops: int = 2) -> dict | list:
        nodes = self._rooms()
        if nodes.where(F.col("room") == start_room).isEmpty():
            return {"error": f"no room {start_room!r}", "suggestions": [r[0] for r in rooms.suggestions(nodes, start_room).collect()]}
        return as_json(rooms.traverse(nodes, start_room, max_hops).orderBy("hop", F.desc("count"), "room"))

    def find_tunnels(self, wing_a: str | None = None, wing_b: str | None = None) -> list:
        return as_json(rooms.tunnels(self._rooms(), wing_a, wing_b))

    def graph_stats(self) -> dict:
        nodes = self._rooms()
        per_wing = {r[0]: r[1] for r in rooms.per_wing(nodes).orderBy("wing").collect()}
        return {**rooms.stats(nodes).first().asDict(), "rooms_per_wing": per_wing, "top_tunnels": as_json(rooms.widest(nodes))}


TOOLS: tuple[str, ...] = (
    "status", "list_wings", "list_rooms", "get_taxonomy", "get_dialect_spec", "search", "check_duplicate", "add_drawer", "delete_drawer", "delete_wing",
    "kg_query", "kg_add", "kg_invalidate", "kg_timeline", "kg_stats", "diary_write", "diary_read", "traverse", "find_tunnels", "graph_stats",
)


def call(tools: Tools, name: str, arguments: dict) -> dict | list:
    if name not in TOOLS:
        raise ValueError(f"no tool {name!r}")
    f: Callable = getattr(tools, name)
    return f(**arguments)
