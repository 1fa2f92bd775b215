"""Drawers in versions of parquet folders: every change is a new version, published whole or not at all.

A version is a list of parts and a list of deletes. A part is a data folder, sorted by
wing, and with ``index`` a folder of postings, sorted by term. A delete is a folder of ids
that are gone from the parts before it. Inserts add a part, deletes a delete, upserts one
of each: what a change writes follows the change, not the store. Readers anti-join the
deletes; ``compact`` makes one part of all, by itself after ``MOST_PARTS``. Readers of a
version are never disturbed by later ones.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import index
from quillstone.sources.manifest import Conflict, Manifests

SCHEMA = "id string, content string, retrieval_text string, content_kind string, room string, source_file string, chunk_index long, added_by string, filed_at string, embedding array<float>, wing string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
STORED, GONE = f"{SCHEMA}, words int", "id string, upto int"
MOST_PARTS = 32


class DuplicateId(ValueError):
    pass


class ModelMismatch(ValueError):
    pass


def migrated(drawers: DataFrame) -> DataFrame:
    """Drawers of an older layout with the columns of this one: what is missing is null, and a missing kind is inferred."""
    for name in COLUMNS:
        if name not in drawers.columns:
            kind = SCHEMA.split(f"{name} ")[1].split(", ")[0]
            drawers = drawers.withColumn(name, F.lit(None).cast(kind))
    guess = T.content_kind(F.col("source_file"), F.col("wing"), F.col("room"), missing="unknown")
    return drawers.select(*COLUMNS).withColumn("content_kind", F.when(F.col("content_kind").isNull(), guess).otherwise(T.known_kind(F.col("content_kind"))))


class Store:
    def __init__(self, spark: SparkSession, path: str, *, model: str = "hash", encode: Callable[[Column], Column] | None = None, index: bool = False) -> None:
        self.spark, self.path, self.model, self.encode, self.index = spark, path.rstrip("/"), model, encode, index
        self._manifests = Manifests(spark, path)

    def manifest(self, version: int | None = None) -> dict:
        return {"parts": [], "deletes": [], "meta": {}, "sync_state": None} | self._manifests.read(version)

    def _alive(self, manifest: dict, kind: str, schema: str) -> DataFrame:
        """The rows of all parts' folders of a kind that no later delete names."""
        names = [p["name"] for p in manifest["parts"]]
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}-{n}" for n in names])
        if not manifest["deletes"]:
            return rows
        place = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])[F.regexp_extract("_metadata.file_path", rf"/{kind}-([0-9a-f]+)/", 1)]
        gone = self.spark.read.schema(GONE).parquet(*[f"{self.path}/gone-{n['name']}" for n in manifest["deletes"]])
        rows, gone = rows.withColumn("_part", place).alias("r"), gone.alias("g")
        return rows.join(gone, (F.col("r.id") == F.col("g.id")) & (F.col("r._part") < F.col("g.upto")), "left_anti").drop("_part")

    def _stored(self, manifest: dict) -> DataFrame:
        return self._alive(manifest, "data", STORED) if manifest["parts"] else self.spark.createDataFrame([], STORED)

    def drawers(self, version: int | None = None) -> DataFrame:
        return self._stored(self.manifest(version)).select(*COLUMNS)

    def inverted(self, version: int | None = None) -> index.Index | None:
        """The inverted index of a version; none for a store without."""
        m = self.manifest(version)
        if not m["parts"] or not all(p["indexed"] for p in m["parts"]):
            return None
        rows = sum(p["rows"] for p in m["parts"]) - sum(d["rows"] for d in m["deletes"])
        words = sum(p["words"] for p in m["parts"]) - sum(d["words"] for d in m["deletes"])
        return index.Index(self._alive(m, "post", index.SCHEMA), rows, words)

    def check_model(self, manifest: dict | None = None) -> None:
        """Refuse to mix vectors of different encoders."""
        stored = (manifest or self.manifest())["meta"].get("model")
        if stored not in (None, self.model):
            raise ModelMismatch(f"the store holds vectors of {stored!r}, not of {self.model!r}; re-embed it first")

    def _encoded(self, rows: DataFrame) -> DataFrame:
        if self.encode is None:
            return rows
        body = T.embedding_input(F.col("content"), F.col("retrieval_text"), F.col("source_file"), F.col("content_kind"))
        return rows.withColumn("embedding", self.encode(body))

    def _read(self, part: dict) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(f"{self.path}/data-{part['name']}")

    def _write(self, rows: DataFrame) -> dict:
        """A new part of the rows; nobody reads it yet."""
        name = uuid.uuid4().hex
        words = F.size(T.lexical_words(F.coalesce("content", F.lit("")))) if self.index else F.lit(0)
        # wings are kept together and sorted, so that a scan of one skips the row groups of others; large ones are split
        rows.select(*COLUMNS, words.alias("words")).hint("rebalance", "wing").sortWithinPartitions("wing", "room", "id").write.parquet(f"{self.path}/data-{name}")
        part = {"name": name, "indexed": self.index}
        if self.index:
            index.write(self._read(part), f"{self.path}/post-{name}")
        n = self._read(part).agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
        return {**part, "rows": n[0], "words": n[1]}

    def _gone(self, old: dict, dead: DataFrame) -> dict:
        """A delete of stored rows, from all parts of the old version."""
        name = uuid.uuid4().hex
        dead.select("id", "words").write.parquet(f"{self.path}/gone-{name}.tmp")
        ids = self.spark.read.schema("id string, words int").parquet(f"{self.path}/gone-{name}.tmp")
        ids.select("id", F.lit(len(old["parts"])).alias("upto")).write.parquet(f"{self.path}/gone-{name}")
        n = ids.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
        self._manifests.remove(f"gone-{name}.tmp")
        return {"name": name, "rows": n[0], "words": n[1]}

    def _publish(self, old: dict, parts: list[dict], deletes: list[dict], **more) -> int:
        meta = {**old["meta"], "model": self.model}
        return self._manifests.publish({**old, "version": old["version"] + 1, "parts": parts, "deletes": deletes, "meta": meta, **more})

    def insert(self, rows: DataFrame) -> int:
        """Add drawers; an id that is repeated or there already refuses all of them."""
        old = self.manifest()
        self.check_model(old)
        part = self._write(self._encoded(migrated(rows)))
        new = self._read(part).select("id")
        twice = new.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
        if old["parts"]:
            twice = twice.unionByName(new.join(self._stored(old).select("id"), "id", "left_semi").select("id"))
        if clash := twice.limit(3).collect():
            raise DuplicateId(", ".join(r[0] for r in clash))
        return self._publish(old, [*old["parts"], part], old["deletes"])

    def upsert(self, rows: DataFrame, *, replaced_sources: DataFrame | list[str] | None = None, sync_state: DataFrame | None = None) -> int:
        """Put drawers in the place of those with their ids, drop what else the given sources had, and publish checkpoints with them.

        ``replaced_sources`` is a table of ``source_file``, or a short list.
        """
        old = self.manifest()
        self.check_model(old)
        part = self._write(self._encoded(migrated(rows).dropDuplicates(["id"])))
        deletes = old["deletes"]
        if old["parts"]:
            stored = self._stored(old).select("id", "source_file", "words")
            hit = self._read(part).select("id").withColumn("_same", F.lit(True))
            dead = stored.join(hit, "id", "left")
            if replaced_sources is not None:
                names = replaced_sources if isinstance(replaced_sources, DataFrame) else self.spark.createDataFrame([(x,) for x in replaced_sources], "source_file string")
                dead = dead.join(names.select("source_file").distinct().withColumn("_named", F.lit(True)), "source_file", "left")
            else:
                dead = dead.withColumn("_named", F.lit(None).cast("boolean"))
            gone = self._gone(old, dead.where("_same or _named"))
            if gone["rows"]:
                deletes = [*deletes, gone]
            else:
                self._manifests.remove(f"gone-{gone['name']}")
        more = {}
        if sync_state is not None:
            more["sync_state"] = f"state-{uuid.uuid4().hex}"
            sync_state.write.parquet(f"{self.path}/{more['sync_state']}")
        version = self._publish(old, [*old["parts"], part], deletes, **more)
        return self.compact() if len(old["parts"]) + 1 > MOST_PARTS else version

    def compact(self) -> int:
        """One part of all current rows; no deletes."""
        old = self.manifest()
        return self._publish(old, [self._write(self._stored(old).select(*COLUMNS))], [])

    def sync_state(self) -> DataFrame | None:
        name = self.manifest()["sync_state"]
        return self.spark.read.parquet(f"{self.path}/{name}") if name else None

    def _delete(self, condition: Column) -> int:
        old = self.manifest()
        if not old["parts"]:
            return 0
        gone = self._gone(old, self._stored(old).where(condition))
        if gone["rows"]:
            self._publish(old, old["parts"], [*old["deletes"], gone])
        else:
            self._manifests.remove(f"gone-{gone['name']}")
        return gone["rows"]

    def delete(self, drawer_id: str) -> bool:
        return self._delete(F.col("id") == drawer_id) > 0

    def delete_source(self, source_file: str) -> int:
        return self._delete(F.col("source_file") == source_file)

    def delete_wing(self, wing: str) -> int:
        return self._delete(F.col("wing") == wing)

    def reembed(self, wing: str | None = None) -> int:
        """Encode all drawers anew, or those of one wing where the store's vectors are of this encoder already; returns how many. Ids and texts must be the same after it, or nothing is published."""
        old = self.manifest()
        if wing is not None:
            self.check_model(old)
        rows = self._stored(old)
        mine = rows if wing is None else rows.where(F.col("wing") == wing)
        part = self._write(self._encoded(mine.select(*COLUMNS)))
        mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("id", "content") % 1000003)).first()
        if mark(self._read(part)) != mark(mine):
            raise RuntimeError("the drawers changed while they were encoded")
        if wing is None:
            self._publish(old, [part], [])
        elif part["rows"]:
            self._publish(old, [*old["parts"], part], [*old["deletes"], self._gone(old, mine)])
        return part["rows"]

    def has_source(self, source_file: str) -> bool:
        return not self.drawers().where(F.col("source_file") == source_file).limit(1).isEmpty()


class Lease:
    """One holder at a time, for as long as it renews: versions of a manifest of its own."""

    def __init__(self, spark: SparkSession, path: str, owner: str, ttl_ms: int = 300_000) -> None:
        self._m, self.owner, self.ttl = Manifests(spark, path), owner, ttl_ms

    def acquire(self, now_ms: int | None = None) -> bool:
        """Take or renew it; false while another holder's time hasn't run out."""
        now = int(time.time() * 1000) if now_ms is None else now_ms
        held = self._m.read()
        if held.get("owner") not in (None, self.owner) and held["expires_at_ms"] >= now:
            return False
        try:
            self._m.publish({"version": held["version"] + 1, "owner": self.owner, "expires_at_ms": now + self.ttl})
        except Conflict:
            return False
        return True

    renew = acquire

    def release(self) -> None:
        held = self._m.read()
        if held.get("owner") == self.owner:
            self._m.publish({"version": held["version"] + 1, "owner": None, "expires_at_ms": 0})


def today() -> str:
    return dt.datetime.now(dt.timezone.utc).date().isoformat()


def as_json(rows: DataFrame) -> list[dict]:
    """A small result for display."""
    return [json.loads(r) for r in rows.toJSON().collect()]
