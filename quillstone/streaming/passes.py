"""Passes over session folders: who may read them, when, and notes that are replaced as a whole."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import chunking
from quillstone.plans.staging import stage
from quillstone.sources import session_lines
from quillstone.sources.manifest import Manifests
from quillstone.sources.store import Lease, Store


@dataclass
class Report:
    """What a pass did."""

    discovered: int = 0
    imported: int = 0
    waiting_for_first_run: int = 0
    busy: bool = False
    errors: list[str] = field(default_factory=list)


class Roots:
    """Folders that a person has agreed to have read, by adapter."""

    def __init__(self, spark, path: str) -> None:
        self._m = Manifests(spark, path)

    def initialised(self, adapter: str, root: str) -> bool:
        return f"{adapter}\0{os.path.abspath(root)}" in self._m.read().get("roots", [])

    def initialise(self, adapter: str, root: str) -> None:
        if not self.initialised(adapter, root):
            now = self._m.read()
            self._m.publish({"version": now["version"] + 1, "roots": [*now.get("roots", []), f"{adapter}\0{os.path.abspath(root)}"]})


class LeaseLost(RuntimeError):
    pass


class Heartbeat:
    """Renews a lease three times in its life for as long as the block runs; leaving it raises ``LeaseLost`` if another holder got it meanwhile."""

    def __init__(self, lease: Lease, every_s: float | None = None) -> None:
        self.lease, self.every, self.lost = lease, every_s or lease.ttl / 3000, False
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._beat, daemon=True)

    def _beat(self) -> None:
        while not self._stop.wait(self.every):
            if not self.lease.renew():
                self.lost = True
                return

    def __enter__(self) -> Heartbeat:
        self._thread.start()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self._stop.set()
        self._thread.join()
        if self.lost and kind is None:
            raise LeaseLost("another holder took the lease during the pass")


def one_pass(roots: Roots, lease: Lease, adapter: str, root: str, read: Callable[[], int], *, by_hand: bool) -> Report:
    """Read a folder if it may be read: a folder's first pass must be asked for by hand, later ones come by themselves. Only the holder of the lease reads."""
    found = Report(discovered=len(session_lines.discover(root)))
    if not by_hand and not roots.initialised(adapter, root):
        found.waiting_for_first_run = found.discovered
        return found
    if not lease.acquire():
        found.busy = True
        return found
    try:
        with Heartbeat(lease):
            found.imported = read()
        roots.initialise(adapter, root)
    except Exception as e:  # noqa: BLE001  the next pass tries again
        found.errors.append(str(e)[:500])
    finally:
        lease.release()
    return found


def poll(run: Callable[[], Report], interval_s: float, *, stop: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep) -> int:
    """Run at once and then every ``interval_s`` seconds until ``stop``; with 0 just once. Returns the number of passes."""
    n = 0
    while True:
        run()
        n += 1
        if interval_s <= 0 or stop():
            return n
        sleep(interval_s)


def note_drawers(files: DataFrame, wing: str, agent: str) -> DataFrame:
    """Drawers of notes ``source_file, content``: front matter off, cut as text, with ids that follow from file and position."""
    rows = files.select("source_file", T.without_front_matter(F.coalesce("content", F.lit(""))).alias("body"))
    rows = rows.select("source_file", "body", F.posexplode(chunking.chunks(F.col("body"), F.lit(None).cast("string"))).alias("chunk_index", "c"))
    chunk = F.col("c.chunk")
    return rows.select(
        F.concat(F.lit("drawer_note_"), F.left(F.sha2(F.concat_ws("\0", F.lit(wing), "source_file", F.col("chunk_index").cast("string")), 256), F.lit(32))).alias("id"),
        chunk.alias("content"),
        T.documentation_retrieval_text(F.col("source_file"), F.col("body"), chunk).alias("retrieval_text"),
        F.lit("documentation").alias("content_kind"),
        F.lit("memory").alias("room"),
        "source_file",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.lit(agent).alias("added_by"),
        F.lit(None).cast("string").alias("filed_at"),
        F.lit(wing).alias("wing"),
    )


def listed_notes(spark: SparkSession, root: str) -> DataFrame:
    """``source_file, file_size, modified_ns`` of ``memory/*.md`` anywhere below a folder of any file system; the listing is Spark's, nothing is opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(root)
    name = F.regexp_replace("path", "^file:/*", "/")
    return rows.where(F.col("path").rlike(r"/memory/[^/]+$")).select(name.alias("source_file"), F.col("length").alias("file_size"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"))


def sync_notes(store: Store, root: str, wing: str, agent: str) -> int:
    """Replace the drawers of notes that changed, and drop those of notes that are gone; a note counts as changed if its size or time did. Returns how many did."""
    spark = store.spark
    now, old = stage(listed_notes(spark, root), "notes"), store.sync_state()
    changed = now if old is None else now.join(old, ["source_file", "file_size", "modified_ns"], "left_anti")
    changed = changed.select("source_file")
    gone = changed.limit(0) if old is None else old.join(now.select("source_file"), "source_file", "left_anti").select("source_file")
    n = changed.count()
    if n or not gone.isEmpty():
        texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").text(root, wholetext=True)
        texts = texts.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("source_file"), F.col("value").alias("content")).join(changed, "source_file", "left_semi")
        store.upsert(note_drawers(texts, wing, agent), replaced_sources=changed.unionByName(gone), sync_state=now)
    return n
