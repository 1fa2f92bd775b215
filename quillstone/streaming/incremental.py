"""Processing only what is new or changed since the last successful run.

The target is the state. Every output row carries its source key and the version of the
source it was made from. A run finds out which version of each source it has before it
(the one the target knows, if the bytes before the target's offset still are the same;
a new one otherwise) and anti-joins the source's records against the target's rows on
key, version and place. New rows and checkpoints go to folders nobody reads yet and are
published by renaming one manifest into place. A run that fails before the rename has
changed nothing; one that fails after it finds nothing left to do. Two runs on the same
version can't both publish: the second rename fails.

Where only checkpoints of the target are at hand (``pending``), they stand for its rows:
a checkpoint of version v covers the places before its offset.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.fingerprint import BASIS, TAIL, fnv1a_hex
from quillstone.plans.staging import stage
from quillstone.sources.manifest import Manifests

FILE = ["adapter", "source_key"]
EMPTY = f"{BASIS:016x}"
STATE = "adapter string, source_key string, source_path string, file_size long, modified_ns long, byte_offset long, fingerprint string, version string"
DONE = "adapter string, source_key string, start_byte long, raw_line string, version string"


def instant(text: str) -> F.Column:
    """The point in time of an RFC 3339 text with any offset; null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(text, r"Z$", "+00:00"), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]xxx"))


def latest_checkpoints(state: DataFrame) -> DataFrame:
    """One checkpoint per (adapter, source_key): the one with the latest instant in ``updated_at``. Texts that name no instant count as earliest; a tie goes to the larger offset, then fingerprint."""
    last = F.max(F.struct(instant("updated_at").alias("at"), F.col("byte_offset"), F.col("fingerprint"), F.col("file_size"), F.col("modified_ns")))
    return state.groupBy(*FILE).agg(last.alias("c")).select(*FILE, "c.byte_offset", "c.fingerprint")


def latest_records(records: DataFrame) -> DataFrame:
    """One row per (adapter, source_key, start_byte): the line as last read. A null ``read_at`` counts as earliest."""
    last = F.max(F.struct("read_at", "raw_line", "has_newline"))
    rows = records.where("adapter is not null and source_key is not null and start_byte is not null")
    return rows.groupBy(*FILE, "start_byte").agg(last.alias("r")).select(*FILE, "start_byte", F.coalesce("r.raw_line", F.lit("")).alias("raw_line"), F.coalesce("r.has_newline", F.lit(False)).alias("has_newline"))


def listed_files(files: DataFrame) -> DataFrame:
    """One row per (adapter, source_key); of differing listings the latest modified."""
    last = F.max(F.struct("modified_ns", "file_size", "source_path"))
    return files.where("adapter is not null and source_key is not null").groupBy(*FILE).agg(last.alias("f")).select(*FILE, "f.source_path", "f.file_size", "f.modified_ns")


def _prints(lines: DataFrame) -> DataFrame:
    """``adapter, source_key, present``: of records that carry their file's ``byte_offset``, the hash of the at most 4,096 bytes before it.

    Files whose records don't hold all of these bytes have no row, and neither has an offset of 0. Only the bytes needed
    are gathered, so a file of any length gives one row of at most 4,096 bytes.
    """
    first, size = F.greatest(F.col("byte_offset") - TAIL, F.lit(0)), F.octet_length("raw_line") + F.col("has_newline").cast("int")
    lines = lines.where((F.col("start_byte") < F.col("byte_offset")) & (F.col("start_byte") + size > first))
    begin = F.greatest(first - F.col("start_byte"), F.lit(0))
    length = F.least(F.col("byte_offset") - F.col("start_byte"), size) - begin
    whole = F.concat(F.encode("raw_line", "UTF-8"), F.when(F.col("has_newline"), F.encode(F.lit("\n"), "UTF-8")).otherwise(F.encode(F.lit(""), "UTF-8")))
    part = F.substring(whole, (begin + 1).cast("int"), length.cast("int"))
    lines = lines.select(*FILE, (F.col("byte_offset") - first).alias("wanted"), F.struct("start_byte", part.alias("part")).alias("p"), length.alias("n"))
    tails = lines.groupBy(*FILE).agg(F.array_sort(F.collect_list("p")).alias("p"), F.sum("n").alias("n"), F.first("wanted").alias("wanted")).where("n = wanted")
    return tails.select(*FILE, fnv1a_hex(F.col("p.part")).alias("present"))


def with_versions(files: DataFrame, records: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of listed files, and ``adapter, source_key, present``: the source's version at the target's offset.

    Records carry ``byte_offset`` of the file's checkpoint, null where it has none within the file.
    """
    known = files.select(*FILE, "file_size").join(checkpoints.select(*FILE, "byte_offset"), FILE, "left")
    known = known.select(*FILE, F.when(F.col("byte_offset").between(0, F.col("file_size")), F.col("byte_offset")).alias("byte_offset"))
    lines = records.join(known, FILE)
    return lines, _prints(lines.where("byte_offset > 0"))


def pending(files: DataFrame, records: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Records that the next run must process: complete, not blank, of a listed file, and not covered by the target.

    ``adapter, source_key, start_byte, raw_line``. Takes the outputs of ``listed_files``, ``latest_records`` and
    ``latest_checkpoints``. The version on the source's side is the fingerprint of its present bytes before the target's
    offset, on the target's side the fingerprint that was stored. Where they differ, or the offset lies outside the
    file, the target covers nothing of this file.
    """
    lines, present = with_versions(files, records, checkpoints)
    source = lines.where(F.col("has_newline") & F.col("raw_line").rlike(r"[^\p{IsWhite_Space}]")).join(present.withColumnRenamed("present", "version"), FILE, "left")
    target = checkpoints.select(*FILE, F.col("fingerprint").alias("version"), F.col("byte_offset").alias("upto"))
    same = [F.col(f"s.{c}") == F.col(f"t.{c}") for c in (*FILE, "version")]
    rest = source.alias("s").join(target.alias("t"), [*same, F.col("s.start_byte") < F.col("t.upto")], "left_anti")
    return rest.select(*FILE, "start_byte", "raw_line")


def new_checkpoints(files: DataFrame, records: DataFrame) -> DataFrame:
    """A checkpoint for each listed file: the offset behind its last complete line, and the fingerprint there. Null where the records lack bytes before it."""
    ends = records.where("has_newline").groupBy(*FILE).agg(F.max(F.col("start_byte") + F.octet_length("raw_line") + 1).alias("byte_offset"))
    known = files.join(ends, FILE, "left").withColumn("byte_offset", F.least(F.coalesce("byte_offset", F.lit(0)), F.col("file_size")))
    present = _prints(records.join(known.select(*FILE, "byte_offset"), FILE))
    print_ = F.when(F.col("byte_offset") == 0, F.lit(EMPTY)).otherwise(F.col("present"))
    return known.join(present, FILE, "left").select(*FILE, "source_path", "file_size", "modified_ns", "byte_offset", print_.alias("fingerprint"))


class Target:
    """A folder of published versions. ``rows`` of a version are all data folders its manifest names; ``state`` is one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._manifests = Manifests(spark, path)

    def version(self) -> int:
        return self._manifests.version()

    def manifest(self, version: int | None = None) -> dict:
        return {"rows": [], "state": None} | self._manifests.read(version)

    def all_rows(self, version: int | None = None) -> DataFrame:
        """All rows ever published up to a version, those of replaced files too."""
        paths = self.manifest(version)["rows"]
        return self.spark.read.schema(DONE).parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], DONE)

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of each file's current version. A file that is not listed any more keeps its rows."""
        return self.all_rows(version).join(self.state(version).select(*FILE, "version"), [*FILE, "version"], "left_semi").select(*[c.split()[0] for c in DONE.split(", ")])

    def state(self, version: int | None = None) -> DataFrame:
        path = self.manifest(version)["state"]
        return self.spark.read.schema(STATE).parquet(f"{self.path}/{path}") if path else self.spark.createDataFrame([], STATE)

    def run(self, files: DataFrame, records: DataFrame, *, fail_before_publish: bool = False) -> int:
        """One run: records that the target doesn't hold become rows of the next version, together with the new checkpoints. Returns the version.

        A file that was replaced starts over under a version of its own. Checkpoints of files that are not listed stay, so
        a file that is missing from one listing goes on where it was. A run that finds nothing publishes nothing.
        """
        old = self.manifest()
        name = uuid.uuid4().hex
        files, records, state = listed_files(files), latest_records(records), self.state(old["version"])
        lines, present = with_versions(files, records, state)
        goes_on = (F.col("present") == F.col("fingerprint")) | ((F.col("byte_offset") == 0) & (F.col("file_size") >= 0))
        here = files.select(*FILE, F.col("file_size").alias("size")).join(state, FILE, "left").join(present, FILE, "left")
        here = here.select(*FILE, F.when(goes_on, F.col("version")).otherwise(F.lit(name)).alias("version"), F.coalesce(goes_on & (F.col("size") <= F.col("byte_offset")), F.lit(False)).alias("whole"))
        here = stage(here, "versions")
        source = lines.where(F.col("has_newline") & F.col("raw_line").rlike(r"[^\p{IsWhite_Space}]")).select(*FILE, "start_byte", "raw_line")
        source = source.join(here.where("not whole").select(*FILE, "version"), FILE)  # a file that the target covers to its end has no new records
        todo = source.join(self.all_rows(old["version"]).select(*FILE, "version", "start_byte"), [*FILE, "version", "start_byte"], "left_anti")
        todo.select(*[c.split()[0] for c in DONE.split(", ")]).write.parquet(f"{self.path}/rows-{name}")
        now = new_checkpoints(files, records).join(here.select(*FILE, "version"), FILE)
        kept = state.join(files.select(*FILE), FILE, "left_anti")
        columns = [c.split()[0] for c in STATE.split(", ")]
        now.select(*columns).unionByName(kept.select(*columns)).write.parquet(f"{self.path}/state-{name}")
        written = self.spark.read.schema(DONE).parquet(f"{self.path}/rows-{name}")
        moved = [*FILE, "byte_offset", "fingerprint", "version"]
        empty = written.isEmpty()
        if empty and self.spark.read.schema(STATE).parquet(f"{self.path}/state-{name}").select(*moved).exceptAll(state.select(*moved)).isEmpty():
            self._manifests.remove(f"rows-{name}", f"state-{name}")
            return old["version"]
        if fail_before_publish:
            raise RuntimeError("failed before publishing")
        rows = old["rows"] if empty else [*old["rows"], f"rows-{name}"]
        return self._manifests.publish({"version": old["version"] + 1, "rows": rows, "state": f"state-{name}"})

    def compact(self) -> int:
        """Publish a version whose rows are the current ones in one folder."""
        old, name = self.manifest(), uuid.uuid4().hex
        self.rows(old["version"]).write.parquet(f"{self.path}/rows-{name}")
        return self._manifests.publish({"version": old["version"] + 1, "rows": [f"rows-{name}"], "state": old["state"]})
