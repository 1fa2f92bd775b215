"""The drawers of a folder as a store: each once, encoded, with its index. Written once for a folder as it is, read by all searches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillstone.functions.vectors import hash_embed
from quillstone.plans.staging import scratch
from quillstone.plans.tables import drawers
from quillstone.sources.store import Store

DIM = 64
_stores: dict[tuple, Store] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of a table's files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)))


def store(spark: SparkSession, folder: str) -> Store:
    """The store of the folder's drawers under the shared folder; made anew where the table's files have changed."""
    key = (spark.sparkContext.applicationId, _stamp(spark, f"{folder}/drawers.parquet"))
    if key not in _stores:
        made = Store(spark, scratch(spark, "drawers"), model=f"hash-{DIM}", encode=lambda body: hash_embed(body, DIM), index=True)
        made.insert(drawers(spark, folder))
        _stores[key] = made
    return _stores[key]
