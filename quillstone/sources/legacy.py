"""Import of stores that keep metadata as one row for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import content_kind

DOCUMENT = "document"


def pivoted(metadata: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each id with a text column for each key: the string value or else the integer, float or boolean one."""
    value = F.coalesce("string_value", F.col("int_value").cast("string"), F.col("float_value").cast("string"), F.col("bool_value").cast("string"))
    return metadata.groupBy("id").agg(*[F.max(F.when(F.col("key") == k, value)).alias(k) for k in keys])


def imported(embeddings: DataFrame, metadata: DataFrame) -> DataFrame:
    """Drawers of a legacy store: ``embeddings(id, embedding_id)`` and ``metadata(id, key, *_value)``. Blank documents go; wing, room and author get defaults."""
    keys = [DOCUMENT, "wing", "room", "source_file", "chunk_index", "added_by", "filed_at"]
    rows = embeddings.join(pivoted(metadata, keys), "id").where(F.btrim(F.coalesce(F.col(DOCUMENT), F.lit(""))) != "")
    wing, room = F.coalesce("wing", F.lit("legacy")), F.coalesce("room", F.lit("general"))
    return rows.select(
        F.col("embedding_id").alias("id"),
        F.col(DOCUMENT).alias("content"),
        F.lit(None).cast("string").alias("retrieval_text"),
        content_kind(F.col("source_file"), wing, room, missing="unknown").alias("content_kind"),
        wing.alias("wing"),
        room.alias("room"),
        "source_file",
        F.coalesce(F.col("chunk_index").try_cast("long"), F.lit(0)).alias("chunk_index"),
        F.coalesce("added_by", F.lit("migration")).alias("added_by"),
        "filed_at",
    )
