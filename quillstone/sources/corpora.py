"""Question sets, record files, and the text and JSON that results are written as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = (
    "question_id string, question string, question_type string, question_date string, answer_session_ids array<string>, "
    "haystack_sessions array<array<struct<role string, content string>>>, haystack_session_ids array<string>, haystack_dates array<string>"
)


def questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Entries of a file that is one JSON array, or of a file with one entry a line."""
    rows = spark.read.schema(QUESTIONS).option("multiLine", "true").json(path).where("question_id is not null")
    return rows if limit is None else rows.limit(limit)


def of_split(rows: DataFrame, ids: DataFrame | None, id_col: str = "question_id") -> DataFrame:
    """The rows whose id is in a split; all without one."""
    return rows if ids is None else rows.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")


def session_drawers(rows: DataFrame) -> DataFrame:
    """One drawer for each haystack session with something the user said; the session's place in the list stays its index.

    Sessions, ids and dates must be equally many, or the query fails and says so.
    """
    same = (F.size("haystack_sessions") == F.size("haystack_session_ids")) & (F.size("haystack_sessions") == F.size("haystack_dates"))
    fail = F.raise_error(F.concat(F.lit("sessions, ids and dates differ in number: "), F.col("question_id"))).cast("array<struct<s:array<struct<role:string,content:string>>,id:string,at:string>>")
    zipped = F.arrays_zip(F.col("haystack_sessions").alias("s"), F.col("haystack_session_ids").alias("id"), F.col("haystack_dates").alias("at"))
    each = rows.select("question_id", F.posexplode(F.when(same, zipped).otherwise(fail)).alias("chunk_index", "x"))
    said = F.array_join(F.transform(F.filter("x.s", lambda t: t["role"] == "user"), lambda t: t["content"]), "\n")
    return each.select(
        F.concat_ws(":", "question_id", F.col("chunk_index").cast("string"), "x.id").alias("id"),
        "question_id",
        F.col("x.id").alias("session_id"),
        said.alias("content"),
        F.lit("conversation").alias("content_kind"),
        F.col("question_id").alias("wing"),
        F.lit("sessions").alias("room"),
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("x.at").alias("filed_at"),
    ).where("content != ''")


def record_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, json`` of the ``*.json`` files right in a folder, by path."""
    rows = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "false").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")).orderBy("path")


def write_dialect(rows: DataFrame, path: str, by: str = "id") -> None:
    """Entries in order, a blank line behind each; one file for each partition, in the order of their names."""
    rows.repartitionByRange(by).sortWithinPartitions(by).select(F.concat("dialect", F.lit("\n"))).write.text(path)


def write_results(rows: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One JSON object a line."""
    rows.write.option("maxRecordsPerFile", most).json(path)
