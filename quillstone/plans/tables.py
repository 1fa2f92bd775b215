"""The test tables, and the views that the queries take of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(rows: DataFrame) -> DataFrame:
    """One row for each id: of repeated deliveries the first filed. Rows of an id filed at the same time are one delivery.

    The order looks at no wide column, so that counts don't read texts or vectors.
    """
    order = Window.partitionBy("id").orderBy(F.asc_nulls_last("filed_at"))
    return rows.where("id is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def drawers(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """Drawers, each once. A condition on what all deliveries of an id have in common goes to the scan."""
    rows = table(spark, folder, "drawers")
    return once(rows if where is None else rows.where(where))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "multi_domain_queries"))
