"""Fact graph: triples with validity intervals kept as text, so that partial dates such as ``2025`` compare as written.

Ids are made of names by ``entity_id``. All functions take whole tables and return plans;
what they are asked for (an entity, a predicate) is a filter before any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["id", "subject", "predicate", "object", "valid_from", "valid_to", "confidence", "source_closet", "source_file", "extracted_at"]


def entity_id(name: Column) -> Column:
    """Lower case, blanks as ``_``, apostrophes dropped; dots stay."""
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def predicate_name(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit(" "), F.lit("_"))


def as_id(name: str) -> str:
    return name.lower().replace(" ", "_").replace("'", "")


def normalised(triples: DataFrame) -> DataFrame:
    """Distinct triples with ids for subject and object and one spelling of each predicate. Rows without subject, predicate or object go."""
    t = triples.select(*COLUMNS).where("subject is not null and predicate is not null and object is not null")
    return t.withColumns({"subject": entity_id(F.col("subject")), "predicate": predicate_name(F.col("predicate")), "object": entity_id(F.col("object"))}).distinct()


def entities_of(triples: DataFrame) -> DataFrame:
    """``id, name``: every subject and object; of several spellings the first extracted, then the smallest, is the name."""
    both = triples.select(F.col("subject").alias("name"), "extracted_at").unionByName(triples.select(F.col("object").alias("name"), "extracted_at")).where("name is not null")
    first = F.min(F.struct(F.coalesce("extracted_at", F.lit("9999-01-01").cast("timestamp")).alias("at"), "name"))
    return both.groupBy(entity_id(F.col("name")).alias("id")).agg(first.alias("f")).select("id", F.col("f.name").alias("name"))


def valid_at(day: str) -> Column:
    """Both ends inclusive, open where null."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))


def current() -> Column:
    return F.col("valid_to").isNull()


def _record(rows: DataFrame, direction: str) -> DataFrame:
    return rows.select(F.lit(direction).alias("direction"), "subject", "predicate", "object", "valid_from", "valid_to", "confidence", "source_closet", current().alias("current"))


def about(triples: DataFrame, entities: DataFrame, name: str, direction: str = "both", as_of: str | None = None) -> DataFrame:
    """Facts of an entity. The entity itself is shown as asked for, the other side by its stored name. Facts whose other side is no known entity are left out; a fact from an entity to itself comes once in each direction. Another direction than the three gives no rows."""
    key = as_id(name)
    t = triples if as_of is None else triples.where(valid_at(as_of))
    other = entities.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    out = t.where(F.col("subject") == key).join(other, F.col("object") == F.col("_id")).withColumn("subject", F.lit(name)).withColumn("object", F.col("_name"))
    into = t.where(F.col("object") == key).join(other, F.col("subject") == F.col("_id")).withColumn("object", F.lit(name)).withColumn("subject", F.col("_name"))
    parts = {"outgoing": [_record(out, "outgoing")], "incoming": [_record(into, "incoming")]}
    parts["both"] = parts["outgoing"] + parts["incoming"]
    rows = parts.get(direction, [_record(out.where("false"), "outgoing")])
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


def _named(triples: DataFrame, entities: DataFrame) -> DataFrame:
    s = entities.select(F.col("id").alias("_s"), F.col("name").alias("_sn"))
    o = entities.select(F.col("id").alias("_o"), F.col("name").alias("_on"))
    rows = triples.join(s, F.col("subject") == F.col("_s")).join(o, F.col("object") == F.col("_o"))
    return rows.select("id", F.col("_sn").alias("subject"), "predicate", F.col("_on").alias("object"), "valid_from", "valid_to", current().alias("current"))


def relationship(triples: DataFrame, entities: DataFrame, predicate: str, as_of: str | None = None) -> DataFrame:
    """All facts of a predicate, both sides named."""
    rows = triples.where(F.col("predicate") == predicate.lower().replace(" ", "_"))
    return _named(rows if as_of is None else rows.where(valid_at(as_of)), entities).drop("id")


def timeline(triples: DataFrame, entities: DataFrame, name: str | None = None, limit: int = 100) -> DataFrame:
    """Facts in the order they began, undated last; then by predicate, subject, object and id."""
    rows = triples if name is None else triples.where((F.col("subject") == as_id(name)) | (F.col("object") == as_id(name)))
    return _named(rows, entities).orderBy(F.asc_nulls_last("valid_from"), "predicate", "subject", "object", "id").limit(limit).drop("id")


def stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: entities, triples, current, expired and the sorted predicates."""
    t = triples.agg(F.count("*").alias("triples"), F.count_if(current()).alias("current_facts"), F.count_if(~current()).alias("expired_facts"), F.array_sort(F.collect_set("predicate")).alias("relationship_types"))
    return t.crossJoin(F.broadcast(entities.agg(F.count("*").alias("entities"))))


def add(triples: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new facts. One that is open already, or comes twice among the new open ones, is not added again.

    ``new`` has the columns of ``triples``; an id that is null is made of the fact's parts.
    """
    key = ["subject", "predicate", "object"]
    new = new.withColumns({"subject": entity_id(F.col("subject")), "predicate": predicate_name(F.col("predicate")), "object": entity_id(F.col("object"))})
    made = F.concat_ws("_", F.lit("t"), *key, F.md5(F.concat_ws("|", F.coalesce("valid_from", F.lit("")), F.coalesce("valid_to", F.lit("")))))
    new = new.withColumn("id", F.coalesce("id", made))
    first = Window.partitionBy(*key, F.col("valid_to").isNull()).orderBy("extracted_at", "id")
    new = new.withColumn("_n", F.row_number().over(first)).where(F.col("valid_to").isNotNull() | (F.col("_n") == 1)).drop("_n")
    fresh = new.join(triples.where(current()).select(*key).distinct(), key, "left_anti")
    return triples.unionByName(fresh.select(*triples.columns))


def invalidate(triples: DataFrame, subject: str, predicate: str, obj: str, ended: str) -> DataFrame:
    """The table with ``valid_to`` set on the open facts that match; unchanged if there are none."""
    match = (F.col("subject") == as_id(subject)) & (F.col("predicate") == predicate.lower().replace(" ", "_")) & (F.col("object") == as_id(obj)) & current()
    return triples.withColumn("valid_to", F.when(match, F.lit(ended)).otherwise(F.col("valid_to")))


def add_entity(entities: DataFrame, name: str, kind: str = "unknown", properties: str = "{}") -> DataFrame:
    """The entities with one put in or replaced."""
    row = entities.sparkSession.createDataFrame([(as_id(name), name, kind, properties)], "id string, name string, type string, properties string")
    return entities.where(F.col("id") != as_id(name)).unionByName(row, allowMissingColumns=True)
