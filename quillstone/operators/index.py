"""The inverted index: postings with places, written with the drawers and sorted by term, and BM25 from them.

A row is one term of one drawer, with its count, its places, the drawer's length and what
searches filter by, so that a ranking reads postings only, and of them only the row groups
of its terms. A frequent term is spread over many files by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

SCHEMA = "term string, id string, tf int, places array<int>, length int, content_kind string, wing string, room string"


@dataclass(frozen=True)
class Index:
    """Postings of a store, and how many drawers and words it has."""

    postings: DataFrame
    rows: int
    words: int


def postings(drawers: DataFrame) -> DataFrame:
    """``term, id, tf, places, length, content_kind, wing, room``: one row for each different word of each drawer; null contents have none."""
    words = F.col("_w")
    rows = drawers.select("id", "content_kind", "wing", "room", F.inline(F.array(F.struct(T.lexical_words(F.coalesce("content", F.lit(""))).alias("_w")))))
    each = rows.select("id", "content_kind", "wing", "room", F.size(words).alias("length"), F.posexplode(words).alias("place", "term"))
    grouped = each.groupBy("term", "id").agg(F.array_sort(F.collect_list("place")).alias("places"), *[F.first(c).alias(c) for c in ("length", "content_kind", "wing", "room")])
    return grouped.select("term", "id", F.size("places").alias("tf"), "places", "length", "content_kind", "wing", "room")


def write(drawers: DataFrame, path: str) -> None:
    postings(drawers).repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(path)


def _wanted(terms: list[str]) -> Column:
    """Terms that begin with one of the prefixes, or are a word of a phrase; goes to the scan."""
    heads = [F.col("term").startswith(t[:-1]) for t in terms if t.endswith("*")]
    whole = sorted({w for t in terms if not t.endswith("*") for w in t.split(" ")})
    parts = heads + [F.col("term").isin(whole)] * bool(whole)
    out = parts[0] if parts else F.lit(False)
    for p in parts[1:]:
        out = out | p
    return out


def counted(index: Index, terms: list[str], scope: Column | None = None) -> DataFrame:
    """``id, content_kind, wing, room, length, tf, mean, idf`` of drawers that hold any of the terms: counts by term, weights over the whole store."""
    hits = index.postings.where(_wanted(terms))
    sums = []
    for i, t in enumerate(terms):
        if t.endswith("*"):
            sums.append(F.sum(F.when(F.col("term").startswith(t[:-1]), F.col("tf")).otherwise(0)).alias(f"c{i}"))
    phrases = sorted({w for t in terms if not t.endswith("*") for w in t.split(" ")})
    places = [F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"p{j}") for j, w in enumerate(phrases)]
    rows = hits.groupBy("id").agg(*[F.first(c).alias(c) for c in ("content_kind", "wing", "room", "length")], *sums, *places)

    def count(i: int, t: str) -> Column:
        if t.endswith("*"):
            return F.col(f"c{i}").cast("int")
        a, b = (F.col(f"p{phrases.index(w)}") for w in t.split(" "))
        return F.coalesce(F.size(F.array_intersect(F.transform(a, lambda x: x + 1), b)), F.lit(0))

    rows = rows.select("id", "content_kind", "wing", "room", "length", F.array(*[count(i, t) for i, t in enumerate(terms)]).alias("tf"))
    n = F.lit(float(index.rows))
    holds = [F.count_if(F.col("tf")[i] > 0).alias(f"n{i}") for i in range(len(terms))]
    idf = [F.greatest(F.log((n - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(1e-6)) for i in range(len(terms))]
    stats = rows.agg(*holds).select(F.lit(index.words / index.rows if index.rows else 0.0).alias("mean"), F.array(*idf).alias("idf"))
    found = rows if scope is None else rows.where(scope)
    return found.crossJoin(F.broadcast(stats))  # a single row
