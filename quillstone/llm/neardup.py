"""Near-duplicate texts: exact shingle similarity on pairs that share a band of a DartMinHash signature.

Texts with the same set of shingles form a class and are compared once. Band rows carry
128 one-bit coordinates, so pairs far below the threshold end inside the join and are
never shuffled; the rest meet their whole shingle sets and are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import darts
from quillstone.llm.words import M1, mix, shingles
from quillstone.plans.staging import stage

BANDS, ROWS, WHOLE = 36, 4, 50
#: Rows of a batch that are worked on at once.
_STEP = 2000


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                h, starts = shingles(part.column(1).to_pylist(), size)
                n = np.diff(starts)
                total = np.zeros(len(n), np.uint64)
                np.add.at(total, np.repeat(np.arange(len(n)), n), mix(h * M1))
                cls = mix(total + n.astype(np.uint64)).view(np.int64)
                sets = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                rows = pa.RecordBatch.from_arrays([part.column(0), pa.array(cls), pa.array(n.astype(np.int32)), sets], ["id", "cls", "n", "sh"])
                yield rows.filter(pa.array(n > 0))

    return run


def _bands(count: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                lists = part.column(1)
                starts = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
                h = mix(lists.flatten().to_numpy().view(np.uint32).astype(np.uint64) + M1)
                sig = darts.signatures(h, starts, count * rows)
                cls, b = part.column(0).to_numpy(), darts.bands(sig, rows).view(np.int64)
                s = darts.bits(sig, 2)
                yield pa.RecordBatch.from_arrays([pa.array(b.ravel()), *(pa.array(np.repeat(x, count)) for x in (cls, s[:, 0], s[:, 1]))], ["band", "cls", "s0", "s1"])

    return run


def _far(least: float) -> int:
    """Of 128 one-bit coordinates, how many may differ: 3.7 standard deviations beyond what ``least`` gives on average."""
    p = (1 - least) / 2
    return int(np.ceil(128 * p + 3.7 * np.sqrt(128 * p * (1 - p))))


def near_classes(df: DataFrame, id_col: str, text_col: str, *, shingle: int, least: float, band_count: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Members ``id, cls`` and pairs ``cls_a, cls_b, similarity`` of classes of equal shingle sets."""
    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    sets = stage(texts.mapInArrow(_sets(shingle), "id string, cls long, n int, sh array<int>"), "shingles")
    members = sets.select("id", "cls").distinct()
    whole = sets.groupBy("cls").agg(F.first("sh").alias("sh"))
    rows_ = whole.mapInArrow(_bands(band_count, rows), "band long, cls long, s0 long, s1 long")
    a, b = rows_.alias("a"), rows_.alias("b")
    differ = F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))) + F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1")))
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.cls") < F.col("b.cls")) & (differ <= _far(least)))
    met = met.select(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b")).distinct()
    pairs = met.join(whole.select(F.col("cls").alias("cls_a"), F.col("sh").alias("sh_a")), "cls_a").join(whole.select(F.col("cls").alias("cls_b"), F.col("sh").alias("sh_b")), "cls_b")
    both = F.size(F.array_intersect("sh_a", "sh_b"))
    pairs = pairs.withColumn("similarity", both / (F.size("sh_a") + F.size("sh_b") - both)).where(F.col("similarity") >= least)
    return members, pairs.select("cls_a", "cls_b", "similarity")


def near_pairs(df: DataFrame, id_col: str = "id", text_col: str = "content", *, shingle: int = 5, least: float = 0.8, whole: int = WHOLE, **bands: int) -> DataFrame:
    """``id_a, id_b`` (``id_a`` < ``id_b``): ids whose texts' sets of distinct word sequences have intersection / union of at least ``least``.

    * Texts with the same set form a class. Up to ``whole`` members all of them are paired; of a larger class the
      smallest id stands for it: it is paired with every member, and alone with other classes.
    * A null id or text, and a text of fewer than ``shingle`` words, is in no pair. Repeated rows count once.
    * Other columns are not read; an empty input gives no rows.

    Pairs are verified exactly (on 32 bits of each shingle's hash). Below the similarity at which all bands can miss,
    a pair may be lost: at ``least`` itself, of 36 bands of 4 rows, 0.7 % for 0.6.
    """
    members, pairs = near_classes(df, id_col, text_col, shingle=shingle, least=least, **bands)
    sizes = members.groupBy("cls").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    stands = members.join(sizes, "cls").where((F.col("n") <= whole) | (F.col("id") == F.col("rep")))
    inner = members.join(sizes.where("n > 1"), "cls")
    a, b = stands.select(F.col("cls").alias("cls_a"), F.col("id").alias("x")), stands.select(F.col("cls").alias("cls_b"), F.col("id").alias("y"))
    across = pairs.join(a, "cls_a").join(b, "cls_b").select("x", "y")
    small = inner.where(F.col("n") <= whole)
    within = small.select("cls", F.col("id").alias("x")).join(small.select("cls", F.col("id").alias("y")), "cls").where("x < y").select("x", "y")
    star = inner.where((F.col("n") > whole) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("id").alias("y"))
    return across.unionByName(within).unionByName(star).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, label``: connected components (label: the smallest node), by large-star and small-star steps on staged tables."""
    edges = stage(edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v")).where("u != v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u != v").distinct()
        large = stage(large, "large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        small = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m")).where("v != m").select(F.col("m").alias("u"), "v").distinct()
        edges = stage(small, "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    labels = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("label"))
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_groups(df: DataFrame, id_col: str = "id", text_col: str = "content", *, shingle: int = 5, least: float = 0.8, **bands: int) -> DataFrame:
    """``id, group_id, copies, links``: one row for each id with a text of at least ``shingle`` words.

    ``group_id`` is the smallest id of the connected group of near-duplicates, ``copies`` the number of ids with the
    same shingle set, ``links`` the number of other shingle sets within the threshold. Nulls as in ``near_pairs``.
    """
    members, pairs = near_classes(df, id_col, text_col, shingle=shingle, least=least, **bands)
    pairs = stage(pairs, "pairs")
    links = pairs.select(F.col("cls_a").alias("cls")).unionByName(pairs.select(F.col("cls_b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
    sizes = members.groupBy("cls").agg(F.count("*").alias("copies"), F.min("id").alias("rep"))
    labels = components(sizes.select(F.col("cls").alias("node")), pairs.select("cls_a", "cls_b")).withColumnRenamed("node", "cls")
    classes = stage(sizes.join(labels, "cls").join(links, "cls", "left"), "classes")
    names = classes.groupBy("label").agg(F.min("rep").alias("group_id"))
    classes = classes.join(names, "label").select("cls", "group_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(classes, "cls").select("id", "group_id", "copies", "links")
