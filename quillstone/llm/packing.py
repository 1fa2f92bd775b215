"""Filling containers of a fixed number of tokens: best fit with capacities in several dimensions.

A container has three capacities: tokens, documents, and attention cost (the sum of the
squared lengths, which is what attention within documents costs). Items go in from the
longest to the shortest. Of the open containers that keep within every capacity, the one
is chosen whose residual capacities, each as a share of the whole, have the smallest
weighted norm after the item is in; none fitting, a new one opens.

Items are dealt to shards by hash, so that no task packs more than about ``shard_items``
of them, whatever the input. Only ids and lengths are shuffled, never texts. A shard
leaves at most its last few containers unfilled, out of thousands.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, DOCUMENTS, SHARD_ITEMS = 2048, 64, 20_000
WEIGHTS = (1.0, 0.02, 0.02)
#: Fixed value: how byte-level BPE of 50k ids cuts a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public tokenizer's file."""
    return f"/opt/tokenizers/{name}"


def encoder(path: str):
    """A tiktoken encoding from a file of base64 tokens and ranks."""
    import tiktoken

    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding("given", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


_LONE = re.compile("[\ud800-\udfff]")
#: White space in runs that the splitting pattern's look-ahead can't get over; what it would cut of them is one piece.
_RUN = re.compile("[ \t\n\r\f\v\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{500,}")


def count_tokens(enc, text: str) -> int:
    """How many tokens a text has. Half characters, which UTF-8 can't hold, count as replacement characters."""
    text, at, n = _LONE.sub("\ufffd", text), 0, 0
    for run in _RUN.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1  # the last sign goes with the word behind it
        n += len(enc.encode_ordinary(text[at : run.start()])) + len(enc._encode_single_piece(text[run.start() : stop]))
        at = stop
    return n + len(enc.encode_ordinary(text[at:]))


def _lengths(vocabulary_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path)
        for batch in batches:
            n = [count_tokens(enc, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_lengths(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", *, vocabulary_path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens``: one row for each id. Null ids are left out; a null or empty text has no tokens; of an id with several texts the longest in tokens counts."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    counted = rows.mapInArrow(_lengths(vocabulary_path or vocabulary()), "doc_id long, n_tokens long")
    return counted.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def best_fit(lengths: np.ndarray, capacity: int, documents: int, cost: float, weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Container and position of each item. ``lengths`` descend and are at most ``capacity``. An item alone may exceed ``cost``."""
    n = len(lengths)
    bins, place = np.empty(n, np.int64), np.empty(n, np.int64)
    room = np.empty(n, np.float64)  # of open containers: tokens, documents, attention cost left
    docs, att = np.empty(n, np.float64), np.empty(n, np.float64)
    name, held = np.empty(n, np.int64), np.zeros(n, np.int64)
    live = made = 0
    wt, wd, wa = weights[0] / capacity**2, weights[1] / documents**2, weights[2] / cost**2
    least = float(lengths[-1]) if n else 0.0
    for i in range(n):
        size = float(lengths[i])
        square = size * size
        r, d, a = room[:live], docs[:live], att[:live]
        ok = (r >= size) & (a >= square)
        at = -1
        if ok.any():
            after = np.where(ok, wt * (r - size) ** 2 + wd * (d - 1) ** 2 + wa * (a - square) ** 2, np.inf)
            at = int(after.argmin())
        if at < 0:
            at = live
            room[at], docs[at], att[at], name[at] = capacity, documents, max(cost, square), made
            live += 1
            made += 1
        bins[i], place[i] = name[at], held[name[at]]
        held[name[at]] += 1
        room[at] -= size
        docs[at] -= 1
        att[at] -= square
        if room[at] < least or docs[at] < 1 or att[at] < least * least:  # nothing that is still to come fits
            live -= 1
            for x in (room, docs, att, name):
                x[at] = x[live]
    return bins, place


def pack(items: DataFrame, *, capacity: int = CAPACITY, documents: int = DOCUMENTS, cost: float | None = None, shard_items: int = SHARD_ITEMS, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Place items ``doc_id, n_tokens``: ``container, position, doc_id, piece, first_token, n_tokens``.

    An item longer than ``capacity`` is cut into full pieces and a rest, numbered by ``piece``; every other one stays
    whole. Items without tokens take no space: they get a row without a container and position. So does a null length; a
    null id gets none. Ids are expected once. ``container`` is a text, ``shard-number``. ``cost`` bounds the sum of
    squared lengths of containers of several documents; unset, it is what one full piece costs, which then never binds
    but still weighs.
    """
    cost = float(cost or capacity * capacity)
    given = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n")).where("doc_id is not null")
    rows = given.where("n > 0")
    cuts = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity)))
    parts = rows.select("doc_id", "n", cuts.alias("piece")).select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("first_token"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("n_tokens"))
    total = rows.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_items))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, place = best_fit(pdf.n_tokens.to_numpy(), capacity, documents, cost, weights)
        shard = int(pdf.shard.iloc[0])
        pdf["container"], pdf["position"] = [f"{shard}-{b}" for b in bins.tolist()], place.astype("int32")
        return pdf[["container", "position", "doc_id", "piece", "first_token", "n_tokens"]]

    none = given.where("n <= 0").selectExpr("cast(null as string) as container", "cast(null as int) as position", "doc_id", "0 as piece", "0L as first_token", "0L as n_tokens")
    return parts.groupBy("shard").applyInPandas(one, "container string, position int, doc_id long, piece int, first_token long, n_tokens long").unionByName(none)


def audit(placed: DataFrame, items: DataFrame, *, capacity: int = CAPACITY, documents: int = DOCUMENTS, cost: float | None = None) -> DataFrame:
    """One row on what ``pack`` made of the items: how many documents have a row, and how much is wrong.

    ``overfull, crowded, costly`` count containers beyond a capacity (of cost: only those of several documents), ``gaps``
    those whose positions aren't 0, 1, ...; ``cut`` counts documents that were split though they fit, ``lost`` those
    whose pieces don't make up all their tokens in order. ``full`` says whether containers hold 99 % of what they could
    together, all but the last of each shard aside; it is only expected where tokens are the capacity that binds.
    """
    each = placed.where("container is not null").groupBy("container").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"), F.sum(F.col("n_tokens").cast("double") ** 2).alias("cost"), F.max("position").alias("last"), F.countDistinct("position").alias("places")
    )
    most = float(cost or capacity * capacity)
    bins = each.agg(
        F.count_if(F.col("tokens") > capacity).alias("overfull"), F.count_if(F.col("n") > documents).alias("crowded"), F.count_if((F.col("n") > 1) & (F.col("cost") > most + 0.5)).alias("costly"), F.count_if((F.col("last") + 1 != F.col("n")) | (F.col("places") != F.col("n"))).alias("gaps"),
        F.count("*").alias("containers"), F.countDistinct(F.substring_index("container", "-", 1)).alias("shards"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )
    parts = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("got"), F.max("piece").alias("last"), F.count_if(F.col("first_token") != F.col("piece").cast("long") * capacity).alias("moved"))
    docs = items.where("doc_id is not null").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n")).join(parts, "doc_id", "full")
    docs = docs.agg(F.count("pieces").alias("documents"), F.count_if((F.col("n") <= capacity) & (F.col("pieces") > 1)).alias("cut"), F.count_if(~F.coalesce((F.col("n") == F.col("got")) & (F.col("last") + 1 == F.col("pieces")) & (F.col("moved") == 0), F.lit(False))).alias("lost"))
    full = F.col("tokens") >= 0.99 * capacity * (F.col("containers") - 2 * F.col("shards"))
    return docs.crossJoin(bins).select("documents", "cut", "lost", "overfull", "crowded", "costly", "gaps", full.alias("full"))  # two single rows
