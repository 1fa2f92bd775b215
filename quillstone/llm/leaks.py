"""Evaluation passages inside training texts: Wu-Manber search for many word sequences at once.

A pattern is ``window`` consecutive words of an item, or all its words if it has fewer.
Patterns of one length m are searched together. A block is two neighbouring words (one
for m = 1). The shift table gives, for each block inside a pattern, how far the text can
move before the block could end a pattern; blocks in no pattern allow m - 1 words. Where
the shift is 0, the block's suffix bucket holds the patterns that end with it, and each
is compared word by word. Words are compared by 64-bit hashes.

All tables are arrays, and a batch of texts is searched in step: texts are laid out in
lanes of at most ``LANE`` window positions, every lane has its own place, and one step
moves all of them by their own shifts.

The items are held-out test sets: their number doesn't grow with the corpus. What is
broadcast is at most ``BROADCAST_BYTES``: a word of an item takes at most
``WORD_BYTES`` in the tables, and items are taken in slices of so many words. Larger
sets are searched in several passes over the corpus, one per slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.words import M1, hashed, mix

WINDOW, BROADCAST_BYTES, LANE = 10, 64 << 20, 256
#: For each word of an item at most: its hash, one pattern (place, bucket key and its begin, item and its begin), one block with its shift.
WORD_BYTES = 64


@dataclass(frozen=True)
class Table:
    """Patterns of one length over the shared array of the items' words."""

    length: int
    block: np.ndarray  # keys of all blocks, ascending
    shift: np.ndarray
    suffix: np.ndarray  # keys of last blocks, ascending
    first: np.ndarray  # where the patterns of each last block begin in ``place``, and their end
    place: np.ndarray  # of a pattern's first word in ``words``
    owner: np.ndarray  # where the items of each pattern begin in ``items``, and their end
    items: np.ndarray

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.block, self.shift, self.suffix, self.first, self.place, self.owner, self.items))


@dataclass(frozen=True)
class Built:
    words: np.ndarray
    tables: tuple[Table, ...]

    def nbytes(self) -> int:
        return self.words.nbytes + sum(t.nbytes() for t in self.tables)


def _blocks(h: np.ndarray) -> np.ndarray:
    """The key of the block that ends at each word; the first word's is its own."""
    key = mix(h * M1 + np.uint64(1))
    key[1:] = mix(key[:-1] * M1 + h[1:] + np.uint64(2))
    return key


def _table(m: int, h: np.ndarray, place: np.ndarray, item: np.ndarray) -> Table:
    whole = np.zeros(len(place), np.uint64)
    for k in range(m):
        whole = mix(whole * M1 + h[place + k] + np.uint64(k + 1))
    order = np.lexsort((item, whole))
    whole, place, item = whole[order], place[order], item[order]
    new = np.append(True, whole[1:] != whole[:-1])
    once = new | np.append(True, item[1:] != item[:-1])
    pattern = np.cumsum(new)[once] - 1
    item, place = item[once], place[new]
    owner = np.searchsorted(pattern, np.arange(len(place) + 1))
    blocks = h if m == 1 else _blocks(h)
    last = blocks[place + m - 1]
    by_last = np.argsort(last, kind="stable")
    suffix, first = np.unique(last[by_last], return_index=True)
    if m == 1:
        block, shift = suffix, np.zeros(len(suffix), np.int16)
    else:
        block, shift = np.zeros(0, np.uint64), np.zeros(0, np.int16)
        for j in range(m - 1, 0, -1):  # from the pattern's end: the first shift a block gets is its least
            fresh = np.setdiff1d(blocks[place + j], block)
            block, shift = np.append(block, fresh), np.append(shift, np.full(len(fresh), m - 1 - j, np.int16))
        order = np.argsort(block)
        block, shift = block[order], shift[order]
    # patterns in the order of their last block, and their items with them
    count = np.diff(owner)[by_last]
    begin = owner[:-1][by_last]
    ends = np.cumsum(count)
    items = item[np.repeat(begin - ends + count, count) + np.arange(ends[-1])]
    return Table(m, block, shift, suffix, np.append(first, len(place)).astype(np.int32), place[by_last].astype(np.int32), np.append(0, ends).astype(np.int32), items)


def build(keys: np.ndarray, h: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> Built:
    """Tables of items, given by their keys, the hashes of all their words and where each item's begin (and the end)."""
    n = np.diff(starts)
    length = np.minimum(n, window)
    tables = []
    for m in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == m)
        count = n[own] - m + 1
        ends = np.cumsum(count)
        place = np.repeat(starts[own] - ends + count, count) + np.arange(ends[-1])
        tables.append(_table(m, h, place, np.repeat(keys[own], count)))
    return Built(h, tuple(tables))


def search(built: Built, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, item)`` for texts given by the hashes of their words and where each text's begin (and the end): items of all patterns that occur, each pair once."""
    texts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n = np.diff(starts)
    blocks = _blocks(h) if len(h) else h
    for t in built.tables:
        m, key = t.length, (h if t.length == 1 else blocks)
        fit = np.flatnonzero(n >= m)
        lanes = -(-(n[fit] - m + 1) // LANE)
        if not len(fit):
            continue
        ends = np.cumsum(lanes)
        text = np.repeat(fit, lanes)
        at = starts[text] + m - 1 + (np.arange(ends[-1]) - np.repeat(ends - lanes, lanes)) * LANE
        stop = np.minimum(at + LANE, starts[text + 1])
        far = max(m - 1, 1)
        while len(at):
            k = np.minimum(np.searchsorted(t.block, key[at]), len(t.block) - 1)
            step = np.where(t.block[k] == key[at], t.shift[k].astype(np.int64), far)
            met = np.flatnonzero(step == 0)
            if len(met):
                step[met] = 1
                s = np.searchsorted(t.suffix, key[at[met]])
                count = t.first[s + 1] - t.first[s]
                ends = np.cumsum(count)
                one = np.repeat(met, count)
                pattern = np.repeat(t.first[s] - ends + count, count) + np.arange(ends[-1])
                for j in range(m):
                    same = h[at[one] - m + 1 + j] == built.words[t.place[pattern] + j]
                    one, pattern = one[same], pattern[same]
                count = t.owner[pattern + 1] - t.owner[pattern]
                if len(count):
                    ends = np.cumsum(count)
                    texts.append(np.repeat(text[one], count))
                    items.append(t.items[np.repeat(t.owner[pattern] - ends + count, count) + np.arange(ends[-1])])
            at = at + step
            live = at < stop
            at, stop, text = at[live], stop[live], text[live]
    found = np.unique(np.stack([np.concatenate(texts), np.concatenate(items)], axis=1), axis=0)
    return found[:, 0], found[:, 1]


def _scan(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, item = search(held.value, *hashed(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(item, pa.int64())], ["doc_id", "item_id"])

    return run


def slices(items: Iterator[tuple[int, str]], window: int, most: int) -> Iterator[Built]:
    """Tables of at most ``most`` bytes each. An item of more words than one holds is cut into parts that share all but one word of a window."""
    limit = max(2 * window, most // WORD_BYTES)
    keys: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def made() -> Built:
        return build(np.array(keys, np.int64), np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts])), window)

    for key, text in items:
        h, _ = hashed([text])
        for at in range(0, max(len(h) - window + 1, 1), limit - window + 1):
            part = h[at : at + limit]
            if held + len(part) > limit and parts:
                yield made()
                keys, parts, held = [], [], 0
            keys.append(key)
            parts.append(part)
            held += len(part)
    if held:
        yield made()


def leaked_items(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, item_id``: documents that hold ``window`` consecutive words of an item, or all words of a shorter item, as consecutive words.

    * Null ids, null texts and items without words take no part; texts shorter than every pattern give no rows.
    * Repeated documents and items count once; an item id with several texts leaks by any of them.
    * Other columns are not read.

    Items come to the driver one at a time; the tables of as many as fit ``broadcast_bytes`` are searched for in one pass.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    held = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item_text")).where("item_id is not null and item_text is not null").distinct()
    found = None
    for built in slices((tuple(row) for row in held.toLocalIterator()), window, broadcast_bytes):
        one = docs.mapInArrow(_scan(spark.sparkContext.broadcast(built)), "doc_id long, item_id long")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.select("doc_id", F.lit(None).cast("long").alias("item_id")).where("false")
    return found.distinct()
