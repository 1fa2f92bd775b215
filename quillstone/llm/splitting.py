"""Cutting texts that are too large at natural boundaries.

Sizes are bytes of UTF-8. A text is cut at positions chosen by dynamic programming over
its boundaries: after a blank line, after a line end, after the end of a sentence, after
white space, and, only where a stretch of ``limit`` bytes has none of them, between two
characters. The cost of a cut rises with the kind of boundary; the cost of a piece is the
square of its distance from the even size. Each piece repeats up to ``overlap`` bytes of
the end of the one before, starting at a boundary too, and counts them in its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 800, 100
MARGIN = " \t\r\n"
#: Kinds of boundary, best first, and what a cut there costs; a piece that is off the even size by all of the limit costs 1.
_KINDS = ((re.compile(rb"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*"), 0.0), (re.compile(rb"\r\n|\n|\r"), 0.12), (re.compile("[.!?…。！？][\"'»”’)\\]]*[ \t]+".encode()), 0.3), (re.compile(rb"[ \t\x0b\x0c]+"), 0.7))
_HARD = 3.0


def boundaries(data: bytes, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a piece may end, ascending, the end of the text last, and the costs of cutting there."""
    cost: dict[int, float] = {}
    for pattern, price in reversed(_KINDS):
        for m in pattern.finditer(data):
            cost[m.end()] = price
    cost.pop(0, None)
    cost[len(data)] = 0.0
    at = sorted(cost)
    out: list[int] = []
    last = 0
    reach = max(limit // 2, min(limit, 4))  # so that overlap and a stretch between boundaries fit a piece together, and any character fits
    for p in at:
        while p - last > reach:
            cut = last + reach
            while cut > last + 1 and data[cut] & 0xC0 == 0x80:
                cut -= 1
            if data[cut] & 0xC0 == 0x80:  # no character starts there: bytes that aren't UTF-8, or a limit below four
                cut = last + reach
            cost[cut] = _HARD
            out.append(cut)
            last = cut
        out.append(p)
        last = p
    return np.array(out, dtype=np.int64), np.array([cost[p] for p in out])


def cut(data: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces as (start, end, repeated bytes): each at most ``limit`` long; without the repeated bytes they are the text."""
    n = len(data)
    if n <= limit:
        return [(0, n, 0)] if n else []
    pos, price = boundaries(data, limit)
    starts = np.concatenate([[0], pos])
    # where a piece that follows a cut at starts[i] begins: the first boundary within the overlap
    back = starts[np.searchsorted(starts, starts - overlap, side="left")]
    back[0] = 0
    soft = np.concatenate([[0.0], price]) < _HARD
    if not soft.all():  # between hard cuts, repeat as many whole characters as fit
        for i in range(1, len(starts)):
            if back[i] == starts[i]:
                b = max(0, int(starts[i]) - overlap)
                while b < starts[i] and data[b] & 0xC0 == 0x80:
                    b += 1
                back[i] = b
    even = n / np.ceil((n - overlap) / max(limit - overlap, 1))
    best = np.full(len(starts), np.inf)
    come = np.full(len(starts), -1, np.int64)
    best[0] = 0.0
    first = np.searchsorted(back, starts - limit, side="left")
    for j in range(1, len(starts)):
        i = np.arange(min(first[j], j - 1), j)
        i = i[(starts[j] - back[i] <= limit)]
        if not len(i):
            i = np.array([j - 1])
            back[j - 1] = starts[j - 1]
        total = best[i] + ((starts[j] - back[i] - even) / limit) ** 2 + (price[j - 1] if starts[j] < n else 0.0)
        k = int(np.argmin(total))
        best[j], come[j] = total[k], i[k]
    out, j = [], len(starts) - 1
    while j > 0:
        i = int(come[j])
        out.append((int(back[i]), int(starts[j]), int(starts[i] - back[i])))
        j = i
    return out[::-1]


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                parts = cut(data, limit, overlap)
                rows += [(key, k, len(parts), data[a:b].decode("utf-8", "replace"), a, r) for k, (a, b, r) in enumerate(parts)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32()))], ["id", "piece", "pieces", "content", "start_byte", "repeated"])

    return run


def oversized_pieces(df: DataFrame, id_col: str = "id", text_col: str = "content", *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``id, piece, pieces, content, start_byte, repeated``: the pieces of every text longer than ``limit`` bytes.

    Texts are taken without leading and trailing spaces, tabs, carriage returns and line feeds; ``start_byte`` counts
    from there. Other texts, null texts and null ids give no rows. An id that is repeated with the same text is cut
    once; one with several texts is cut for each. Dropping the first ``repeated`` bytes of each piece and joining the
    rest gives the text again.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.btrim(F.col(text_col).cast("string"), F.lit(MARGIN)).alias("content"))
    rows = rows.where(F.col("id").isNotNull() & (F.octet_length("content") > limit)).dropDuplicates(["id", "content"])
    return rows.mapInArrow(_pieces(limit, overlap), "id string, piece int, pieces int, content string, start_byte long, repeated int")


def replaced(df: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Drawers with the oversized ones replaced: ``id, source_file, chunk_index, piece, pieces, content``.

    ``chunk_index`` runs from 0 within a ``source_file`` (back slashes read as slashes), in the order of the old index,
    then id, then piece. Drawers without a source file run by id. Each id counts once, with its first content in
    text order; null ids are left out and a null content stays one row. The running number is a sum over three levels,
    so a file that holds a third of all rows is not one task's group.
    """
    one = df.where("id is not null").groupBy("id").agg(F.min(F.struct(F.col("content").isNull(), "content", "source_file", "chunk_index")).alias("r")).select("id", "r.content", "r.source_file", "r.chunk_index")
    small = one.where(F.coalesce(F.octet_length(F.btrim("content", F.lit(MARGIN))), F.lit(0)) <= limit)
    cuts = oversized_pieces(one, limit=limit, overlap=overlap).select("id", "piece", "pieces", "content")
    pieces = small.select("id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), "content").unionByName(cuts)
    order = one.select("id", F.coalesce(F.translate("source_file", "\\", "/"), F.concat(F.lit("\0"), "id")).alias("file"), F.coalesce("chunk_index", F.lit(-1)).alias("old"), F.col("source_file"))
    counts = order.join(pieces.where("piece = 0").select("id", "pieces"), "id").withColumn("block", F.floor(F.col("old") / 1024)).withColumn("salt", F.conv(F.substring(F.md5("id"), 1, 1), 16, 10).cast("int"))

    def running(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
        return rows.withColumn("before", F.sum("pieces").over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0)))

    l1 = running(counts.groupBy("file", "block").agg(F.sum("pieces").alias("pieces")), ["file"], ["block"]).select("file", "block", F.col("before").alias("b1"))
    l2 = running(counts.groupBy("file", "block", "old", "salt").agg(F.sum("pieces").alias("pieces")), ["file", "block"], ["old", "salt"]).select("file", "block", "old", "salt", F.col("before").alias("b2"))
    l3 = running(counts, ["file", "block", "old", "salt"], ["id"])
    start = l3.join(l2, ["file", "block", "old", "salt"]).join(l1, ["file", "block"]).select("id", "source_file", (F.col("before") + F.col("b1") + F.col("b2")).alias("base"))
    return pieces.join(start, "id").select("id", "source_file", (F.col("base") + F.col("piece")).alias("chunk_index"), "piece", "pieces", "content")


def rejoined(pieces: DataFrame) -> DataFrame:
    """``id, content``: the texts again that ``oversized_pieces`` cut, one for each different text of an id. For checks; a text is put together in one task."""
    whole = F.col("repeated") == 0
    fresh = F.when(whole, F.col("content")).otherwise(F.decode(F.expr("substring(encode(content, 'UTF-8'), repeated + 1)"), "UTF-8"))
    parts = pieces.groupBy("id", "pieces").agg(F.array_sort(F.collect_list(F.struct("piece", fresh.alias("t")))).alias("p"))
    return parts.select("id", F.array_join("p.t", "").alias("content"))


def audit(pieces: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row for each id: its number of pieces, and how many are too long, repeat too much, are out of order or begin or end inside a word though a blank stood near.

    ``torn`` counts pieces that neither end the text nor end in white space, although the last ``limit // 2`` bytes of
    the piece hold white space.
    """
    size = F.octet_length("content")
    torn = (F.col("piece") < F.col("pieces") - 1) & ~F.col("content").rlike(r"\s\z") & F.right("content", F.lit(limit // 2 // 4)).rlike(r"[ \t\r\n]")
    return pieces.groupBy("id").agg(
        F.count_if((size > limit) | (size == 0)).alias("long"), F.count_if((F.col("repeated") > overlap) | (F.col("repeated") > size)).alias("repeating"), F.count_if(torn).alias("torn"), (F.max("pieces") - F.countDistinct("piece")).cast("long").alias("missing")
    )
