"""The k most similar vectors of every vector, from a hash-prefix forest.

Each tree gives a vector a long hash string: for one random rotation after the other, the
coordinate that is largest, and its sign (a cross-polytope hash), as bits. A tree is the
sorted array of these strings. The rows that share a prefix with a row stand around it,
fewer the longer the prefix is.

All trees of a row ascend in step. The first pass sorts the strings alone and notes, for
each row and tree, at which prefix length how many rows (by powers of two) share it. Per
row these profiles of all trees meet, and the longest prefix length is found at which the
rows that share it, in all trees together, are ``candidates`` or more. In dense regions
that is a long prefix, in sparse ones a short one; trees in which the row happens to have
close company give more candidates than others. The second pass sorts strings with
vectors. In each tree a row is compared with all rows that share a longer prefix than that,
and with the nearest of those that share just as much until the number is reached.

The second pass holds a byte for each element and keeps somewhat more than k rows; cosines
of what is kept are computed from the vectors as they are.

A tree is a range partitioning into parts of about ``partition_rows`` rows, so no node of
it is ever one task's group: a region that holds a third of all rows, even a third of all
rows with the same vector (a hash of the id breaks ties in the order), covers many parts.
Rows near a part's edge see one side only in this tree; the edges differ from tree to tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES, CANDIDATES, LENGTH, STEPS, BLOCK, SEED = 8, 1500, 48, 24, 256, 20240229
PARTITION_ROWS = 100_000
#: How far a cosine of vectors of one byte an element may be off (their rounding gives a standard deviation of 0.001), and how many rows beyond k are kept for that.
SLACK, MORE = 8e-3, 5


def usable(vec: str, dim: int) -> F.Column:
    """Not null, of ``dim`` elements, all finite and not all zero."""
    v = F.col(vec)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return (F.size(v) == dim) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * x.itemsize * x.shape[1]).astype(np.int32)), pa.py_buffer(x)])


def coded(x: np.ndarray) -> np.ndarray:
    """Unit vectors with a byte for each element; the length is lost."""
    return np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)


def decoded(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _rotations(dim: int, trees: int, seed: int) -> np.ndarray:
    """(tree, symbol, dim, dim): as many rotations a tree as their symbols fit ``LENGTH`` bits."""
    width = max(1, int(np.ceil(np.log2(2 * dim))))
    rng = np.random.default_rng(seed)
    return np.stack([[np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(max(1, LENGTH // width))] for _ in range(trees)]).astype(np.float32)


def strings(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """The hash strings of unit vectors in one tree, as whole numbers of ``LENGTH`` bits, the tree's first symbol leading."""
    dim = x.shape[1]
    width = max(1, int(np.ceil(np.log2(2 * dim))))
    out, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for r in rotations:
        y = x @ r
        i = np.abs(y).argmax(axis=1)
        out = out << width | (2 * i + (y[rows, i] > 0))
    return out << (LENGTH - width * len(rotations))


def _vectors(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(x), batch.column(3)], ["h", "id", "vec", "asks"])

    return run


def _hash_rows(dim: int, trees: int, seed: int):
    """Rows ``h, vec, asks`` to ``key, h, asks`` for every tree; the key is the tree's number before the string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations = _rotations(dim, trees, seed)
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(1), dim)).astype(np.float32)
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(strings(x, rotations[t]) | t << LENGTH), batch.column(0), batch.column(2)], ["key", "h", "asks"])

    return run


def _hash_vectors(dim: int, trees: int, seed: int):
    """Rows ``h, vec, stop, rest`` to ``key, h, stop, rest, vec`` for every tree, vectors of unit length as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations = _rotations(dim, trees, seed)
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(1), dim)).astype(np.float32)
                codes = _binary(coded(x))
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(strings(x, rotations[t]) | t << LENGTH), batch.column(0), batch.column(2), batch.column(3), codes], ["key", "h", "stop", "rest", "vec"])

    return run


def profiles(key: np.ndarray) -> np.ndarray:
    """For each row of a sorted array and each j: the greatest prefix length that at least 2**j rows of its tree share with it, itself counted; -1 where none does."""
    n = len(key)
    out = np.full((n, STEPS), -1, np.int8)
    level = np.full(n, -1)
    for d in range(LENGTH, -1, -1):
        p = key >> (LENGTH - d)
        edge = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        size = np.diff(np.append(edge, n))
        now = np.minimum(np.repeat(np.frexp(size.astype(np.float64))[1] - 1, size), STEPS - 1)
        for j in range(int(now.max(initial=-1)) + 1):
            fresh = (level < j) & (now >= j)
            out[fresh, j] = d
        level = np.maximum(level, now)
        if d and level.min(initial=STEPS) >= STEPS - 1:
            break
    return out


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    asks = table["asks"].to_numpy()
    found = profiles(table["key"].to_numpy())[asks]
    yield pa.RecordBatch.from_arrays([table["h"].filter(pa.array(asks)).combine_chunks(), _binary(found)], ["h", "profile"])


def ascent(found: np.ndarray, candidates: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the ascent of each row ends: ``(stop, rest)`` from profiles (row, tree, step).

    Rows that share more than ``stop`` bits are all taken; of those that share ``stop`` bits, ``rest`` to either side in
    each tree. ``stop`` is -1 where all rows of all trees are fewer than ``candidates``.
    """
    rows, trees, _ = found.shape
    stop, rest = np.full(rows, -1), np.zeros(rows, np.int64)
    before = np.zeros(rows)
    for d in range(LENGTH, -1, -1):
        steps = (found >= d).sum(axis=2)
        there = np.where(steps > 0, 1.5 * 2.0 ** (steps - 1), 0).sum(axis=1)  # a count lies between a power of two and the next
        ends = (stop < 0) & (there >= candidates)
        stop[ends] = d
        rest[ends] = np.ceil((candidates - before[ends]) / (2 * trees))
        before = there
    return stop, rest


def _ends(candidates: int):
    def run(found: pd.Series) -> pd.DataFrame:
        sizes = found.map(len).to_numpy()
        out = np.zeros((len(found), 2), np.int64)
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            held = np.frombuffer(b"".join(b for i in own for b in found.iloc[i]), np.int8).reshape(len(own), n, STEPS)
            out[own] = np.stack(ascent(held, candidates), axis=1)
        return pd.DataFrame({"stop": out[:, 0].astype(np.int32), "rest": out[:, 1].astype(np.int32)})

    return run


def ranges(key: np.ndarray, own: np.ndarray, stop: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first, end)`` in the sorted array of what each of the rows ``own`` is compared with."""

    def shared(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        down = (LENGTH - np.clip(bits, 0, LENGTH)).astype(np.int64)
        p = key[own] >> down
        first, end = np.searchsorted(key, p << down), np.searchsorted(key, (p + 1) << down)
        return np.where(bits > LENGTH, own, first), np.where(bits > LENGTH, own + 1, end)

    first, end = shared(stop + 1)
    most_first, most_end = shared(stop)
    return np.maximum(most_first, first - rest), np.minimum(most_end, end + rest)


def _scan(dim: int, keep: int, least: float):
    schema = pa.schema([("h", pa.int64()), ("other", pa.int64()), ("about", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        key, h = table["key"].to_numpy(), table["h"].to_numpy()
        codes = _matrix(table["vec"], dim, np.int8)
        # a row delivered again stands next to its first copy
        fresh = np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]) | (codes[1:] != codes[:-1]).any(axis=1))
        key, h, x = key[fresh], h[fresh], decoded(codes[fresh])
        stop, rest = (table[c].fill_null(-2).to_numpy()[fresh] for c in ("stop", "rest"))
        asking = np.flatnonzero(stop > -2)
        first, end = ranges(key, asking, stop[asking], rest[asking])
        tree = np.flatnonzero(np.append(True, np.diff(key[asking] >> LENGTH) != 0)) if len(asking) else []
        blocks = [np.arange(at, min(at + BLOCK, until)) for begin, until in zip(tree, np.append(tree, len(asking))[1:]) for at in range(begin, until, BLOCK)]
        for block in blocks:
            groups = [block]
            if int(end[block].max() - first[block].min()) > 64 * BLOCK and len(block) > 8:  # wide ranges: fewer rows at a time
                groups = np.array_split(block, -(-len(block) // 8))
            for g in groups:
                own, a, b = asking[g], int(first[g].min()), int(end[g].max())
                near = x[own] @ x[a:b].T
                near[h[own, None] == h[None, a:b]] = -3
                rows = np.flatnonzero((near >= least).any(axis=1))
                near = near[rows]
                take = min(keep, near.shape[1])
                best = np.argpartition(near, near.shape[1] - take, axis=1)[:, near.shape[1] - take :]
                about = np.take_along_axis(near, best, 1).ravel()
                fine = about >= max(least, -2)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h[own[rows]], take)[fine]), pa.array(h[a:b][best.ravel()][fine]), pa.array(about[fine])], schema=schema)

    return run


def _exact(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _unit(_matrix(batch.column(2), dim)), _unit(_matrix(batch.column(3), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.clip(np.einsum("ij,ij->i", a, b), -1.0, 1.0))], ["id", "neighbour", "cosine"])

    return run


def most_similar(
    df: DataFrame, id_col: str = "id", vec_col: str = "embedding", *, dim: int = 64, k: int = 5, min_cosine: float = -1.0, trees: int = TREES, candidates: int = CANDIDATES, share: float = 0.0, seed: int = SEED, queries: Column | None = None, partition_rows: int = PARTITION_ROWS
) -> DataFrame:
    """``id, neighbour, cosine, rank``: the k rows with the highest cosine for every row that has a usable vector.

    * A vector that is null, not of ``dim`` elements, all zero or not finite takes no part; neither does a null id.
    * A repeated row counts once. An id with several vectors has the neighbours of all of them; it is never its own.
    * ``queries``, a condition on the input's columns, asks for the neighbours of the rows where it holds only; all rows
      are searched.
    * ``candidates`` is the number of rows that each row is compared with, in all trees together; where ``share`` of all
      rows is more, that. The share of true neighbours found grows with it and with ``trees``. Where there are fewer
      rows in all trees than that, the search is exhaustive, but for parts' edges.
    * ``partition_rows`` is the number of rows of a tree that one task holds.
    * ``min_cosine`` leaves out neighbours below it; the ranks of the others stay what they are.
    * Equal cosines rank by the smaller neighbour id among the candidates; which members of a tie wider than
      ``candidates`` are candidates is not fixed.
    * Other columns are not read; an empty input gives no rows.

    Approximate in which rows are compared; cosines are exact.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("v"), F.coalesce(F.lit(True) if queries is None else queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable("v", dim))
    base = rows.select(F.xxhash64("id").alias("h"), "id", "v", "asks").mapInArrow(_vectors(dim), "h long, id string, vec binary, asks boolean")
    total = df.count()
    wanted, parts = max(candidates, int(share * total)), max(1, -(-total * trees // partition_rows))
    narrow = base.select("h", "vec", "asks").mapInArrow(_hash_rows(dim, trees, seed), "key long, h long, asks boolean")
    narrow = narrow.repartitionByRange(max(1, -(-parts // 4)), "key", "h").sortWithinPartitions("key").mapInArrow(_profile, "h long, profile binary")
    ends = narrow.groupBy("h").agg(F.collect_list("profile").alias("p"))  # one of each tree
    ends = ends.select("h", F.pandas_udf(_ends(wanted), "stop int, rest int")("p").alias("e")).select("h", "e.stop", "e.rest")
    wide = base.select("h", "vec").join(ends, "h", "left").mapInArrow(_hash_vectors(dim, trees, seed), "key long, h long, stop int, rest int, vec binary")
    least = min_cosine - SLACK
    found = wide.repartitionByRange(parts, "key", "h").sortWithinPartitions("key", "h").mapInArrow(_scan(dim, k + MORE, least), "h long, other long, about float")
    pairs = found.groupBy("h", "other").agg(F.max("about").alias("about"))
    nearest = Window.partitionBy("h").orderBy(F.desc("about"), "other")
    pairs = pairs.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + MORE).select("h", "other")
    own = base.select("h", "id", F.col("vec").alias("a"))
    other = base.select(F.col("h").alias("other"), F.col("id").alias("neighbour"), F.col("vec").alias("b"))
    exact = pairs.join(other, "other").join(own, "h").where("id != neighbour").select("id", "neighbour", "a", "b").mapInArrow(_exact(dim), "id string, neighbour string, cosine double")
    exact = exact.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine")).where(F.col("cosine") >= min_cosine)
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def links(neighbours: DataFrame) -> DataFrame:
    """``id_a, id_b`` (``id_a`` < ``id_b``): pairs in which at least one is a neighbour of the other, once."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
