"""Records of evaluation splits that occur again in the training split: an exact bipartite similarity join.

Words of every record are ordered by how many records hold them, rarest first. Two sets
with intersection / union of at least ``least`` share words among the first few of each:
prefixes of the evaluation side are indexed, prefixes of the training side probe them,
lengths, positions and bits of the sets rule out pairs, and what is left is compared word
by word (by 64-bit hashes). Records with equal sets are one class on each side, so a text
that is a third of all rows is joined once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.words import M1, mix
from quillstone.plans.staging import stage

WORD = "[\\p{L}\\p{N}]+"
EVALUATION, WHOLE, PAIRED = ("dev", "held_out"), 50, 64
#: So many different words' counts are broadcast at most.
VOCABULARY = 2_000_000


def word_set(text: F.Column) -> F.Column:
    """The distinct words, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))))


def split_name(split: F.Column) -> F.Column:
    return F.lower(F.regexp_replace(split, r"^\s+|\s+$", ""))


def exploded_queries(corpus: DataFrame) -> DataFrame:
    """``query_id, text, split, domain, source_file``: a row for every query as delivered. What repeats is taken once by its words, later, so that no text is shuffled."""
    q = corpus.select("domain", "source_file", F.explode("queries").alias("q"))
    return q.select(F.col("q.id").alias("query_id"), F.col("q.text").alias("text"), split_name(F.col("q.split")).alias("split"), "domain", "source_file")


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat))


def _parts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of lists, and each list's length."""
    return lists.flatten().to_numpy(), np.asarray(lists.value_lengths())


def _by_rarity(held):
    """Orders the words of each set by how often they occur, rarest first, and equal ones by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, often = held.value
        for batch in batches:
            flat, size = _parts(batch.column(2))
            order = np.lexsort((flat, often[np.searchsorted(word, flat)], np.repeat(np.arange(len(size)), size)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(flat[order], size)], ["side", "cls", "w"])

    return run


def _ordered(classes: DataFrame, vocabulary: int) -> DataFrame:
    """``side, cls, w``: the sets with their words by rarity over all records of both sides.

    Counts of up to ``vocabulary`` different words, found out without taking more, are broadcast (16 bytes each); of a
    larger vocabulary they are joined. The order is the same.
    """
    counts = classes.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("often"))
    few = counts.limit(vocabulary + 1).toArrow()
    if few.num_rows <= vocabulary:
        word, often = few["word"].to_numpy(), few["often"].to_numpy()
        order = np.argsort(word)
        held = classes.sparkSession.sparkContext.broadcast((word[order], often[order]))
        return classes.select("side", "cls", "words").mapInArrow(_by_rarity(held), "side string, cls binary, w array<long>")
    rows = classes.select("side", "cls", F.explode("words").alias("word")).join(counts, "word")
    return rows.groupBy("side", "cls").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("w")).select("side", "cls", F.col("w.word").alias("w"))


def _keyed(least: float):
    """Rows ``side, cls, w`` to ``side, cls, n, b0, b1, pos, key``; see ``_keys``."""
    names = ["side", "cls", "n", "b0", "b1", "pos", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = _parts(batch.column(2))
            if not len(flat):
                continue
            w = flat.view(np.uint64)
            begin = np.cumsum(n) - n
            place = mix(w * M1) & np.uint64(127)
            bit = np.uint64(1) << (place & np.uint64(63))
            b0, b1 = (np.bitwise_or.reduceat(np.where((place >> np.uint64(6)) == half, bit, np.uint64(0)), begin).view(np.int64) for half in (0, 1))
            most = np.ceil(least * n - 1e-9).astype(np.int64)
            plain, smallest = n - most, np.ceil(least / (1 + least) * (n + most) - 1e-9)
            rows, places, keys = [], [], []

            def add(own: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
                rows.append(np.repeat(own, len(at)))
                places.append(np.tile(at, len(own)))
                keys.append(key.ravel())

            single = (n >= PAIRED * least) | (smallest < 2)
            for p in np.unique(plain[single]).tolist():
                own = np.flatnonzero(single & (plain == p))
                at = np.arange(p + 1)
                add(own, at, w[begin[own, None] + at])
            paired, size = (n <= PAIRED) & (n >= 2), np.minimum(plain + 2, n)
            for p in np.unique(size[paired]).tolist():
                own = np.flatnonzero(paired & (size == p))
                i, j = np.triu_indices(p, 1)
                add(own, i, mix(w[begin[own, None] + i] * M1 + mix(w[begin[own, None] + j])))
            r = np.concatenate(rows)
            columns = [batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r)), pa.array(n[r].astype(np.int32)), pa.array(b0[r]), pa.array(b1[r]), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _keys(classes: DataFrame, least: float, vocabulary: int) -> DataFrame:
    """``side, cls, n, b0, b1, pos, key``: what two similar classes are sure to share at least once, and where its first word stands.

    With ``k`` more words than the plain prefix has (``n - ceil(least * n) + k``), two sets that need an overlap of
    ``k`` share ``k`` prefix words. Keys are the pairs of such words for sets of up to ``PAIRED`` words: two words are
    far rarer together than apart, and a fixed vocabulary makes single words as frequent as the table is long. Larger
    sets have rare words of their own; their keys, and those of sets that need an overlap of one only, are single
    words. A set near the limit has both, since its partner may be on the other side of it. ``b0, b1`` hold a bit for
    every word's hash: two sets differ in as many words as their bits, or more.
    """
    return _ordered(classes, vocabulary).mapInArrow(_keyed(least), "side string, cls binary, n int, b0 long, b1 long, pos int, key long")


def similar_classes(classes: DataFrame, least: float, vocabulary: int = VOCABULARY) -> DataFrame:
    """``cls_a, cls_b, similarity`` between the classes of side ``train`` and of side ``eval``.

    Keys are hashes: equal ones only propose a pair. Lengths, positions and the bits of the sets, which bound what two
    sets can share, end nearly all pairs inside the join; the words of the others are compared.
    """
    keys = stage(_keys(classes, least, vocabulary), "keys")  # both sides come from it
    columns = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "pos", "b0", "b1")]
    a, b = keys.where("side = 'train'").select("key", *columns("a")), keys.where("side = 'eval'").select("key", *columns("b"))
    t, both = F.lit(least), F.col("n_a") + F.col("n_b")
    length = (F.col("n_a") >= t * F.col("n_b") - 1e-9) & (F.col("n_b") >= t * F.col("n_a") - 1e-9)
    # no more can be shared than all before the first common word, and all behind it
    need = F.ceil(t / (1 + t) * both - 1e-9)
    most = F.least("pos_a", "pos_b") + 1 + F.least(F.col("n_a") - F.col("pos_a") - 1, F.col("n_b") - F.col("pos_b") - 1)
    differ = F.bit_count(F.col("b0_a").bitwiseXOR(F.col("b0_b"))) + F.bit_count(F.col("b1_a").bitwiseXOR(F.col("b1_b")))
    met = a.join(b, (a.key == b.key) & length & (most >= need) & (differ <= both - 2 * need)).select("cls_a", "cls_b").distinct()
    words = classes.select("side", "cls", "words")
    met = met.join(words.where("side = 'train'").select(F.col("cls").alias("cls_a"), F.col("words").alias("words_a")), "cls_a")
    met = met.join(words.where("side = 'eval'").select(F.col("cls").alias("cls_b"), F.col("words").alias("words_b")), "cls_b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    found = met.select("cls_a", "cls_b", (shared / (F.size("words_a") + F.size("words_b") - shared)).alias("similarity"))
    return found.where(F.col("similarity") >= least)


def _classes(queries: DataFrame, least: float, train: str, evaluation: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Members ``query_id, side, cls`` of classes of equal word sets, and pairs ``cls_a, cls_b, similarity`` of classes of the two sides."""
    side = F.when(F.col("split") == train, "train").when(F.col("split").isin(*evaluation), "eval")
    rows = queries.select(F.col("query_id").cast("string").alias("query_id"), side.alias("side"), word_set(F.col("text")).alias("words"))
    rows = rows.where(F.col("query_id").isNotNull() & F.col("side").isNotNull() & (F.size("words") > 0))
    members = rows.select("query_id", "side", F.unhex(F.md5(F.concat_ws(" ", "words"))).alias("cls"), F.transform("words", lambda x: F.xxhash64(x)).alias("words"))
    members = stage(members, "queries")
    classes = members.groupBy("side", "cls").agg(F.first("words").alias("words"))
    return members.select("query_id", "side", "cls").distinct(), similar_classes(classes, least)


def cross_split(queries: DataFrame, *, least: float = 0.8, train: str = "train", evaluation: tuple[str, ...] = EVALUATION, whole: int = WHOLE) -> DataFrame:
    """``query_id_a, query_id_b`` (the smaller first): a query of the training split and one of an evaluation split whose word sets have intersection / union of at least ``least``.

    * Split names are trimmed and lower-cased; a null split belongs to none. Null ids, null texts and texts without
      words take no part. A query is never paired with itself; one that is in both kinds of split is in pairs of either.
    * Queries with equal word sets form a class on their side. Where the two classes of a pair have more than ``whole``
      squared pairs, the smallest id of each side stands for it and every other member is paired with the other side's;
      ``cross_groups`` has the class of every query, whatever its size.
    * Repeated rows count once; an empty input gives no rows.
    """
    members, pairs = _classes(queries, least, train, evaluation)
    sizes = members.groupBy("side", "cls").agg(F.count("*").alias("n"), F.min("query_id").alias("rep"))
    size_a = sizes.where("side = 'train'").select(F.col("cls").alias("cls_a"), F.col("n").alias("m_a"), F.col("rep").alias("rep_a"))
    size_b = sizes.where("side = 'eval'").select(F.col("cls").alias("cls_b"), F.col("n").alias("m_b"), F.col("rep").alias("rep_b"))
    pairs = pairs.join(size_a, "cls_a").join(size_b, "cls_b")
    a = members.where("side = 'train'").select(F.col("cls").alias("cls_a"), F.col("query_id").alias("x"))
    b = members.where("side = 'eval'").select(F.col("cls").alias("cls_b"), F.col("query_id").alias("y"))
    small = F.col("m_a") * F.col("m_b") <= whole * whole
    full = pairs.where(small).join(a, "cls_a").join(b, "cls_b").select("x", "y")
    left = pairs.where(~small).join(a, "cls_a").select("x", F.col("rep_b").alias("y"))
    right = pairs.where(~small).join(b, "cls_b").select(F.col("rep_a").alias("x"), "y")
    every = full.unionByName(left).unionByName(right).where("x != y")
    return every.select(F.least("x", "y").alias("query_id_a"), F.greatest("x", "y").alias("query_id_b")).distinct()


def cross_groups(queries: DataFrame, *, least: float = 0.8, train: str = "train", evaluation: tuple[str, ...] = EVALUATION) -> DataFrame:
    """``query_id, side, class_id, copies, links``: one row for each query of either side that has words.

    ``class_id`` is the smallest id of the queries of its side with the same word set, ``copies`` their number, ``links``
    how many classes of the other side are similar to it. Together with ``cross_split`` it names every overlap.
    """
    members, pairs = _classes(queries, least, train, evaluation)
    sizes = members.groupBy("side", "cls").agg(F.count("*").alias("copies"), F.min("query_id").alias("class_id"))
    pairs = stage(pairs, "pairs")
    ends = pairs.select(F.lit("train").alias("side"), F.col("cls_a").alias("cls")).unionByName(pairs.select(F.lit("eval").alias("side"), F.col("cls_b").alias("cls")))
    links = ends.groupBy("side", "cls").agg(F.count("*").alias("links"))
    return members.join(sizes.join(links, ["side", "cls"], "left"), ["side", "cls"]).select("query_id", "side", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def report(queries: DataFrame, pairs: DataFrame, evaluation: tuple[str, ...] = EVALUATION) -> DataFrame:
    """``split, domain, source_file, queries, overlapping``: per evaluation split and source, how many queries there are and how many overlap with training. A null source is a group of its own."""
    ids = pairs.select(F.explode(F.array("query_id_a", "query_id_b")).alias("query_id")).distinct().withColumn("hit", F.lit(1))
    own = queries.where(F.col("split").isin(*evaluation)).select("query_id", "split", "domain", "source_file").where("query_id is not null").distinct()
    return own.join(ids, "query_id", "left").groupBy("split", "domain", "source_file").agg(F.count("*").alias("queries"), F.count("hit").alias("overlapping"))
