"""Exact ranking of all items for all questions by the words they share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Questions and items that meet in one task; every block of questions meets every block of items.
QUESTIONS, ITEMS = 4096, 8192


def _blocks(rows: DataFrame, key: str, own: str, count: int, other: str, others: int) -> DataFrame:
    return rows.withColumns({own: F.pmod(F.xxhash64(key), F.lit(count)), other: F.explode(F.sequence(F.lit(0), F.lit(others - 1)))})


def _scores(most: int):
    schema = pa.schema([("question_id", pa.string()), ("item_id", pa.string()), ("score", pa.float64())])

    def run(questions: pa.Table, items: pa.Table) -> pa.Table:
        items = items.sort_by("item_id")
        ids, words = items["item_id"].to_pylist(), items["words"].combine_chunks()
        places: dict[str, np.ndarray] = {}
        if len(ids):
            coded = words.flatten().dictionary_encode()
            rows, codes = np.asarray(words.value_parent_indices()), coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            places = dict(zip(coded.dictionary.to_pylist(), np.split(rows[order], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))[:-1])))
        out: tuple[list, list, list] = ([], [], [])
        for question, asked, weights in zip(questions["question_id"].to_pylist(), questions["words"].to_pylist(), questions["weights"].to_pylist()):
            met = [(places[t], w) for t, w in zip(asked, weights) if t in places]
            if not met:
                continue
            score, seen = np.zeros(len(ids)), np.zeros(len(ids), bool)
            for at, w in met:
                score[at] += w
                seen[at] = True
            at = np.flatnonzero(seen)
            score = np.round(score[at], 9)
            if len(at) > most:  # all that tie with the last one kept take part in the order by id
                kept = score >= np.partition(score, len(at) - most)[len(at) - most]
                at, score = at[kept], score[kept]
            order = np.lexsort((at, -score))[:most]
            out[0].extend([question] * len(order))
            out[1].extend(ids[i] for i in at[order])
            out[2].extend(score[order].tolist())
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def best_shared(questions: DataFrame, items: DataFrame, most: int, question_count: int, item_count: int) -> DataFrame:
    """``question_id, item_id, score, rank``: for every question the ``most`` items with the greatest summed weight of shared words.

    ``questions`` has ``question_id, words, weights``, ``items`` has ``item_id, words``; ids are unique and words distinct
    within a row. Equal scores (to nine places) rank by the smaller item id; an item that shares no word is not ranked.
    The counts only set the number of blocks. The work is that of all pairs that share a word, but no pair is shuffled.
    """
    a, b = max(1, -(-question_count // QUESTIONS)), max(1, -(-item_count // ITEMS))
    left = _blocks(questions, "question_id", "_q", a, "_i", b).groupBy("_q", "_i")
    right = _blocks(items.where(F.size("words") > 0), "item_id", "_i", b, "_q", a).groupBy("_q", "_i")
    scores = left.cogroup(right).applyInArrow(_scores(most), "question_id string, item_id string, score double")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "item_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
