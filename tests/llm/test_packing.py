import os

import numpy as np
import pytest
from pyspark.sql import functions as _f

from quillstone.llm import packing


def test_capacities_hold_and_space_is_used():
    rng = np.random.default_rng(3)
    sizes = np.sort(np.minimum(2048, rng.lognormal(5.3, 1, 4000).astype(int) + 1))[::-1]
    bins, place = packing.best_fit(sizes, 2048, 64, 2048.0**2)
    used = np.bincount(bins, sizes)
    assert used.max() <= 2048 and np.bincount(bins).max() <= 64
    assert len(used) <= np.ceil(sizes.sum() / 2048) * 1.01 + 1
    for b in range(5):
        assert sorted(place[bins == b]) == list(range((bins == b).sum()))
    bins, _ = packing.best_fit(sizes, 2048, 8, 2048.0 * 500)
    cost = np.bincount(bins, sizes.astype(float) ** 2)
    assert np.bincount(bins).max() <= 8 and all(c <= 2048 * 500 for b, c in enumerate(cost) if (bins == b).sum() > 1)
    assert len(packing.best_fit(sizes[:0], 2048, 64, 1.0)[0]) == 0


def test_items_and_pieces(spark):
    df = spark.createDataFrame([(1, 5000, "x"), (2, 10, "x"), (3, 0, "x"), (4, None, "x"), (None, 7, "x"), (5, 2048, "x")], "doc_id long, n_tokens long, shard string")
    rows = packing.pack(df).collect()
    assert sorted((r.doc_id, r.piece, r.first_token, r.n_tokens) for r in rows) == [(1, 0, 0, 2048), (1, 1, 2048, 2048), (1, 2, 4096, 904), (2, 0, 0, 10), (3, 0, 0, 0), (4, 0, 0, 0), (5, 0, 0, 2048)]
    assert len({r.container for r in rows if r.container}) == 4 and {r.doc_id for r in rows if r.container is None and r.position is None} == {3, 4}
    assert packing.pack(df.where("false")).count() == 0
    many = spark.range(5000).selectExpr("id as doc_id", "1 + id % 700 as n_tokens")
    shards = packing.pack(many, shard_items=1000)
    assert shards.count() == 5000 and shards.groupBy("container").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0] <= 2048


@pytest.mark.skipif(not os.path.exists(packing.vocabulary()), reason="no tokenizer files")
def test_lengths_are_the_tokenizers(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "日本 " * 3000), (None, "x"), (1, "Hello world")], "doc_id long, text string")
    got = dict(map(tuple, packing.token_lengths(df).collect()))
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] == len(packing.encoder(packing.vocabulary()).encode_ordinary("日本 " * 3000)) and None not in got


@pytest.mark.skipif(not os.path.exists(packing.vocabulary()), reason="no tokenizer files")
def test_long_runs_of_white_space():
    enc = packing.encoder(packing.vocabulary())
    for text in ("a" + " " * 700 + "b", "a" + "\n" * 600 + "b c", " " * 900, "x\t" + " " * 650 + "\n!y", "\ud800 a", "word " * 50):
        assert packing.count_tokens(enc, text) == len(enc.encode_ordinary(text.replace("\ud800", "\ufffd")))
    assert packing.count_tokens(enc, "a" + " " * 1_000_000 + "b") > 1000


def test_audit_sees_what_is_wrong(spark):
    items = spark.createDataFrame([(1, 5000), (2, 10), (3, 0), (4, None)], "doc_id long, n_tokens long")
    good = packing.pack(items)
    assert packing.audit(good, items).first().asDict() == {"documents": 4, "cut": 0, "lost": 0, "overfull": 0, "crowded": 0, "costly": 0, "gaps": 0, "full": True}
    bad = good.selectExpr("'0-0' as container", "position", "doc_id", "piece", "first_token", "n_tokens").where("piece < 2")
    seen = packing.audit(bad, items).first()
    assert (seen.overfull, seen.gaps, seen.lost) == (1, 1, 1)


def test_every_capacity_binds(spark):
    many = spark.range(6000).selectExpr("id as doc_id", "1 + pmod(id * 7919, 1500) as n_tokens")
    for bounds, limit in (({"documents": 3}, "n >= 3"), ({"cost": 2048**2 / 4}, f"cost > {0.95 * 2048**2 / 4}")):
        placed = packing.pack(many, shard_items=2000, **bounds)
        seen = packing.audit(placed, many, **bounds).first()
        assert seen.documents == 6000 and sum(seen[c] for c in ("cut", "lost", "overfull", "crowded", "costly", "gaps")) == 0
        bins = placed.groupBy("container").agg({"*": "count", "n_tokens": "sum"}).count()
        assert placed.groupBy("container").agg(*[f.alias(a) for f, a in ((_f.count("*"), "n"), (_f.sum(_f.col("n_tokens") ** 2), "cost"))]).where(limit).count() > bins / 4
