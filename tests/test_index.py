"""The stored index gives what a scan of the texts gives, and rankings cut their rows before they shuffle them."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.vectors import hash_embed, hash_embed_text
from quillstone.operators import index, search
from quillstone.sources.store import Store

TEXTS = [("a", "Der Zug, der frühe Zug; zug-führer ZUG", "prose"), ("b", "first join, first  join first_join", "code"), ("c", None, "prose"), ("d", "", "prose"), ("e", "joiner frühstück fruh", "diary"), ("f", "nothing here", "unknown")]
TERMS = ["fruh*", "zug*", "first*", "first join", "join first", "nowhere*", "not there"]


@pytest.fixture(scope="module")
def drawers(spark):
    rows = spark.createDataFrame([(i, t, k, "w" if i < "d" else "v", "r", "clash") for i, t, k in TEXTS], "id string, content string, content_kind string, wing string, room string, term string")
    return rows.withColumn("embedding", hash_embed(F.col("content"), 32))


def _made(spark, drawers, path):
    store = Store(spark, str(path), encode=lambda b: hash_embed(b, 32), index=True)
    store.insert(drawers)
    return store


def _counts(rows):
    keep = rows.where(F.exists("tf", lambda x: x > 0)).select("id", "length", "tf", "mean", "idf").collect()
    return {r.id: (r.length, list(r.tf), round(r.mean, 9), [round(x, 9) for x in r.idf]) for r in keep}


def test_index_equals_scan(spark, drawers, tmp_path):
    store = _made(spark, drawers, tmp_path)
    want = _counts(search.bm25(drawers, TERMS))
    assert _counts(index.counted(store.inverted(), TERMS)) == want and want["b"][1] == [0, 0, 3, 3, 2, 0, 0] and want["a"][1][:2] == [1, 4]
    scope = F.col("wing") == "w"
    assert _counts(index.counted(store.inverted(), TERMS, scope)) == _counts(search.bm25(drawers, TERMS, scope=scope))
    assert index.postings(drawers.where("false")).count() == 0


def test_index_follows_changes(spark, drawers, tmp_path):
    store = _made(spark, drawers, tmp_path)
    store.upsert(drawers.where("id = 'b'").withColumn("content", F.lit("zug first")))
    store.delete("a")
    now = store.drawers()
    assert store.inverted().rows == now.count() == 5 and store.inverted().words == now.agg(F.sum(F.size(T.lexical_words(F.coalesce("content", F.lit("")))))).first()[0]
    assert _counts(index.counted(store.inverted(), TERMS)) == _counts(search.bm25(now, TERMS))
    assert len(store.manifest()["parts"]) == 2 and len(store.manifest()["deletes"]) == 2
    store.compact()
    assert len(store.manifest()["parts"]) == 1 and not store.manifest()["deletes"] and _counts(index.counted(store.inverted(), TERMS)) == _counts(search.bm25(now, TERMS))
    old = store.drawers(1)
    assert old.count() == 6 and old.where("id = 'b'").first().content == TEXTS[1][1]


def test_hybrid_with_index_equals_hybrid_without(spark, drawers, tmp_path):
    store = _made(spark, drawers, tmp_path)
    for asked in ("first join früher Zug", "joiner", "zug"):
        one = search.hybrid(store.drawers(), search.Query(asked), lambda t: hash_embed_text(t, 32)).select("id", "relevance", "score").collect()
        assert search.hybrid(store.drawers(), search.Query(asked), lambda t: hash_embed_text(t, 32), store.inverted()).select("id", "relevance", "score").collect() == one


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rankings_are_cut_before_the_shuffle(spark, drawers, tmp_path):
    store = _made(spark, drawers, tmp_path)
    views = [(v, hash_embed_text(v.text, 32)) for v in search.dense_views("first join früher Zug")]
    for ranks in (search.dense_ranks(store.drawers(), views, search.depth(5)), search.lexical_ranks(store.inverted(), search.lexical_views("first join früher Zug"), search.depth(1000))):
        plan = _plan(ranks)
        partial = [i for i, line in enumerate(plan.split("\n")) if "WindowGroupLimit" in line and "Partial" in line]
        shuffle = [i for i, line in enumerate(plan.split("\n")) if "Exchange hashpartitioning(view" in line]
        assert partial and shuffle and shuffle[0] < partial[0]


def test_a_search_by_words_reads_only_its_terms(spark, drawers, tmp_path):
    store = _made(spark, drawers, tmp_path)
    plan = _plan(search.bm25_topk(store.inverted(), ["zug*", "first*"], 5))
    assert "StringStartsWith(term,zug)" in plan and "content:" not in plan
