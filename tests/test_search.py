import pytest
from pyspark.sql import functions as F

from quillstone.functions.vectors import hash_embed, hash_embed_text
from quillstone.operators import search
from quillstone.operators.search import Query

SCHEMA = "id string, content string, retrieval_text string, content_kind string, wing string, room string, source_file string, filed_at string"


def store(spark, rows):
    full = [(r.get("id"), r.get("content"), r.get("retrieval_text"), r.get("kind", "prose"), r.get("wing", "w"), r.get("room", "r"), r.get("source_file"), r.get("filed_at")) for r in rows]
    return spark.createDataFrame(full, SCHEMA).withColumn("embedding", hash_embed(F.coalesce("retrieval_text", "content"), 128))


def ask(d, query, **options):
    return search.hybrid(d, Query(query, **options), lambda t: hash_embed_text(t, 128)).collect()


def test_normalised_and_ordered(spark):
    d = store(spark, [{"id": "a", "content": "compressed memory dialect"}, {"id": "b", "content": "garden soil and ferns"}])
    hits = ask(d, "dialect compressed memory")
    assert hits[0].id == "a" and hits[0].relevance == 1.0 and all(0 <= h.relevance <= 1 and -1 <= h.score <= 1 for h in hits)
    assert ask(d, "memory", limit=0) == [] and ask(d.where("false"), "memory") == []


def test_filters_apply_before_ranks(spark):
    rows = [{"id": f"x{i:04d}", "content": "first join first join", "wing": "big"} for i in range(1500)] + [{"id": "s", "content": "the first time players join", "wing": "small"}]
    d = store(spark, rows)
    assert [h.id for h in ask(d, "first join", limit=1, wing="small")] == ["s"]
    assert ask(d, "first join", room="nowhere") == []


def test_words_of_asking_do_not_count(spark):
    d = store(spark, [{"id": "t", "content": "the harness video about lanterns"}, {"id": "o", "content": "please open the door again before noon"}])
    assert ask(d, "Can you remind me which lanterns video you suggested before?")[0].id == "t"


def test_retrieval_text_is_searched_and_content_shown(spark):
    d = store(spark, [{"id": "t", "content": "see notes", "retrieval_text": "the harness video about lanterns"}, {"id": "o", "content": "quiet soil and ferns"}])
    best = ask(d, "Which lanterns video did you recommend?")[0]
    assert (best.id, best.content) == ("t", "see notes")


def test_time(spark):
    rows = [{"id": "early", "content": "we spoke about ferns", "kind": "conversation", "filed_at": "2026-07-05T10:00:00Z"}, {"id": "late", "content": "we spoke about ferns", "kind": "conversation", "filed_at": "2026-07-15"}]
    hits = ask(store(spark, rows), "what did we say about ferns 10 days ago", as_of="2026-07-15T18:00:00+08:00")
    assert [h.id for h in hits] == ["early", "late"]


def test_code_and_concepts(spark):
    rows = [
        {"id": "join", "content": "fn on_first_join(player: &Player) { handle(player) }", "kind": "code", "source_file": "src/player/first_join.rs"},
        {"id": "other", "content": "fn draw(scene: &Scene) { render(scene) }", "kind": "code", "source_file": "src/scene.rs"},
        {"id": "gen", "content": "fn on_first_join(player: &Player) { handle(player) }", "kind": "code", "source_file": "src/generated/first_join.rs"},
    ]
    hits = ask(store(spark, rows), "process a player's very first game login")
    assert [h.id for h in hits] == ["join", "gen", "other"]


def test_min_score_and_bad_vectors(spark):
    d = store(spark, [{"id": "a", "content": "alpha beta"}, {"id": "n", "content": "alpha beta gamma"}, {"id": "e", "content": None}])
    d = d.withColumn("embedding", F.when(F.col("id") != "n", F.col("embedding")))
    assert {h.id: h.score for h in ask(d, "alpha beta")}["n"] is None
    assert [h.id for h in ask(d, "alpha beta", min_score=0.5)] == ["a"]


def test_views():
    v = search.dense_views("process a player's very first game login")
    assert [(x.target, x.weight) for x in v] == [("all", 1.0), ("code", 0.65), ("code", 0.8), ("general", 0.8)]
    assert v[2].text == "handle player first join handleplayer playerfirst firstjoin"
    assert search.dense_views("login") == [search.View("login", "all", 1.0)]
    assert [x.terms for x in search.lexical_views("first join")] == [("first*", "join*"), ("first*", "join*", "firstjoin*", "first join")]
    assert search.lexical_views("") == [] and search.depth(5) == 1024 and search.depth(500) == 4000 and search.depth(9999) == 8192


def test_fusion_numbers(spark):
    a = spark.createDataFrame([("x", 0, 1.0, 1), ("y", 0, 1.0, 2)], "id string, view int, weight double, rank int")
    b = spark.createDataFrame([("x", 0, 0.9, 1)], "id string, view int, weight double, rank int")
    got = dict(map(tuple, search.fuse(a, b).collect()))
    assert got["x"] == pytest.approx(1.9 / 61) and got["y"] == pytest.approx(1 / 62)
    none = spark.createDataFrame([("x", 0.0), ("y", float("inf"))], "id string, relevance double")
    assert {r.relevance for r in search.scaled(none, "relevance").collect()} == {0.0, float("inf")}


def test_term_counts(spark):
    one = lambda t: spark.range(1).select(search.term_count(F.lit("a b, a-b ab. zza b b"), t)).first()[0]
    assert (one("a*"), one("b*"), one("a b"), one("b a"), one("b b"), one("z q"), one("zz*")) == (3, 4, 2, 1, 1, 0, 1)


def test_duplicates(spark):
    d = store(spark, [{"id": "a", "content": "the ferry stops twice near the pier"}, {"id": "b", "content": "quiet lanterns"}])
    assert [h.id for h in search.duplicates(d, "the ferry stops twice near the pier", lambda t: hash_embed_text(t, 128)).collect()] == ["a"]
