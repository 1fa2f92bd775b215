import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.fingerprint import fnv1a
from quillstone.functions.vectors import cosine, hash_embed, hash_embed_text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<float>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


def test_tokens(spark):
    for text, want in [("FirstJoin", ["first", "join"]), ("process a player's very first game login", ["process", "player", "first", "game", "login"]), ("", []), ("naïveCase x1", ["naïve", "case", "x1"])]:
        assert one(spark, T.identifier_tokens(F.col("t")), t=text) == want == T.tokens_of(text)
    assert one(spark, T.identifier_tokens(F.col("t")), t=None) is None
    assert T.variants(["a1", "b2"]) == ["a1 b2", "a1_b2", "a1-b2", "a1b2"] and T.variants(["a1"]) == ["a1"] and T.variants([]) == []
    assert one(spark, T.split_identifier(F.col("t")), t="HTTPServer_v2Name") == ["http", "server", "v2", "name"]
    assert T.concepts(["login", "process", "enter", "zebra"]) == ["join", "handle"]


def test_slugs_paths_and_kinds(spark):
    assert one(spark, T.slug_hyphen(F.col("t")), t="  A--b C!") == "a-b-c"
    assert one(spark, T.slug_underscore(F.col("t")), t="A--b C!") == "a__b_c"
    assert one(spark, T.excerpt(F.col("t"), 5), t=" a  b\nc d ") == "a b c..."
    kinds = {"diary/a.rs": "diary", "src/a.rs": "code", "sessions/a.md": "conversation", "docs/a.md": "documentation", "README": "documentation", "a.txt": "prose", "A\\B.PY": "code"}
    for path, kind in kinds.items():
        assert one(spark, T.content_kind(F.col("p"), F.lit("w"), F.lit("r")), p=path) == kind
    assert one(spark, T.content_kind(F.col("p"), F.lit("w"), F.lit("r"), "unknown"), p=None) == "unknown"
    assert one(spark, T.room_of_path(F.col("p")), p="My Room/x.py") == "my_room" and one(spark, T.room_of_path(F.col("p")), p="x.py") == "general"
    assert one(spark, T.language(F.col("p")), p="a/b.TSX") == "typescript" and one(spark, T.language(F.col("p")), p=".rs") is None


def test_front_matter(spark):
    f = T.without_front_matter(F.col("t"))
    assert one(spark, f, t="---\na: 1\n---\nbody") == "body" and one(spark, f, t="---\r\na\r\n---\r\nbody") == "body"
    assert one(spark, f, t="---\nno end") == "---\nno end" and one(spark, f, t="x\n---\na\n---\n") == "x\n---\na\n---\n"


@pytest.mark.parametrize(
    ("query", "want"),
    [("10 days ago", "2026-07-05"), ("yesterday", "2026-07-14"), ("last wednesday", "2026-07-08"), ("last week, two weeks ago", "2026-07-01"), ("one month ago", "2026-06-15"), ("99999999999999 days ago", None), ("soon", None)],
)
def test_relative_dates(spark, query, want):
    as_of = "2026-07-15T18:00:00+08:00"
    assert T.relative_date(query, as_of) == (want and dt.date.fromisoformat(want))
    got = spark.createDataFrame([(query, as_of)], "q string, a string").select(T.relative_day(F.col("q"), F.col("a"))).first()[0]
    assert got == (want and dt.date.fromisoformat(want))
    assert T.relative_date(query, None) is None


def test_dates(spark):
    for text, want in {"2026-01-02T03:04:05+14:00": "2026-01-02", "2026/03/04 (Wed) 10:00": "2026-03-04", "2026-05-06": "2026-05-06", "2026-13-01": None, "soon": None}.items():
        got = one(spark, T.memory_date(F.col("t")), t=text)
        assert got == T.parse_date(text) == (want and dt.date.fromisoformat(want))


def test_vectors(spark):
    c = cosine(F.col("a"), F.col("b"))
    assert one(spark, c, a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.70710678)
    assert one(spark, c, a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    with pytest.raises(Exception, match="different lengths"):
        one(spark, c, a=[1.0], b=[1.0, 1.0])
    assert one(spark, hash_embed(F.col("t"), 32), t="Alpha beta, ALPHA") == pytest.approx(hash_embed_text("alpha alpha beta", 32))
    assert one(spark, hash_embed(F.col("t"), 4), t=None) == [0, 0, 0, 0]


def test_fingerprint():
    assert [f"{x:016x}" for x in fnv1a([b"", b"a", b"foobar"])] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]


def test_retrieval_texts(spark):
    doc = "# Title\n\ntext\n## One\n### Two\nhere it is"
    got = spark.createDataFrame([(doc, "here it is", "a/b.md")], "d string, c string, p string").select(T.documentation_retrieval_text(F.col("p"), F.col("d"), F.col("c"))).first()[0]
    assert got == "kind: documentation\nsource: a/b.md\ntitle: Title\nheadings: Title > One > Two\nverbatim:\nhere it is"
    assert T.turns_of('{"role":"user","content":"a  b"}\n{"role":"user","content":"a b"}\nbad\n{"x":[{"role":"tool","content":[{"text":"t"}]}]}') == "user: a b\ntool: t"
    body = T.embedding_input(F.col("c"), F.lit(None).cast("string"), F.col("p"), F.lit("code"))
    assert one(spark, body, c="fooBar", p="a/b/c/d/e/f/g.rs") == "source: b/c/d/e/f/g.rs\nidentifiers: rs foo bar\nfooBar"
