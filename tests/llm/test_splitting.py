from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm.splitting import cut, oversized_pieces, replaced

SCHEMA = "id string, content string, source_file string, chunk_index long, piece int, block int, wing string"


def check(data, limit, overlap):
    parts = cut(data, limit, overlap)
    assert b"".join(data[a + r : b] for a, b, r in parts) == data
    assert all(0 < b - a <= limit and r <= overlap for a, b, r in parts)
    return parts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é日.\n \r", max_size=400), st.integers(4, 60), st.integers(0, 20))
def test_pieces_join_to_the_text(text, limit, overlap):
    data = text.encode()
    for a, b, _ in check(data, limit, min(overlap, limit // 3)):
        data[a:b].decode()


def test_prefers_natural_boundaries():
    paragraph = ("Some words of a sentence here. " * 12).strip()
    data = "\n\n".join([paragraph] * 5).encode()
    parts = check(data, 800, 100)
    assert all(data[b - 2 : b] == b"\n\n" for _, b, _ in parts[:-1])
    assert len(check(b"x" * 5000, 800, 100)) <= 15
    assert check(("é" * 3000).encode(), 801, 100)


def test_pieces_of_a_table(spark):
    long = "word " * 400
    data = [
        ("a", long, "f\\x.md", 0, 9, 9, "w"), ("a", long, "f\\x.md", 0, 9, 9, "w"), ("b", "short", "f/x.md", 1, 9, 9, "w"), ("c", "\n \t" + "y" * 800 + "\r\n" * 900, "f/x.md", 2, 9, 9, "w"),
        ("d", None, "f/x.md", 3, 9, 9, "w"), (None, long, "f/x.md", 3, 9, 9, "w"), ("e", long, None, None, 9, 9, "w"), ("f", "z" * 30_000, "g", 5, 9, 9, "w"),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    pieces = oversized_pieces(df).collect()
    assert {p.id for p in pieces} == {"a", "e", "f"} and all(len(p.content.encode()) <= 800 for p in pieces)
    out = replaced(df).collect()
    for name in ("f/x.md", "g"):
        mine = sorted(r.chunk_index for r in out if (r.source_file or "").replace("\\", "/") == name)
        assert mine == list(range(len(mine)))
    assert {r.id for r in out} == set("abcdef")
    assert oversized_pieces(df.where("false")).count() == 0 and replaced(df.where("false")).count() == 0
