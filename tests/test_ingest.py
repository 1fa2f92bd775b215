import json

from pyspark.sql import functions as F

from quillstone.operators import chunking, dialect, entities
from quillstone.sources import files, legacy

RUST = '''use std::fmt;

impl Worker for Batch {
    /// A comment with { braces
    pub fn classify(&self, event: Event) -> Outcome {
        match event {
            Event::Login { user, .. } => self.record("login }", user, self.clock.now()),
            Event::Logout(user) => {
                self.record("logout", user, self.clock.now());
                self.finish(user)
            }
            _ => Outcome::None,
        }
    }

    fn small(&self) -> usize { self.items.iter().filter(|x| x.ready).count() }
}
'''


def test_text_chunks():
    assert chunking.text_chunks(None) == chunking.text_chunks("  ") == chunking.text_chunks("x" * 49) == []
    text = "a" * 900 + "\n\n" + "b" * 900
    parts = chunking.text_chunks(text)
    assert all(len(p) <= 800 for p in parts) and parts[0] == "a" * 800 and [len(p) for p in parts] == [800, 800, 402]
    broken = "c" * 500 + "\n\n" + "d" * 500
    assert chunking.text_chunks(broken) == ["c" * 500, "c" * 100 + "\n\n" + "d" * 500]
    assert all(len(p.encode()) <= 800 for p in chunking.text_chunks("日本語" * 900))


def test_line_ranges():
    data = "".join(f"let value_{i} = compute({i});\n" for i in range(120)).encode()
    ranges = chunking.line_ranges(data)
    assert b"".join(data[a:b] + b"\n" for a, b in ranges) == data and all(b - a <= 800 for a, b in ranges)
    long = b"x" * 2000 + b"\nshort line that is long enough to be a chunk of its own, yes\n"
    assert [b - a for a, b in chunking.line_ranges(long)][0] == 2000


def test_structural_units():
    units = {u[2]: (RUST.encode()[u[0] : u[1]].decode(), u[3]) for u in chunking.structural_units(RUST.encode())}
    assert units["Event::Login"][0].strip() == 'Event::Login { user, .. } => self.record("login }", user, self.clock.now()),' and units["Event::Login"][1] == "classify"
    assert units["Event::Logout"][0].strip().endswith("}") and units["small"][1] == "Batch" and "classify" not in units
    chunks = chunking.structural_chunks(RUST)
    assert sum(c.count("Event::Login") for c, _, _ in chunks) == 1 and "".join(c for c, _, _ in chunks).count("use std::fmt") == 1


def test_chunked_table(spark):
    df = spark.createDataFrame([("a.rs", RUST), ("b.md", "word " * 400), ("c.py", None), (None, "plain text that has no path but is long enough to be kept")], "source_file string, content string")
    got = chunking.chunked(df).groupBy("source_file").count().collect()
    assert {r[0]: r[1] for r in got} == {"a.rs": 4, "b.md": 3, None: 1}


def test_sniffing_and_filters(spark, tmp_path):
    assert files.looks_like_text(b"") and files.looks_like_text("été\n".encode()) and not files.looks_like_text(bytes([0, 159, 146, 150, 0, 1, 2, 3]))
    assert not files.looks_like_text(b"\x01" * 2 + b"a" * 100) and not files.looks_like_text(b"\xff" * 30 + b"a" * 100)
    tree = {"src/a.py": b"print(1)", "node_modules/x.js": b"x", "lib.egg-info/y.py": b"x", "img.PNG": b"x", "fixtures/d.json": b"{}", "keep/d.json": b"{}", "bin.txt": b"\0\1", "docs/skip.md": b"# x", ".gitignore": b"docs"}
    for name, data in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    names = [r.source_file for r in files.project_files(spark, str(tmp_path)).orderBy("source_file").collect()]
    assert names == ["docs/skip.md", "keep/d.json", "src/a.py"]
    assert [r.source_file for r in files.project_files(spark, str(tmp_path), ignore=["docs"], limit=1).collect()] == ["keep/d.json"]
    (tmp_path / "quillstone.yaml").write_text("wing: w")
    assert files.routing_config(str(tmp_path / "src")) == str(tmp_path / "quillstone.yaml")


def test_routing(spark):
    rooms = [("backend", ["api", "server"]), ("design", ["figma"])]
    df = spark.createDataFrame([("src/api/x.py", ""), ("misc/design_notes.md", ""), ("misc/q.md", "Figma, figma and the server"), ("misc/q.md", "nothing")], "p string, c string")
    got = [r[0] for r in df.select(files.routed_room(F.col("p"), F.col("c"), rooms)).collect()]
    assert got == ["backend", "design", "design", "general"]


def test_legacy_import(spark):
    e = spark.createDataFrame([(1, "e1"), (2, "e2")], "id long, embedding_id string")
    m = spark.createDataFrame([(1, "document", "text", None, None, None), (1, "chunk_index", None, 4, None, None), (1, "source_file", "a.py", None, None, None), (2, "document", "  ", None, None, None)], "id long, key string, string_value string, int_value long, float_value double, bool_value boolean")
    (r,) = legacy.imported(e, m).collect()
    assert (r.id, r.content, r.content_kind, r.wing, r.room, r.chunk_index, r.added_by) == ("e1", "text", "code", "legacy", "general", 4, "migration")


def test_dialect(spark):
    df = spark.createDataFrame([("a", "Yesterday Alice said we decided to switch the GraphQL server because latency was critical. Fine.", "w", "r", "x/notes.md", "2026-01-02T03"), ("n", None, "w", "r", None, None)], "id string, content string, wing string, room string, source_file string, filed_at string")
    got = {r.id: r for r in dialect.compressed(df).collect()}
    assert got["a"].dialect == 'w|r|2026-01-02|notes\n0:ALI+FIN|graphql_alice_fine|"Yesterday Alice said we decided to switch the GraphQ..."|determ|DECISION+TECHNICAL'
    assert got["n"].dialect == "w|r|?|?\n0:???|misc" and got["n"].original_tokens == 1
    back = dialect.compressed(df).select("id", dialect.decoded(F.col("dialect")).alias("d")).where("id = 'a'").first().d
    assert back.header == "w|r|2026-01-02|notes" and len(back.entries) == 1 and back.tunnels == [] and back.arc is None
    assert dialect.weight_text(0.5) == "0.5" and dialect.weight_text(1.0) == "1" and dialect.weight_text(0.8765) == "0.876"


def test_records():
    z = {"id": "zettel-001", "people": ["Alice", "Max"], "topics": ["memory", "ai", "x"], "content": 'She said: "I want to remember everything"', "title": "t - the title", "emotional_weight": 0.9, "emotional_tone": ["joy", "raw_grief"], "origin_moment": True, "notes": "core"}
    assert dialect.encode_record(z, {"Alice": "ALC"}) == '001:ALC+MAX|memory_ai|"I want to remember everything"|0.9|joy+grief|ORIGIN+CORE'
    data = {"source_file": "001-talk-about.txt", "emotional_arc": "up->down", "zettels": [z], "tunnels": [{"from": "a-1", "to": "b-2", "label": "leads: on"}]}
    assert dialect.encode_file(data).splitlines()[0] == "001|ALI+MAX|unknown|about" and dialect.encode_file(data).endswith("T:1<->2|leads")
    assert "=MOMENTS[]=" in dialect.digest([data]) or "=MOMENTS[" in dialect.digest([data])
    assert dialect.next_code("Alice", {"ALI"}) == "ALIC" and dialect.next_code("Al", {"AL"}) == "AL2"


def test_encoded_files(spark):
    df = spark.createDataFrame([("a", json.dumps({"source_file": "1-x.txt"})), ("b", "{bad"), ("c", None)], "path string, json string")
    assert {r.path: r.dialect for r in dialect.encoded_files(df).collect()} == {"a": "1|???|unknown|x", "b": None, "c": None}


def test_entities(spark):
    text = "Riley said hello.\nRiley asked why. She laughed.\nhey Riley\nRiley wrote it.\nWe are building Lattice and deploying Lattice.\nThe Lattice architecture: import Lattice.\n"
    got = {r.name: r for r in entities.detected(spark.createDataFrame([("d", text)], "id string, content string")).collect()}
    assert got["Riley"].kind == "person" and got["Lattice"].kind == "project" and got["Riley"].frequency == 4
    assert entities.detected(spark.createDataFrame([], "id string, content string")).count() == 0
