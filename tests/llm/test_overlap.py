import random

from quillstone.llm.overlap import cross_split, exploded_queries, report
from quillstone.llm.words import words

SCHEMA = "query_id string, text string, split string, domain string, source_file string, side string, cls string, words string"


def row(i, t, s, d="d", f="f"):
    return (i, t, s, d, f, "clash", "clash", "clash")


def brute(data, least):
    out = set()
    for i, t, s, *_ in data:
        for j, u, v, *_ in data:
            a, b = set(words(t)), set(words(u))
            if i and j and i != j and s == "train" and v in ("dev", "held_out") and a and b and len(a & b) / len(a | b) >= least:
                out.add((min(i, j), max(i, j)))
    return out


def test_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    data = []
    for i in range(300):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 12))]
        data.append(row(f"q{i}", " ".join(base), rng.choice(["train", "train", "dev", "held_out", None])))
        data.append(row(f"r{i}", " ".join([*base[1:], rng.choice(vocabulary)]), rng.choice(["train", "dev"])))
    for least in (0.5, 0.65, 0.8, 1.0):
        got = {tuple(r) for r in cross_split(spark.createDataFrame(data, SCHEMA), least=least).collect()}
        assert got == brute(data, least)


def test_nulls_copies_and_report(spark):
    data = [row(f"t{i:02d}", "the very same words", "train") for i in range(30)] + [row(f"e{i}", "Words, the VERY same!", "dev") for i in range(4)]
    data += [row(None, "the very same words", "train"), row("n", None, "dev"), row("e", "", "dev"), row("p", "!?", "dev"), row("u", "the very same words", None)]
    df = spark.createDataFrame(data + data[:3], SCHEMA)
    assert cross_split(df).count() == 120
    star = {tuple(r) for r in cross_split(df, whole=5).collect()}
    assert star == {("e0", f"t{i:02d}") for i in range(30)} | {(f"e{i}", "t00") for i in range(4)}
    rows = {(r.split, r.queries, r.overlapping) for r in report(df, cross_split(df)).collect()}
    assert rows == {("dev", 7, 4)}
    assert cross_split(df.where("false")).count() == 0


def test_explode_trims_splits(spark):
    schema = "domain string, source_file string, queries array<struct<id string, text string, split string, also_relevant array<string>, as_of string>>, extra int"
    df = spark.createDataFrame([("d", None, [("q", "t", " Held_Out\t", None, None)], 1), ("d", None, None, 2)], schema)
    assert [r.split for r in exploded_queries(df).collect()] == ["held_out"]


def test_long_and_short_sets_meet(spark):
    rng = random.Random(9)
    data = []
    for i, n in enumerate([1, 1, 2, 2, 3, 4, 30, 41, 42, 43, 60, 63, 64, 65, 66, 80, 99, 100, 150]):
        base = [f"c{rng.randrange(40)}" if rng.random() < 0.3 else f"x{i}y{k}" for k in range(n)]
        for m in range(max(1, int(n * 0.5)), n + 1, max(1, n // 9)):
            data += [row(f"t{i}-{m}", " ".join(base[:m]), "train"), row(f"e{i}-{m}", " ".join(base[n - m :]), "held_out")]
    for least in (0.5, 0.65, 0.9):
        got = {tuple(r) for r in cross_split(spark.createDataFrame(data, SCHEMA), least=least).collect()}
        assert got == brute(data, least) and len(got) > 10
