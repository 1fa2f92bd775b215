import random

import numpy as np

from quillstone.llm import darts
from quillstone.llm.neardup import components, near_groups, near_pairs
from quillstone.llm.words import shingles, words

SCHEMA = "id string, content string, cls string, n int, band string"


def sets(text, size):
    w = words(text)
    return set(zip(*(w[k:] for k in range(size))))


def brute(data, size, least):
    s = {}
    for i, t, *_ in data:
        if i is not None and t is not None and sets(t, size):
            s.setdefault(i, sets(t, size))
    ids = sorted(s)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) >= least}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    data = []
    for i in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        data.append((f"d{i}", " ".join(base)))
        for k in range(rng.randint(0, 3)):
            edited = [w if rng.random() > 0.02 * k else rng.choice(vocabulary) for w in base]
            data.append((f"d{i}-{k}", ". ".join(edited).upper()))
    return [(i, t, "clash", 1, "clash") for i, t in data]


def test_pairs_equal_brute_force(spark):
    data = corpus(3)
    got = {tuple(r) for r in near_pairs(spark.createDataFrame(data, SCHEMA), shingle=3, least=0.6).collect()}
    want = brute(data, 3, 0.6)
    assert len(want) > 40 and got <= want and len(got) >= 0.98 * len(want)


def test_nulls_empties_repeats_and_long_texts(spark):
    long = " ".join(f"x{i % 5000}" for i in range(60_000))
    data = [
        ("a", "one two three four five six", "c", 1, "b"), ("a", "one two three four five six", "c", 1, "b"), ("b", "One, two; three four five SIX!", "c", 1, "b"), (None, "one two three four five six", "c", 1, "b"),
        ("n", None, None, None, None), ("e", "", "c", 1, "b"), ("w", "two words", "c", 1, "b"), ("w2", "two words", "c", 1, "b"), ("l1", long, "c", 1, "b"), ("l2", long + " end", "c", 1, "b"),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    assert {tuple(r) for r in near_pairs(df, shingle=3, least=0.6).collect()} == {("a", "b"), ("l1", "l2")}
    assert near_pairs(df.where("false")).count() == 0
    groups = {r.id: r for r in near_groups(df, shingle=3, least=0.6).collect()}
    assert set(groups) == {"a", "b", "l1", "l2"} and groups["b"].group_id == "a" and groups["b"].copies == 2 and groups["l2"].group_id == "l1" and groups["l1"].links == 1


def test_large_class_is_a_star(spark):
    data = [(f"k{i:02d}", "same text in all of these rows here", "c", 1, "b") for i in range(20)] + [("z", "same text in all of these rows now", "c", 1, "b")]
    df = spark.createDataFrame(data, SCHEMA)
    got = {tuple(r) for r in near_pairs(df, shingle=3, least=0.6, whole=10).collect()}
    assert got == {("k00", f"k{i:02d}") for i in range(1, 20)} | {("k00", "z")}
    assert near_pairs(df, shingle=3, least=0.6).count() == 190 + 20


def test_weighted_similarity():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 90).astype(np.uint64)
    wa, wb = rng.uniform(0.2, 3, 90), rng.uniform(0.2, 3, 90)
    sig = darts.signatures(np.concatenate([h, h]), np.array([0, 90, 180]), 2000, np.concatenate([wa, wb]))
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    assert (darts.signatures(h[:0], np.array([0, 0]), 8) == darts.EMPTY).all()


def test_shingles_are_distinct_and_within_texts():
    h, starts = shingles(["a b c a b c", None, "", "a b", "b c a"], 3)
    assert np.diff(starts).tolist() == [3, 0, 0, 0, 1]
    assert h[starts[4]] in h[starts[0] : starts[1]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(40, 41), (41, 42), (40, 42)]
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 31), 40, 41, 42, 50]], "node long")
    got = dict(map(tuple, components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 31)}, 40: 40, 41: 40, 42: 40, 50: 50}
