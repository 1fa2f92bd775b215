import numpy as np

from quillstone.llm.neighbours import LENGTH, ascent, links, most_similar, profiles, ranges

SCHEMA = "id string, embedding array<float>, tree int, prefix string"


def rows(ids, x):
    return [(i, [float(v) for v in r], 7, "clash") for i, r in zip(ids, x)]


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :k], s


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    x = np.repeat(centres, 30, axis=0) + 0.25 * rng.standard_normal((1200, 16))
    x = x.astype(np.float32)
    found = most_similar(spark.createDataFrame(rows([f"v{i:04d}" for i in range(1200)], x), SCHEMA), dim=16).collect()
    want, s = brute(x.astype(np.float64), 5)
    got = {(r.id, r.neighbour) for r in found}
    true = {(f"v{i:04d}", f"v{j:04d}") for i in range(1200) for j in want[i]}
    assert len(got & true) / len(true) >= 0.9
    assert all(abs(r.cosine - s[int(r.id[1:]), int(r.neighbour[1:])]) < 1e-6 for r in found[:200])
    assert max(r.rank for r in found) == 5


def test_unusable_vectors_repeats_and_nulls(spark):
    good = [1.0, 0.0, 0.5, 0.25]
    data = [
        ("a", good, 1, "x"), ("a", good, 1, "y"), ("b", [1.0, 0.1, 0.5, 0.25], 1, "x"), (None, good, 1, "x"), ("c", None, 1, "x"), ("d", [0.0] * 4, 1, "x"),
        ("e", [float("nan"), 1.0, 0.0, 0.0], 1, "x"), ("f", [float("inf"), 1.0, 0.0, 0.0], 1, "x"), ("g", [1.0], 1, "x"), ("h", [None, 1.0, 0.0, 0.0], 1, "x"),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    assert {(r.id, r.neighbour) for r in most_similar(df, dim=4).collect()} == {("a", "b"), ("b", "a")}
    assert [tuple(r) for r in links(most_similar(df, dim=4)).collect()] == [("a", "b")]
    assert most_similar(df.where("false"), dim=4).count() == 0


def test_many_equal_vectors_keep_five_each(spark):
    same = [(f"s{i:04d}", [1.0, 2.0, 3.0, 4.0], 1, "x") for i in range(700)]
    rng = np.random.default_rng(1)
    other = rows([f"o{i:03d}" for i in range(300)], rng.standard_normal((300, 4)))
    found = most_similar(spark.createDataFrame(same + other, SCHEMA), dim=4, min_cosine=0.999999).where("id like 's%'").groupBy("id").count().collect()
    assert len(found) == 700 and all(r["count"] == 5 for r in found)


def test_min_cosine_keeps_ranks(spark):
    x = np.array([[1, 0], [1, 0.1], [1, 0.2], [0, 1]], dtype=float)
    found = most_similar(spark.createDataFrame(rows("abcd", x), SCHEMA), dim=2, min_cosine=0.99).collect()
    assert {(r.id, r.neighbour, r.rank) for r in found} == {("a", "b", 1), ("b", "a", 2), ("b", "c", 1), ("c", "b", 1)}


def _shared(a, b):
    return LENGTH - int(a ^ b).bit_length()


def test_profiles_ascent_and_ranges_against_counting():
    rng = np.random.default_rng(3)
    trees = [np.sort(np.concatenate([rng.integers(0, 1 << LENGTH, 150), rng.integers(0, 1 << 12, 100), np.full(50, 77)])) for _ in range(3)]
    found = []
    for t, key in enumerate(trees):
        got = profiles(key)
        for i in (0, 40, 120, 180, 250, 299):
            counts = [sum(_shared(key[i], o) >= d for o in key) for d in range(LENGTH + 1)]
            for j in range(10):
                enough = [d for d in range(LENGTH + 1) if counts[d] >= 2**j]
                assert got[i, j] == (max(enough) if enough else -1)
        found.append(got)
    stop, rest = ascent(np.stack(found, axis=1), 60)
    for t, key in enumerate(trees):
        own = np.arange(300)
        first, end = ranges(key, own, stop, rest)
        for i in range(0, 300, 7):
            deep = [k for k in range(300) if _shared(key[i], key[k]) > stop[i]]
            same = [k for k in range(300) if _shared(key[i], key[k]) >= stop[i]]
            assert first[i] <= i < end[i] and all(first[i] <= k < end[i] for k in deep) and first[i] >= min(same) and end[i] <= max(same) + 1
    assert (ascent(np.stack(found, axis=1), 10**9)[0] == -1).all()


def test_ascent_goes_deeper_where_it_is_dense():
    """In a dense region the ascent ends at a longer prefix: as many candidates, other lengths."""
    rng = np.random.default_rng(4)
    key = np.sort(np.concatenate([rng.integers(0, 1 << LENGTH, 2000), (1 << 40) + rng.integers(0, 1 << 20, 2000)]))
    stop, _ = ascent(profiles(key)[:, None, :], 200)
    assert np.median(stop[np.searchsorted(key, (1 << 40) + (1 << 19)) + np.arange(50)]) > 20 > np.median(stop[-1000:])


def test_recall_where_the_candidates_are_a_small_share(spark):
    """p1_found with its parameters, at 15,000 drawers: a tenth of all rows are compared."""
    import os

    import pytest
    from pyspark.sql import functions as F

    from quillstone.llm import neighbours, queries

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    found = {tuple(r) for r in queries.p1_found(spark, folder).collect()}
    rows_ = spark.read.parquet(f"{folder}/drawers.parquet").where(F.col("id").isNotNull() & neighbours.usable("embedding", 64))
    frame = rows_.selectExpr("id", "cast(embedding as array<double>) as e").dropDuplicates(["id"]).toPandas()
    x = np.array(frame.e.tolist())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, true = frame.id.to_numpy(), set()
    for at in range(0, len(x), 2000):
        s = x[at : at + 2000] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        best = np.argpartition(-s, 5, axis=1)[:, :5]
        for i, j in zip(*np.nonzero(np.take_along_axis(s, best, 1) >= 0.9)):
            true.add(tuple(sorted((ids[at + i], ids[best[i, j]]))))
    assert len(found & true) >= 0.99 * len(true) and len(found - true) <= 0.01 * len(true)
