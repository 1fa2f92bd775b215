import random

import numpy as np

from quillstone.llm.leaks import LANE, build, leaked_items, search, slices
from quillstone.llm.words import hashed, words

DOCS, ITEMS = "doc_id long, text string, item_id long", "item_id long, item_text string, text string"


def brute(docs, items, window=10):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, p in items:
            v = words(p)
            m = min(window, len(v))
            if d is not None and i is not None and m:
                runs = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}
                if any(tuple(v[k : k + m]) in runs for k in range(len(v) - m + 1)):
                    out.add((d, i))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(25)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 12, 40]))) for i in range(30)]
    docs = []
    for d in range(150):
        whole = words(items[rng.randrange(30)][1])
        at = rng.randrange(len(whole))
        docs.append((d, f"{text(rng.randint(0, 30))} {', '.join(whole[at : at + 14]).upper()}! {text(rng.randint(0, 30))}"))
    docs += [(500, None), (501, ""), (None, items[0][1]), (0, docs[0][1]), (502, text(30_000))]
    items += [(98, None), (99, "..."), (None, "w1 w2")]
    df, it = spark.createDataFrame([(d, t, 1) for d, t in docs], DOCS), spark.createDataFrame([(i, p, "clash") for i, p in items], ITEMS)
    want = brute(docs, items)
    assert {tuple(r) for r in leaked_items(df, it).collect()} == want and len(want) > 100
    assert {tuple(r) for r in leaked_items(df, it, broadcast_bytes=100).collect()} == want
    assert leaked_items(df.where("false"), it).count() == 0 and leaked_items(df, it.where("false")).count() == 0


def hits(items, text):
    keys = np.array([k for k, _ in items])
    return set(search(build(keys, *hashed([t for _, t in items])), *hashed([text]))[1].tolist())


def test_skips_and_finds_at_the_edges():
    item = [(1, "a b c d e f g h i j")]
    assert hits(item, "a b c d e f g h i j") == {1} and hits(item, "x a b c d e f g h i j") == {1}
    assert hits(item, "a b c d e f g h i x j") == set() and hits(item, "") == set()
    assert hits([(1, "a b c"), (2, "b"), (3, "c d"), (4, "A, B. c"), (5, "d c")], "x a b c d") == {1, 2, 3, 4}
    for at in range(LANE - 12, LANE + 12):  # across the edge of two lanes
        assert hits(item, "x " * at + item[0][1] + " y" * 300) == {1}


def test_tables_keep_within_their_bytes():
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 3, 40, 400])))) for i in range(3000)]
    items.append((9999, " ".join(f"w{rng.randrange(5000)}" for _ in range(30_000))))  # larger than a slice
    most = 1 << 20
    parts = list(slices(iter(items), 10, most))
    assert len(parts) > 10 and all(p.nbytes() <= most for p in parts)
    text = " ".join(["x"] * 50 + items[9][1].split()[-20:] + ["y"] + items[-1][1].split()[15_990:16_003] + ["z"] + items[-1][1].split()[-10:])
    got = set().union(*(set(search(p, *hashed([text]))[1].tolist()) for p in parts))
    want = {i for _, i in brute([(1, text)], items)}
    assert got == want and 9999 in got


def test_a_passage_that_a_third_of_the_items_share():
    shared = " ".join(f"s{i}" for i in range(30))
    items = [(i, shared if i % 3 == 0 else f"own{i} " * 12) for i in range(3000)]
    assert hits(items, "x " + shared) == set(range(0, 3000, 3))
