"""Greedy string tiling against a plain version."""

import random

import numpy as np

from evalmill.llm.decontaminate import clean_documents, contaminated, tiles

from .helpers import no_documents, odd_documents

ITEMS = "item_id long, text string, text2 string"


def plain_tiles(x, y, least):
    """Mark the longest unmarked matches, longest first."""
    used_x, used_y, out = set(), set(), []
    while True:
        found = []
        for i in range(len(x)):
            for j in range(len(y)):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and i + n not in used_x and j + n not in used_y:
                    n += 1
                if n >= least:
                    found.append((n, i, j))
        if not found:
            return out
        most = max(n for n, _, _ in found)
        for n, i, j in sorted(found, key=lambda f: f[1:]):
            if n == most and used_x.isdisjoint(range(i, i + n)) and used_y.isdisjoint(range(j, j + n)):
                used_x.update(range(i, i + n))
                used_y.update(range(j, j + n))
                out.append((i, j, n))


def test_tiles_are_the_plain_ones():
    rng = random.Random(4)
    for _ in range(120):
        x = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 25))]
        y = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 40))]
        big = 1 << 40
        got = tiles(np.array(x, np.uint64) + np.uint64(big), np.array(y, np.uint64) + np.uint64(big), 3)
        assert got == plain_tiles(x, y, 3)


def test_reordered_passage_counts_and_clean_stays(spark):
    item = [f"q{k}" for k in range(40)]
    swapped = item[20:] + ["between"] * 9 + item[:20]
    rows = [
        (1, " ".join(["pre"] * 30 + item + ["post"] * 30)), (2, " ".join(swapped)), (3, " ".join(item[:10] + ["z"] * 40)), (4, "nothing of it"),
        (5, ", ".join(w.upper() for w in item) + "!!"), (6, None), (7, ""), (None, " ".join(item)), (2, "no"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS coverage", "3 AS place")
    items = spark.createDataFrame([(9, " ".join(item), "?"), (10, "too short", "?"), (11, None, "?"), (12, "", "?"), (None, " ".join(item), "?"), (9, "other text of this very item", "?")], ITEMS)
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles, r.longest) for r in contaminated(docs, items).collect()}
    assert got == {(1, 9): (1.0, 1, 40), (2, 9): (1.0, 2, 20), (5, 9): (1.0, 1, 40)}
    kept = clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "6", "7", "None"]


def test_no_rows(spark):
    items = spark.createDataFrame([(1, "a b c d e f", "")], ITEMS)
    assert contaminated(no_documents(spark), items).count() == 0
    assert contaminated(odd_documents(spark), items.limit(0)).count() == 0
    assert clean_documents(odd_documents(spark), items.limit(0)).count() == odd_documents(spark).count()


def test_long_repeats(spark):
    docs = spark.createDataFrame([(1, "the " * 20000), (2, "a the " * 500)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the " * 30, "")], ITEMS)
    assert [r.doc_id for r in contaminated(docs, items).collect()] == [1]


def test_pairs_left_out_unread_are_not_contaminated(spark):
    """Every share of an item in a document, in one tile or many, against tiling all pairs."""
    rng = random.Random(11)
    items = [[f"i{n}w{rng.randrange(12)}" for _ in range(rng.randrange(4, 40))] for n in range(12)]
    docs = []
    for n in range(120):
        parts = []
        for item in rng.sample(items, 3):
            for _ in range(rng.randrange(1, 4)):
                a = rng.randrange(len(item))
                parts += [item[a : a + rng.randrange(2, 30)], [f"x{rng.randrange(9)}"] * rng.randrange(3)]
        docs.append((n, " ".join(w for part in parts for w in part)))
    table = spark.createDataFrame([(n, " ".join(item), "") for n, item in enumerate(items)], ITEMS)
    want = {}
    for n, text in docs:
        for k, item in enumerate(items):
            own = plain_tiles(item, text.split(), 4)
            if 100 * sum(t[2] for t in own) >= 50 * len(item):
                want[n, k] = (sum(t[2] for t in own) / len(item), len(own), own[0][2])
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles, r.longest) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()}
    assert want and len(want) < 120 * 12 and got == want
