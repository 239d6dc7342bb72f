"""The n-gram Jaccard join against all pairs."""

import random
import string
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from evalmill.llm.ngram_join import first_of_each, jaccard_components, prefixes, profile, rarity, suffix_differs

from .helpers import components_of, no_documents, odd_documents, texts

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    words = [w.decode() for w in (text or "").translate(LOWER).encode().split()]
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def plain(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    known = [(i, s) for i, s in sets if i is not None]
    links = [(a, b) for (a, x), (b, y) in combinations(known, 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    top = components_of({i for i, _ in known}, links)
    return sorted(((i, len(s), top.get(i)) for i, s in sets), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=str)


def test_odd_rows(spark):
    df = odd_documents(spark)
    assert got(df) == plain(texts(df))
    kept = first_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 5, 6, 7, 8, None} and 2 not in {r.doc_id for r in kept.collect()}


def test_no_rows(spark):
    assert jaccard_components(no_documents(spark)).count() == 0


def test_random_families(spark):
    """Families of near copies around the threshold, shared openings, sizes that differ by a fifth."""
    rng = random.Random(11)
    rows, words = [], [f"v{k}" for k in range(3000)]
    opening = [rng.choice(words) for _ in range(25)]
    for _ in range(25):
        base = opening * rng.randrange(2) + [rng.choice(words) for _ in range(rng.randrange(6, 150))]
        for _ in range(rng.randrange(1, 9)):
            own = base[: rng.randrange(int(len(base) * 0.75), len(base) + 1)]
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == plain(rows)


def test_chain_between_components(spark):
    """Links that the smallest document of a group does not have are found in the second round."""
    rng = random.Random(2)
    base = [f"u{k}" for k in range(200)]
    rows = []
    for step in range(12):
        rows.append((step, " ".join(base)))
        for _ in range(3):
            base[rng.randrange(200)] = f"n{rng.random()}"
    order = list(range(12))
    rng.shuffle(order)
    rows = [(order[i], t) for i, t in rows]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_suffix_filter_never_drops_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rng.integers(0, 300, 80))
        y = np.unique(np.concatenate([rng.permutation(x)[: rng.integers(1, len(x))], rng.integers(0, 300, rng.integers(0, 30))]))
        apart = len(np.setxor1d(x, y))
        assert not suffix_differs(x, y, apart)


def test_boilerplate_stays_out_of_prefixes(spark):
    """A passage that every tenth document holds is common at any size, and only rare shingles form groups."""
    rng = random.Random(8)
    passage = " ".join(f"legal{k}" for k in range(40))
    for n in (300, 3000):
        rows = []
        for k in range(n):
            own = " ".join(f"q{rng.randrange(10**7)}" for _ in range(80))
            rows.append((k, f"{own} {passage}" if k % 10 == 0 else own))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        _, totals = profile(df, 5)
        common = rarity(totals, n)
        assert len(common[0]) >= 36 and (common[1] > 0).all()
        groups = prefixes(df, 5, 80, spark.sparkContext.broadcast(common)).groupBy("tok").count()
        assert groups.agg(F.max("count")).first()[0] <= 2


def test_a_text_of_tens_of_megabytes(spark):
    words = [f"w{k * 7919 % 10000019}" for k in range(2_000_000)]
    changed = words[:1000] + ["new"] + words[1001:]
    df = spark.createDataFrame([(3, " ".join(words)), (2, " ".join(changed).upper()), (1, " ".join(words[:500_000]))], "doc_id long, text string")
    first = len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    (a, b, c) = got(df)
    assert a[2] == 1 and b[2] == c[2] == 2 and c == (3, first, 2)
