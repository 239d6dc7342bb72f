"""Substring dedup against all windows."""

import hashlib
import random

from evalmill.llm.substring_dedup import COVER, PERIOD, WINDOW, repeats_removed

from .helpers import no_documents, odd_documents


def plain(rows):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in split:
        for k in range(len(words) - WINDOW + 1):
            if i is not None:
                key = tuple(words[k : k + WINDOW])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - WINDOW + 1):
            if i is not None and first[tuple(words[k : k + WINDOW])] < i:
                gone.update(range(k, k + WINDOW))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats_removed(df).collect()), key=str)


def test_cover_holds_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_odd_rows(spark):
    df = odd_documents(spark)
    assert got(df) == plain([(r.doc_id, r.text) for r in df.collect()])


def test_no_rows(spark):
    assert repeats_removed(no_documents(spark)).count() == 0


def test_passages_at_any_shift(spark):
    """Passages of 49, 50 and more words at random places, some inside one another."""
    rng = random.Random(5)
    word = lambda: f"k{rng.randrange(10**6)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 64, 90, 200)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            at = rng.randrange(len(words) + 1)
            a = rng.randrange(max(1, len(p) - 60))
            words[at:at] = p[a : a + rng.randrange(45, len(p) + 1)]
        rows.append((rng.randrange(10**6), " ".join(words)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_a_text_of_tens_of_megabytes(spark):
    """A long text that shares a passage with a short one, and its own copy."""
    words = [f"w{k * 7919 % 10000019}" for k in range(2_500_000)]
    text = " ".join(words)
    short = " ".join(["a"] * 9 + words[1_000_000:1_000_070] + ["b"] * 9)
    df = spark.createDataFrame([(1, short), (2, text), (3, text)], "doc_id long, text string")
    kept = " ".join(words[:1_000_000] + words[1_000_070:]).encode()
    empty = hashlib.sha256(b"").hexdigest()
    want = [(1, 88, 0, hashlib.sha256(short.encode()).hexdigest()), (2, len(words), 70, hashlib.sha256(kept).hexdigest()), (3, len(words), len(words), empty)]
    assert got(df) == want
