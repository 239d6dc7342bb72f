"""Language identification: held-out accuracy, spans, scripts, best paths against all paths."""

from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa

from evalmill.llm.language_id import BUCKETS, best_path, counts, distinct, gram_buckets, identify, language_report, letter_scripts, viterbi, without_switch
from evalmill.llm.words import read_words

from .helpers import no_documents, odd_documents

TRAIN = [
    ("en", "the cat and the dog went over there with their other brother to see what this thing was"),
    ("de", "der hund und die katze gingen über die straße und sahen nicht was dort auf sie zukam weil es schneite"),
    ("fr", "le chat et le chien étaient dans la maison où les enfants jouaient avec leur mère pendant que"),
    ("ru", "кошка и собака пошли через дорогу чтобы увидеть что там было на другой стороне"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string")


def test_spans_of_mixed_text(spark):
    train = frame(spark, TRAIN)
    mixed = " ".join([TRAIN[0][1], TRAIN[1][1], TRAIN[3][1]])
    docs = spark.createDataFrame([(1, mixed), (2, TRAIN[2][1] + " 123"), (3, None), (4, "12 !!"), (5, ""), (6, "собака"), (None, "the cat")], "doc_id long, text string")
    got = {r.doc_id: r for r in identify(docs, train, spans=True).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de", "ru"] and sum(s.words for s in got[1].spans) == len(mixed.split())
    assert got[2].lang_pred == "fr" and got[2].score == 1.0 and got[6].lang_pred == "ru" and got[None].lang_pred == "en"
    assert all((got[k].lang_pred, got[k].score, got[k].spans) == ("und", 0.0, []) for k in (3, 4, 5))


def test_best_path_is_the_best_of_all(spark):
    rng = np.random.default_rng(2)
    lengths = [0, 1, 5, 3, 0, 6]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=(bounds[-1], 3)) * 2
    path = best_path(scores, bounds, 1.5)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        def worth(p, a=a, b=b):
            return scores[np.arange(a, b), list(p)].sum() - 1.5 * sum(x != y for x, y in zip(p[1:], p[:-1], strict=True))

        if b > a:
            assert np.isclose(worth(path[a:b]), max(worth(p) for p in product(range(3), repeat=b - a)))


def test_best_path_with_many_languages():
    """More languages than a byte counts."""
    rng = np.random.default_rng(5)
    scores = rng.normal(size=(40, 300))
    scores[:20, 290] += 9
    scores[20:, 135] += 9
    assert best_path(scores, np.array([0, 40]), 3.0).tolist() == [290] * 20 + [135] * 20


def test_letters_are_told_by_their_category(spark):
    """Letters of any script are letters; digits, marks and punctuation of any script are none."""
    letters = ["ⵜⴰⵎⴰⵣⵉⵖⵜ", "ⲁⲃⲅ", "ｆｕｌｌ", "ℕ", "𝓍", "ª", "中", "𐐷"]
    others = ["١٢٣", "१२३", "๑๒๓", "،", "۔", "₅", "½", "٪", "́", "😀", "① ②", "—"]
    docs = spark.createDataFrame(list(enumerate(letters + others)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in identify(docs, frame(spark, TRAIN)).collect()}
    assert all(got[k] != "und" for k in range(len(letters)))
    assert all(got[len(letters) + k] == "und" for k in range(len(others)))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 250 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_odd_rows(spark):
    df = odd_documents(spark)
    got = language_report(df).collect()
    assert len(got) == df.count() and {r.lang_pred for r in got} == {"en", "und"}
    assert language_report(no_documents(spark)).count() == 0
    assert {r.lang_pred for r in identify(df, df.limit(0)).collect()} == {"und"}


def test_documents_without_a_switch_are_found(spark):
    """Where one language surely holds, the walk is left out; its path is the same."""
    rng = np.random.default_rng(8)
    found = 0
    for langs in (1, 2, 5):
        for _ in range(40):
            bounds = np.concatenate([[0], np.cumsum(rng.integers(0, 25, size=9))])
            scores = (rng.normal(size=(bounds[-1], langs)) * 3).astype(np.float32)
            scores[:, rng.integers(langs)] += rng.integers(0, 4)
            best, sure = without_switch(scores, bounds, 8.0)
            path = viterbi(scores, bounds, 8.0)
            assert (path == best_path(scores, bounds, 8.0)).all()
            for k in np.flatnonzero(sure):
                assert (path[bounds[k] : bounds[k + 1]] == best[k]).all()
            found += sure.sum()
    assert found > 300


def test_words_are_scored_once(spark):
    """Copies of a word are one word in scoring and learning; learned counts are those of all words."""
    text = "The cat, the ёж — the cat 12 12 cat"
    (words,) = read_words(pa.array([text, text, "ёж the"]))
    once, first, which = distinct(words)
    said = [w for t in (text, text, "ёж the") for w in t.split()]
    assert [once.data[a:b].tobytes().decode() for a, b in zip(once.starts, once.ends, strict=True)] == list(dict.fromkeys(said))
    assert [said[first[k]] for k in which] == said
    kinds = np.arange(len(said)) % 2
    assert len(distinct(words, kinds)[0].starts) == len(set(zip(said, kinds, strict=True)))
    rows = [("a", text), ("b", text), ("a", "ёж the")]
    got = {(r.lang, r.bucket): r.total for r in counts(frame(spark, rows)).collect()}
    want = Counter()
    for lang, t in rows:
        (own,) = read_words(pa.array([t.lower()]))
        word, bucket = gram_buckets(own)
        letter, script = letter_scripts(own)
        want.update((lang, b) for w, b in zip(word, bucket, strict=True) if w in letter)
        want.update((lang, BUCKETS + s) for s in script)
    assert got == want
