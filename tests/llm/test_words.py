"""Word hashes agree with plain splitting."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from evalmill.llm.words import grams, read_words, short_gram


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("ab \n\té\x0b"), max_size=40), max_size=8), st.integers(1, 64))
def test_words_are_those_of_a_plain_split(column, size):
    seen = {}
    got = []
    for words in read_words(pa.array(column, pa.string()), size=size):
        for k in range(len(words)):
            got.append(words.of(k).tolist())
            own = (column[words.first + k] or "").encode().split()
            assert words.joined(k) == b" ".join(own)
            keep = np.arange(len(own)) % 3 != 1
            assert words.joined(k, keep) == b" ".join(w for w, stays in zip(own, keep, strict=True) if stays)
    assert len(got) == len(column)
    for text, own in zip(column, got, strict=True):
        plain = (text or "").encode().split()
        assert len(plain) == len(own)
        for word, value in zip(plain, own, strict=True):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_lower_case_is_a_to_z_only():
    (words,) = read_words(pa.array(["ABC abc ÉA éa"]), lower=True)
    a, b, c, d = words.hashes
    assert a == b and c != d


def test_grams_depend_on_the_sequence():
    hashes = np.arange(1, 200, dtype=np.uint64)
    for n in (3, 50):
        own = grams(hashes, n)
        assert len(own) == 199 - n + 1 and len(set(own.tolist())) == len(own)
        assert grams(hashes[10 : 10 + n], n)[0] == own[10]
    assert len(grams(hashes[:2], 3)) == 0
    assert short_gram(hashes[:2]) != short_gram(hashes[:3])


def test_long_texts_are_hashed_in_pieces():
    """The same hashes as in one piece, for little memory: 24 bytes a word, and the text."""
    import tracemalloc

    text = ("word " * 5 + "x" * 300 + " ") * 30000
    (one,) = read_words(pa.array([text]), size=1 << 30)
    tracemalloc.start()
    (many,) = read_words(pa.array([text]), size=1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (one.hashes == many.hashes).all() and peak < 4 * len(text)
    assert (grams(one.hashes, 50) == grams(many.hashes, 50)).all()
