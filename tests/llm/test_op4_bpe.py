"""Encoding and decoding against the tokenizers library."""

import hashlib
import random
import struct

import numpy as np
import pytest

from evalmill.llm.bpe import Lexicon, Vocabulary, decoded, encoded, merge_word
from evalmill.llm.queries import vocabulary_path

from .helpers import SF, no_documents, odd_documents

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(vocabulary_path())


def odd_texts():
    rng = random.Random(1)
    out = ["", "Hello  World's the\ncat I'LL 123 ab!!", "<|startoftext|>a<|endoftext|> b<|endoftext|>'s", "İ ΑΣ Σ. x\x1cy\x85z\xa0w café", "日本語 ① ½ ²³﻿ 😀", "a" * 3000, "\x00\x01 a\x0b"]
    for _ in range(80):
        out.append("".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(80)))
    return out


def test_ids_and_texts_are_the_library_s(spark, library):
    docs = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string")
    docs = docs.union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    texts = dict(docs.collect())
    got = encoded(docs, vocabulary_path(), size=300)
    for r in got.collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
    for r in decoded(got, vocabulary_path()).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.text == library.decode(ids, skip_special_tokens=False)


def test_digests_and_odd_rows(spark, library):
    df = odd_documents(spark)
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    for size in (0, 5, 100_000):
        got = [tuple(r) for r in encoded(df, vocabulary_path(), size=size, digests=True).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert encoded(no_documents(spark), vocabulary_path(), digests=True).count() == 0


def test_lexicon_is_minimal_and_exact(vocabulary):
    words = [a + b + c for a in ("", "un", "re") for b in ("do", "make", "tie") for c in ("", "s", "ing", "é")]
    flat = Lexicon.compile({w: merge_word(w, vocabulary) for w in words})
    lexicon = Lexicon(flat)
    order = sorted(w.encode() for w in words)
    assert [order[k] for k in lexicon.ranks([w.encode() for w in words])] == [w.encode() for w in words]
    for w, k in zip(words, lexicon.ranks([w.encode() for w in words]), strict=True):
        assert lexicon.ids[lexicon.starts[k] : lexicon.starts[k + 1]].tolist() == merge_word(w, vocabulary)
    assert (lexicon.ranks([b"", b"d", b"dos!", b"und", b"\xff"]) == -1).all()
    # states of a minimal automaton are told apart by the words behind them
    behind = {}
    for w in order:
        for k in range(len(w) + 1):
            behind.setdefault(w[:k], set()).add(w[k:])
    assert int(flat[1]) == len({frozenset(s) for s in behind.values()})
    assert (Lexicon(Lexicon.compile({})).ranks([b"a"]) == np.array([-1])).all()
