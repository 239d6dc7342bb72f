"""Substring dedup with difference-cover anchors.

A passage of ``WINDOW`` words that repeats across documents is removed from all but the
smallest doc_id it starts in. Shorter windows, of ANCHOR words, are hashed only where the
word position modulo PERIOD lies in COVER. COVER is a difference cover: for any two
positions some shift below PERIOD brings both into it, so two equal passages of WINDOW words
always share an aligned anchor. Anchors that occur in one document only are dropped. Around
the others each document is extended to all windows of WINDOW words that hold a shared
anchor; the smallest document of each such window decides what goes.

A document whose words all equal those of a smaller one is decided as a whole. Smallest
documents are combined before the shuffle and joined back, so a passage or document that a
third of all rows share is never one group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.common import staged, texts_of, unstaged
from evalmill.llm.words import OTHER_BASE, Words, grams, read_words

WINDOW = 50
PERIOD = 31
#: Every residue modulo PERIOD is a difference of two of these.
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1

_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def anchor_places(words: Words, k: int) -> np.ndarray:
    """Places, in the chunk, of one text's anchors."""
    a, b = words.bounds[k], words.bounds[k + 1]
    if b - a < WINDOW:
        return np.zeros(0, np.int64)
    at = np.arange(b - a - ANCHOR + 1)
    return a + at[_IN_COVER[at % PERIOD]]


def word_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, words_sha256) of every row; words joined by one space."""

    def run(batches):
        for batch in batches:
            sizes, digests = [], []
            for words in read_words(batch.column(1), hashed=False):
                sizes += np.diff(words.bounds).tolist()
                digests += [hashlib.sha256(words.joined(k)).hexdigest() for k in range(len(words))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "words_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_words long, words_sha256 string")


def anchors(docs: DataFrame) -> DataFrame:
    """(h, doc): hashes of each document's anchors, each once."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for words in read_words(batch.column(1)):
                every = grams(words.hashes, ANCHOR)
                own = [np.unique(every[anchor_places(words, k)]) for k in range(len(words))]
                docs_of = np.repeat(ids[words.first : words.first + len(words)], [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(docs_of)], names=["h", "doc"])

    return docs.mapInArrow(run, "h long, doc long")


def shared_only(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, lo): hashes that occur in several documents, with the smallest.

    Written out, so that a join with them is one of two exchanges, which Spark can split by skew.
    """
    return staged(rows.groupBy(*keys).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select(*keys, "lo"), "shared")


def extended(rows: DataFrame) -> DataFrame:
    """(h, g, doc): the windows of WINDOW words around each document's shared anchors, by two hashes.

    ``rows`` is (doc_id, text, hashes of shared anchors).
    """

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            shared = batch.column(2)
            for words in read_words(batch.column(1)):
                small, large, other = grams(words.hashes, ANCHOR), grams(words.hashes, WINDOW), grams(words.hashes, WINDOW, OTHER_BASE)
                own, more, sizes = [], [], []
                for k in range(len(words)):
                    a, b = words.bounds[k], words.bounds[k + 1]
                    places = anchor_places(words, k)
                    known = np.asarray(shared[words.first + k].values, dtype=np.int64).view(np.uint64)
                    places = places[np.isin(small[places], known)]
                    near = np.zeros(b - a + 1, dtype=np.int64)
                    np.add.at(near, np.maximum(places - a - (WINDOW - ANCHOR), 0), 1)
                    np.add.at(near, places - a + 1, -1)
                    starts = a + np.flatnonzero(np.cumsum(near)[: max(b - a - WINDOW + 1, 0)] > 0)
                    found, at = np.unique(large[starts], return_index=True)
                    own.append(found)
                    more.append(other[starts[at]])
                    sizes.append(len(found))
                docs_of = np.repeat(ids[words.first : words.first + len(words)], sizes)
                hashes = [pa.array(np.concatenate(x).view(np.int64)) for x in (own, more)]
                yield pa.RecordBatch.from_arrays([*hashes, pa.array(docs_of)], names=["h", "g", "doc"])

    return rows.mapInArrow(run, "h long, g long, doc long")


def cut(rows: DataFrame) -> DataFrame:
    """(doc_id, words_sha256, n_removed, kept) of (doc_id, text, hashes of windows to remove)."""

    def run(batches):
        for batch in batches:
            hashes = batch.column(2)
            for words in read_words(batch.column(1)):
                large = grams(words.hashes, WINDOW)
                columns = [[], [], [], []]
                for k in range(len(words)):
                    a, b = words.bounds[k], words.bounds[k + 1]
                    gone = np.asarray(hashes[words.first + k].values, dtype=np.int64).view(np.uint64)
                    starts = np.flatnonzero(np.isin(large[a : max(b - WINDOW + 1, a)], gone))
                    cover = np.zeros(b - a + 1, dtype=np.int64)
                    cover[starts] += 1
                    np.add.at(cover, starts + WINDOW, -1)
                    keep = np.cumsum(cover)[: b - a] == 0
                    values = (
                        batch.column(0)[words.first + k].as_py(),
                        hashlib.sha256(words.joined(k)).hexdigest(),
                        int((~keep).sum()),
                        words.joined(k, keep).decode(errors="replace"),
                    )
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["doc_id", "words_sha256", "n_removed", "kept"])

    return rows.mapInArrow(run, "doc_id long, words_sha256 string, n_removed long, kept string")


def hashes_by_document(hashes: DataFrame) -> DataFrame:
    """(doc_id, hs) of rows (h, doc): a list that grows with its document's text only."""
    return staged(hashes.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("h").alias("hs")), "hashes-by-document")


def with_hashes(docs: DataFrame, per_doc: DataFrame) -> DataFrame:
    """(doc_id, text, hs) of the documents in (doc_id, hs)."""
    return texts_of(docs, per_doc.select("doc_id")).join(per_doc, "doc_id").select("doc_id", "text", "hs")


def repeats_removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row of ``docs`` (doc_id, text).

    Words are runs of bytes other than space and U+0009..U+000D, unchanged. A word is removed
    if a window of WINDOW words that covers it also starts in a document with a smaller
    doc_id; windows are judged on the input. ``kept`` is the rest, joined by one space; it is
    null where nothing is removed or nothing is left.

    A null text has no words; texts of fewer than WINDOW words stay whole. Rows that repeat a
    doc_id are judged one by one, and never against each other. Rows without a doc_id keep
    all words and remove none elsewhere. Very long texts are read a piece at a time; a task holds
    the text, the places and hashes of its words. Windows are told apart by two hashes of 64 bits.
    Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digests = staged(word_digests(docs), "word-digests")
    first = staged(digests.filter("doc_id is not null").groupBy("words_sha256").agg(F.min("doc_id").alias("first")), "first-copies")
    rows = digests.join(first, "words_sha256", "left").withColumn("copy", F.coalesce((F.col("first") < F.col("doc_id")) & (F.col("n_words") >= WINDOW), F.lit(False)))
    rows = staged(rows.drop("first"), "copies")
    unstaged(digests, first)
    copies = rows.groupBy(F.col("doc_id").alias("doc")).agg(F.min(F.col("copy").cast("int")).alias("all_copies")).filter("all_copies = 1").select("doc")

    known = docs.filter("doc_id is not null")
    every = anchors(known)
    shared = shared_only(every, "h")
    hits = hashes_by_document(every.join(shared.select("h"), "h").join(copies, "doc", "left_anti"))
    unstaged(shared)
    windows = staged(extended(with_hashes(known, hits)), "windows")
    unstaged(hits)
    shared = shared_only(windows, "h", "g")
    gone = hashes_by_document(windows.join(shared, ["h", "g"]).filter("doc > lo").select("h", "doc"))
    unstaged(windows, shared)
    cuts = staged(cut(with_hashes(known, gone)).dropDuplicates(["doc_id", "words_sha256"]), "cuts")
    unstaged(gone)
    empty = hashlib.sha256(b"").hexdigest()
    out = rows.join(cuts, ["doc_id", "words_sha256"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce(F.sha2("kept", 256), "words_sha256")).alias("kept_sha256"),
        F.when(~F.col("copy"), F.col("kept")).alias("kept"),
    )
