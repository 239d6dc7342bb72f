"""Language identification of spans.

Each language has a table of byte n-gram scores, learned by counting over all training
texts. A word's score in a language is the sum over its n-grams. The scripts of a word's
letters narrow the languages it may be in: those whose training letters hold that script at
least to SCRIPT_SHARE. A Viterbi pass over the words of a document, with a penalty for each
switch, labels spans of one language; the document gets the language with the most letters
in its spans.

Counting and scoring walk over the bytes of all distinct words of a chunk at once, and the Viterbi
pass takes one step for all documents of a chunk that are still running; documents in which no
stretch can pay for a switch are left out of it.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.common import held_out
from evalmill.llm.words import Words, mix, read_words

#: Hashed n-gram counters of a language: 65,536 numbers, whatever the corpus.
BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
#: Cost of a switch, in nats.
SWITCH = 12.0
#: Share of a language's letters that a script needs to be one of its own.
SCRIPT_SHARE = 0.001
#: Bytes scored at a time.
CHUNK_BYTES = 1 << 21
#: First code point of each script range and its name: the common alphabets; other letters are "other".
#: What a letter is, is told by its Unicode category alone.
SCRIPTS = (
    (0x00, "none"), (0x41, "latin"), (0x5B, "none"), (0x61, "latin"), (0x7B, "none"), (0xAA, "latin"), (0xAB, "none"), (0xB5, "greek"),
    (0xB6, "none"), (0xBA, "latin"), (0xBB, "none"), (0xC0, "latin"), (0xD7, "none"), (0xD8, "latin"), (0xF7, "none"), (0xF8, "latin"),
    (0x250, "latin"), (0x2B0, "none"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x700, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "other"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFE10, "none"), (0xFF66, "kana"),
    (0xFFA0, "other"), (0xFFE0, "none"), (0x10000, "other"), (0x1F000, "none"), (0x20000, "han"), (0x30000, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS} - {"none"})

_FIRST = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(name) if name != "none" else -1 for _, name in SCRIPTS])


def lowered(column: pa.Array) -> pa.Array:
    """Texts in lower case; null is empty."""
    return pa.array([(t or "").lower() for t in column.to_pylist()], pa.large_string())


@lru_cache(maxsize=1)
def scripts() -> np.ndarray:
    """Script of every code point that is a letter (categories L), -1 of all others: 1.1 MB."""
    points = np.arange(sys.maxunicode + 1)
    script = _SCRIPT[np.searchsorted(_FIRST, points, side="right") - 1].astype(np.int8)
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in points), dtype=bool, count=len(points))
    return np.where(letter, np.where(script < 0, NAMES.index("other"), script), -1).astype(np.int8)


def letter_scripts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, script) of every letter of the chunk."""
    data = words.data.astype(np.int64)
    n = len(data)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(3, np.int64)])
    b = padded[lead]
    rest = [padded[lead + k] & 0x3F for k in (1, 2, 3)]
    point = np.where(b < 0x80, b, np.where(b < 0xE0, (b & 0x1F) << 6 | rest[0], np.where(b < 0xF0, (b & 0x0F) << 12 | rest[0] << 6 | rest[1], (b & 7) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2])))
    script = scripts()[np.minimum(point, sys.maxunicode)].astype(np.int64)
    letters = script >= 0
    of = np.zeros(n + 1, dtype=np.int64)
    of[words.starts] = 1
    return np.cumsum(of)[lead[letters]] - 1, script[letters]


def distinct(words: Words, kinds: np.ndarray | None = None) -> tuple[Words, np.ndarray, np.ndarray]:
    """Each word once (once for each of its ``kinds``), told apart by 64-bit hashes; where it is first, and which one each word is."""
    which, _ = pd.factorize(words.hashes if kinds is None else mix(words.hashes) + mix(kinds))
    first = np.empty(which.max() + 1, dtype=np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    lengths = (words.ends - words.starts)[first]
    ends = np.cumsum(lengths)
    data = words.data[np.repeat(words.starts[first] - ends + lengths, lengths) + np.arange(ends[-1])]
    return Words(0, np.array([0, len(first)]), words.hashes[first], ends - lengths, ends, data, np.array([0, ends[-1]])), first, which


def gram_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of bytes; words are framed by a blank on both sides."""
    lengths = words.ends - words.starts + 2
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    framed = np.full(total + max(GRAMS), 32, dtype=np.uint64)
    inner = np.arange(total) - np.repeat(ends - lengths, lengths)
    of = np.repeat(np.arange(len(lengths)), lengths)
    own = (inner > 0) & (inner < np.repeat(lengths, lengths) - 1)
    framed[:total][own] = words.data[(np.repeat(words.starts, lengths) + inner - 1)[own]]
    left = np.repeat(lengths, lengths) - inner
    out_word, out_bucket = [], []
    value = np.zeros(total, dtype=np.uint64)
    for k in range(max(GRAMS)):
        value = value << np.uint64(8) | framed[k : k + total]
        if k + 1 in GRAMS:
            fits = left > k
            out_word.append(of[fits])
            out_bucket.append((mix(value[fits] + (np.uint64(k + 1) << np.uint64(56))) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(out_word), np.concatenate(out_bucket)


def counts(train: DataFrame) -> DataFrame:
    """(lang, bucket, total) over all training texts: n-gram counters, then letters by script (negative buckets)."""

    def run(batches):
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for words in read_words(lowered(batch.column(1)), size=CHUNK_BYTES):
                if not len(words.starts):
                    continue
                names = sorted(set(langs[words.first : words.first + len(words)]))
                code = np.array([names.index(x) for x in langs[words.first : words.first + len(words)]])
                lang = np.repeat(code, np.diff(words.bounds))
                words, first, which = distinct(words, lang)
                lang, times = lang[first], np.bincount(which)
                word, bucket = gram_buckets(words)
                letter, script = letter_scripts(words)
                lettered = np.zeros(len(lang), dtype=bool)
                lettered[letter] = True
                keep = lettered[word]
                width = BUCKETS + len(NAMES)
                found = np.bincount(lang[word[keep]] * width + bucket[keep], weights=times[word[keep]], minlength=len(names) * width)
                found += np.bincount(lang[letter] * width + BUCKETS + script, weights=times[letter], minlength=len(names) * width)
                found = found.astype(np.int64)
                for k, name in enumerate(names):
                    own[name] = own.get(name, 0) + found[k * width : (k + 1) * width]
        for name, total in own.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(total[used])], names=["lang", "bucket", "total"])

    rows = train.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, bucket long, total long").groupBy("lang", "bucket").agg(F.sum("total").alias("total"))


def learned(train: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores (bucket x language) and whether a script is a language's own (script x language)."""
    found = counts(train).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.zeros((BUCKETS + len(NAMES), len(langs)))
    table[found["bucket"].to_numpy(np.int64), [langs.index(x) for x in found["lang"]]] = found["total"]
    grams, letters = table[:BUCKETS], table[BUCKETS:]
    smooth = 0.5
    scores = np.log(grams + smooth) - np.log(grams.sum(axis=0) + smooth * BUCKETS)
    own = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    return langs, scores.astype(np.float32), own


def without_switch(scores: np.ndarray, bounds: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """Best single language of each document, and whether its best path surely stays there.

    It does if the language leads all others by more than half of ``switch`` and no stretch of
    words gains as much by leaving it for the best other language of each word: each such
    stretch costs a switch. The other half is left to rounding.
    """
    lengths = np.diff(bounds)
    best, sure = np.zeros(len(lengths), dtype=np.int64), lengths == 0
    own = np.flatnonzero(lengths)
    if scores.shape[1] == 1 or not len(own):
        return best, np.ones(len(lengths), dtype=bool)
    totals = np.add.reduceat(scores, bounds[own], axis=0, dtype=np.float64)
    best[own] = totals.argmax(axis=1)
    lead = np.sort(totals, axis=1)
    at = np.repeat(best, lengths)[:, None]
    others = scores.copy()
    np.put_along_axis(others, at, -np.inf, axis=1)
    gain = others.max(axis=1).astype(np.float64) - np.take_along_axis(scores, at, axis=1)[:, 0]
    total = np.cumsum(gain)
    apart = np.ptp(total) + np.abs(gain).max() + 1  # puts the sums of a document below those of all before it
    total -= np.repeat(np.arange(len(lengths)), lengths) * apart
    most = np.maximum.reduceat(total - np.minimum.accumulate(total - gain), bounds[own])
    sure[own] = (lead[:, -1] - lead[:, -2] > switch / 2) & (most < switch / 2)
    return best, sure


def best_path(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """Language of each word on the best path of each document."""
    best, sure = without_switch(scores, bounds, switch)
    lengths = np.diff(bounds)
    path = np.repeat(best, lengths)
    if not sure.all():
        rest = np.repeat(~sure, lengths)
        path[rest] = viterbi(scores[rest], np.concatenate([[0], np.cumsum(lengths[~sure])]), switch)
    return path


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """Best path of each document, all documents a step at a time."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    path = np.zeros(len(scores), dtype=np.int64)
    back = np.zeros(scores.shape, dtype=np.min_scalar_type(scores.shape[1]))
    if not len(sizes) or not sizes[0]:
        return path
    live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] + 1), side="right")  # documents longer than each step
    starts, rows, langs = bounds[order], np.arange(len(order)), np.arange(scores.shape[1])
    now = scores[starts[: live[0]]]
    end = np.zeros((len(order), scores.shape[1]), dtype=scores.dtype)
    for step in range(int(sizes[0])):
        running, left = live[step], live[step + 1]
        if step:
            at = starts[:running] + step
            best = now.argmax(axis=1)
            floor = (now[rows[:running], best] - switch)[:, None]
            back[at] = np.where(now >= floor, langs, best[:, None])
            now = np.maximum(now, floor) + scores[at]
        if left < running:
            end[left:running] = now[left:]
            now = now[:left]
    last = end.argmax(axis=1)
    state = last.copy()
    for step in range(int(sizes[0]) - 1, -1, -1):
        own = state[: live[step]]
        at = starts[: live[step]] + step
        path[at] = own
        if step:
            state[: live[step]] = back[at, own]
    return path


def labelled_words(words: Words, scores: np.ndarray, own: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, letters and score by language of each word; a word without letters keeps its neighbour's."""
    once, _, which = distinct(words)
    n, langs = len(once.starts), scores.shape[1]
    word, bucket = gram_buckets(once)
    letter, script = letter_scripts(once)
    letters = np.bincount(letter, minlength=n)
    value = np.stack([np.bincount(word, weights=scores[bucket, k], minlength=n) for k in range(langs)], axis=1)
    fits = np.zeros((n, langs))
    for s in np.unique(script):
        held = np.bincount(letter[script == s], minlength=n)
        fits += held[:, None] * own[s]
    allowed = fits >= fits.max(axis=1, keepdims=True)  # narrowed by the scripts of its letters
    value = np.where(allowed, value, value - 50.0)
    value[letters == 0] = 0
    return best_path(value.astype(np.float32)[which], words.bounds, switch), letters[which], value[which]


def identify(docs: DataFrame, train: DataFrame, switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """Language of every row of ``docs`` (doc_id, text), learned from ``train`` (lang, text).

    Gives doc_id, lang_pred and score, the share of the document's letters that lie in spans
    of that language; with ``spans`` also spans, an array of (word, words, lang): first word,
    number of words and language of each span of one language.

    A text without a letter (Unicode categories L), an empty or a null text has lang_pred ``und``, score 0 and no
    spans, as has every text if there is nothing to learn from. Equal shares go to the
    language that sorts first. Rows that repeat a doc_id are labelled one by one; training
    rows without text or lang are passed over. Other columns are not read.
    """
    langs, scores, own = learned(train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    shared = docs.sparkSession.sparkContext.broadcast((scores, own))

    def run(batches):
        for batch in batches:
            for words in read_words(lowered(batch.column(1)), size=CHUNK_BYTES):
                n = len(words)
                names, share, found = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
                if langs and len(words.starts):
                    path, letters, _ = labelled_words(words, *shared.value, switch)
                    doc = np.repeat(np.arange(n), np.diff(words.bounds))
                    held = np.bincount(doc * len(langs) + path, weights=letters, minlength=n * len(langs)).reshape(n, -1)
                    best, total = held.argmax(axis=1), held.sum(axis=1)
                    for k in np.flatnonzero(total > 0):
                        names[k], share[k] = langs[best[k]], held[k, best[k]] / total[k]
                        if spans:
                            own_path = path[words.bounds[k] : words.bounds[k + 1]]
                            cuts = np.flatnonzero(np.r_[True, own_path[1:] != own_path[:-1]])
                            found[k] = [{"word": int(a), "words": int(b - a), "lang": langs[own_path[a]]} for a, b in zip(cuts, np.r_[cuts[1:], len(own_path)], strict=True)]
                columns = [batch.column(0).slice(words.first, n), pa.array(names, pa.string()), pa.array(share)]
                if spans:
                    columns.append(pa.array(found, pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<word:bigint,words:bigint,lang:string>>" if spans else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned outside the test fold.

    A row without a doc_id is in no fold: it is labelled, and learned from if it has a lang.
    """
    found = identify(docs, docs.filter(~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
