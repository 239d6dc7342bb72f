"""Byte-pair encoding and decoding with a minimal acyclic transducer for frequent words.

The words of all documents are counted. The most frequent ones are compiled into a minimal
acyclic automaton that shares prefixes and suffixes; summing what its arcs skip gives a
word's rank among the compiled ones, and the rank points at the word's ids. The automaton is
a flat array of numbers, sent to the executors as a file that all workers of a machine map
into memory, and it is walked for all distinct words of a chunk of texts at once. A word that
it does not hold is merged exactly, pair by pair, lowest rank first.

A vocabulary file is a tokenizers JSON: NFC, white space, lower case, a word pattern, bytes,
merges with a word-end mark. Ids equal those of that library for ordinary text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm.common import staged, workspace
from evalmill.llm.words import chunks, text_bytes

#: Most words compiled into the lexicon, by frequency over all documents: a few MB whatever the corpus.
LEXICON_WORDS = 100_000
#: Exact merges kept for reuse by a worker.
KEPT_MERGES = 200_000
#: Distinct words counted in a task's memory before they are passed on.
KEPT_COUNTS = 300_000
#: Letters up to which a word's pairs are looked through anew after each merge; a heap keeps longer ones.
SHORT = 32
#: Bytes of text encoded at a time.
CHUNK_BYTES = 4 << 20

_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_ANY = regex.compile(_ENDINGS + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Python's tables know every code point below U+0378.
_LATER = re.compile("[\u0378-\U0010ffff]")
_ASCII = re.compile(_ENDINGS + r"|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, fresh = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(fresh)
            fresh += 1
    return [out[b] for b in range(256)]


@dataclass
class Vocabulary:
    """Ids of pieces, ranks of merges and special strings of one vocabulary file."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    specials: dict[str, int]
    end: str
    source: str

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            source = f.read()
        found = json.loads(source)
        model, added = found["model"], found["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special tokens are taken from the raw text only")
        ranks = {tuple(m): k for k, m in enumerate(model["merges"])}
        return cls(model["vocab"], ranks, {t["content"]: t["id"] for t in added}, model["end_of_word_suffix"], source)

    def pieces(self) -> list[str]:
        """The string of each id."""
        every = self.ids | self.specials
        out = [""] * (max(every.values()) + 1)
        for piece, k in every.items():
            out[k] = piece
        return out


_LETTERS = byte_letters()


def words_of(text: str) -> list[str]:
    """Words of a text without special strings, as the vocabulary's pre-tokenizer splits it."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _ANY.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


def unassigned() -> re.Pattern:
    """Code points without a category in Python's Unicode tables, where libraries differ in versions."""
    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    breaks = [k for k in range(1, len(points)) if points[k] != points[k - 1] + 1]
    runs = zip([0, *breaks], [*breaks, len(points)], strict=True)
    return re.compile("[" + "".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" for a, b in runs) + "]")


def merge_word(word: str, vocabulary: Vocabulary) -> list[int]:
    """Exact merges of one word: the pair of lowest rank first, the leftmost of equals."""
    parts = [_LETTERS[b] for b in word.encode()]
    parts[-1] += vocabulary.end
    n, ranks = len(parts), vocabulary.ranks
    if n <= SHORT:
        none = len(ranks)
        while n > 1:
            known = [ranks.get(pair, none) for pair in zip(parts, parts[1:])]
            least = min(known)
            if least == none:
                break
            k = known.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            n -= 1
        return [vocabulary.ids[p] for p in parts]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k) for k in range(n - 1) if (r := ranks.get((parts[k], parts[k + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, k = heapq.heappop(heap)
        right = after[k]
        if parts[k] is None or right >= n or ranks.get((parts[k], parts[right])) != r:
            continue  # an older pair
        parts[k] += parts[right]
        parts[right] = None
        after[k] = after[right]
        if after[k] < n:
            before[after[k]] = k
            if (new := ranks.get((parts[k], parts[after[k]]))) is not None:
                heapq.heappush(heap, (new, k))
        if before[k] >= 0 and (new := ranks.get((parts[before[k]], parts[k]))) is not None:
            heapq.heappush(heap, (new, before[k]))
    ids = vocabulary.ids
    return [ids[p] for p in parts if p is not None]


class Lexicon:
    """A minimal acyclic automaton over UTF-8 words with ids as output, as one array of numbers.

    Arcs are sorted by (state, byte). ``skip`` counts the words that come before those behind
    an arc, so its sum along a word is the word's rank.
    """

    def __init__(self, flat: np.ndarray):
        arcs, states, words, ids = (int(x) for x in flat[:4])
        cuts = np.cumsum([4, arcs, arcs, arcs, states, words + 1, ids])
        self.keys, self.target, self.skip, self.final, self.starts, self.ids = (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    @staticmethod
    def compile(words: dict[str, list[int]]) -> np.ndarray:
        """Add sorted words one by one; a finished branch is replaced by an equal one seen before."""
        edges: list[dict[int, int]] = [{}]
        final = [0]
        seen: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # (state, byte, next state) of the last word
        sorted_words = sorted((w.encode(), ids) for w, ids in words.items())

        def close(depth: int) -> None:
            while len(path) > depth:
                state, byte, child = path.pop()
                shape = (final[child], tuple(edges[child].items()))
                edges[state][byte] = seen.setdefault(shape, child)

        last = b""
        for word, _ in sorted_words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            close(common)
            state = path[-1][2] if path else 0
            for byte in word[common:]:
                edges.append({})
                final.append(0)
                edges[state][byte] = len(edges) - 1
                path.append((state, byte, len(edges) - 1))
                state = len(edges) - 1
            final[state] = 1
            last = word
        close(0)
        number, stack, order = {0: 0}, [0], [0]
        while stack:
            for child in edges[stack.pop()].values():
                if child not in number:
                    number[child] = len(order)
                    order.append(child)
                    stack.append(child)
        size: dict[int, int] = {}  # words behind each state
        todo = [0]
        while todo:
            state = todo[-1]
            waiting = [c for c in edges[state].values() if c not in size]
            if waiting:
                todo += waiting
            else:
                size[state] = final[state] + sum(size[c] for c in edges[state].values())
                todo.pop()
        keys, target, skip = [], [], []
        for state in order:
            before = final[state]
            for byte, child in sorted(edges[state].items()):
                keys.append(number[state] * 256 + byte)
                target.append(number[child])
                skip.append(before)
                before += size[child]
        ids = [ids for _, ids in sorted_words]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        flat = [k for x in ids for k in x]
        head = [len(keys), len(order), len(ids), len(flat)]
        return np.concatenate([np.asarray(x, dtype=np.int64) for x in (head, keys, target, skip, [final[s] for s in order], starts, flat)])

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 if the automaton does not hold it; all words take a step at once."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self.keys) or not len(words):
            return out
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        at = np.cumsum(lengths) - lengths
        live, state, rank = np.flatnonzero(lengths > 0), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        depth = 0
        while len(live):
            key = state[live] * 256 + data[at[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            held = self.keys[arc] == key
            live, arc = live[held], arc[held]
            state[live] = self.target[arc]
            rank[live] += self.skip[arc]
            depth += 1
            done = lengths[live] == depth
            ends = live[done]
            ends = ends[self.final[state[ends]] == 1]
            out[ends] = rank[ends]
            live = live[~done]
        return out


class Encoder:
    """Encodes chunks of texts with a lexicon and exact merges."""

    def __init__(self, lexicon: Lexicon, vocabulary: Vocabulary):
        self.lexicon, self.vocabulary, self.kept = lexicon, vocabulary, {}
        self.unassigned, self.library = unassigned(), None
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.specials, key=len, reverse=True))) + ")") if vocabulary.specials else None

    def split(self, text: str) -> list[str]:
        """Words and special strings; the latter are marked by a line break, which no word holds."""
        if self.special is None or not any(s in text for s in self.vocabulary.specials):
            return self.plain(text)
        out = []
        for part in self.special.split(text):
            if part in self.vocabulary.specials:
                out.append("\n" + part)
            elif part:
                out += self.plain(part)
        return out

    def plain(self, text: str) -> list[str]:
        """Words of a text without special strings; the library splits the rare text with unassigned code points."""
        if text.isascii() or not _LATER.search(text) or not self.unassigned.search(text):
            return words_of(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.vocabulary.source)
            self.bytes = {c: b for b, c in enumerate(_LETTERS)}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes[c] for c in word).decode() for word, _ in found]

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ids of each distinct word."""
        ranks = self.lexicon.ranks([w.encode("utf-8", "surrogatepass") for w in words])
        known = ranks >= 0
        lengths = np.zeros(len(words), dtype=np.int64)
        lengths[known] = self.lexicon.starts[ranks[known] + 1] - self.lexicon.starts[ranks[known]]
        merged: dict[int, list[int]] = {}
        if len(self.kept) > KEPT_MERGES:
            self.kept = {}
        for k in np.flatnonzero(~known):
            word = words[k]
            ids = self.kept.get(word)
            if ids is None:
                ids = [self.vocabulary.specials[word[1:]]] if word[0] == "\n" else merge_word(word, self.vocabulary)
                self.kept[word] = ids
            merged[k] = ids
            lengths[k] = len(ids)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        out = np.zeros(starts[-1], dtype=np.uint32)
        if known.any():
            out[ragged(starts[:-1][known], lengths[known])] = self.lexicon.ids[ragged(self.lexicon.starts[ranks[known]], lengths[known])]
        if merged:
            rest = np.flatnonzero(~known)
            out[ragged(starts[:-1][rest], lengths[rest])] = [x for k in rest for x in merged[k]]
        return starts, out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self.split(t) for t in texts]
        every = [w for words in split for w in words]
        if not every:
            return [np.zeros(0, np.uint32) for _ in texts]
        codes, distinct = pd.factorize(np.array(every, dtype=object))
        starts, ids = self.ids_of(list(distinct))
        lengths = np.diff(starts)[codes]
        flat = ids[ragged(starts[codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0] + [len(words) for words in split])]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[k] .. starts[k] + lengths[k] - 1 of all k, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def decode(ids: np.ndarray, pieces: list[str]) -> str:
    """Text of ids as the library decodes them without a decoder: pieces joined by a space."""
    return " ".join(map(pieces.__getitem__, ids.tolist()))


def word_counts(docs: DataFrame, specials: list[str]) -> DataFrame:
    """(word, count) over all documents."""
    marks = re.compile("|".join(map(re.escape, specials))) if specials else None

    def passed(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "count"])

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in marks.split(text) if marks and text else [text or ""]:
                    counts.update(words_of(part))
                if len(counts) > KEPT_COUNTS:
                    yield passed(counts)
                    counts = Counter()
        yield passed(counts)

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, count long")
    return rows.groupBy("word").agg(F.sum("count").alias("count"))


def shipped(spark: SparkSession, flat: np.ndarray) -> str:
    """Put an array where every executor finds it as a local file; gives the file's name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{workspace(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(flat.astype("<i8").tobytes()))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def lexicon_of(docs: DataFrame, vocabulary: Vocabulary, size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all documents, ``size`` at most; gives the name of the shipped file.

    Words are taken by steps of their count, a sixteenth of a doubling each, as long as they
    fit, so that only those taken reach the driver.
    """
    counts = staged(word_counts(docs, list(vocabulary.specials)), "word-counts").withColumn("step", F.floor(16 * F.log2("count")))
    steps = counts.groupBy("step").agg(F.count("*").alias("n")).toPandas().sort_values("step", ascending=False)
    fits = steps["step"][steps["n"].cumsum() <= size]
    top = counts.filter(F.col("step") >= int(fits.min())).select("word").toPandas()["word"] if len(fits) else []
    return shipped(docs.sparkSession, Lexicon.compile({w: merge_word(w, vocabulary) for w in top}))


def encoded(docs: DataFrame, path: str, size: int = LEXICON_WORDS, digests: bool = False) -> DataFrame:
    """Encode every whole text with the vocabulary file at ``path``, read on the driver.

    Gives doc_id and ids, or with ``digests``: doc_id, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers) and decoded_sha256 (of the decoded text in UTF-8).

    A null text is an empty one; empty texts have no ids. Rows that repeat a doc_id, or have
    none, are encoded one by one. The vocabulary's special strings in a text become their ids.
    Other columns are not read.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary.read(path)
    name = lexicon_of(docs, vocabulary, size)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        encoder = Encoder(Lexicon(np.memmap(SparkFiles.get(name), dtype="<i8", mode="r")), shared.value)
        pieces = shared.value.pieces()
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets, CHUNK_BYTES):
                found = encoder.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                own = batch.column(0).slice(a, b - a)
                if digests:
                    columns = [
                        own,
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], pa.string()),
                        pa.array([hashlib.sha256(decode(x, pieces).encode()).hexdigest() for x in found], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([own, pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to an empty text, an id out of range raises."""
    shared = encodings.sparkSession.sparkContext.broadcast(Vocabulary.read(path).pieces())

    def run(batches):
        for batch in batches:
            texts = [decode(np.asarray(ids or [], dtype=np.int64), shared.value) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
