"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document's set holds its distinct shingles. In a fixed order of all shingles, rare ones
first, two sets of Jaccard similarity t or more share a shingle within their first
n - ceil(t n) + 1. Documents are joined on those prefix shingles only; the length filter
and the positional filter (what can still match behind the first shared shingle) thin the
pairs, each pair is verified once, and the suffix filter ends most failing verifications.

Groups of copies are not expanded into all pairs. A first round pairs every document of a
prefix group with the smallest one, and their components are found; then a second round pairs
documents of a group that are still in different components, so that no link between
components is missed. The first round sees a pair's shared shingles only where the smallest
document is one of the two, and so may pass over a pair; the second one finds it. Exact copies
take part in the first round only.

Rarity comes from the shingles that a fixed share of the documents holds, whatever the size
of the table: every task counts the shingles of about SPAN at a time and passes on those that
recur in a RECURS-th of the span's documents. Those whose sum is one document in COMMON or more,
a share that a span tells reliably, are ordered by it; all others, the rare ones, stand before
them. Their number follows from the length of a document, not from the number of documents,
and the most frequent LISTED of them are what is broadcast.
Any order gives the same result, rare-first only keeps the groups small.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.common import components, staged, texts_of, unstaged
from evalmill.llm.words import Words, grams, read_words, short_gram

#: Shingles that a task counts together (16 MB), and the share of their documents, one in so many,
#: that a shingle must be in to be passed on, at least LEAST of them.
SPAN, RECURS, LEAST = 1 << 21, 1024, 4
#: A shingle is common if it is in one of so many documents; the most common shingles that are told apart (2 MB).
COMMON, LISTED = 512, 1 << 17


def shingle_sets(words: Words, n: int):
    """(position in the batch, sorted distinct shingle hashes) of each text."""
    every = grams(words.hashes, n)
    for k in range(len(words)):
        a, b = words.bounds[k], words.bounds[k + 1]
        if b - a >= n:
            yield words.first + k, np.unique(every[a : b - n + 1])
        elif b > a:
            yield words.first + k, np.array([short_gram(words.hashes[a:b])], dtype=np.uint64)
        else:
            yield words.first + k, np.zeros(0, np.uint64)


def rare_first(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Order of a sorted set of shingles: by the count of common ones, then by hash."""
    known, counts = common
    if not len(known):
        return np.arange(len(shingles))
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    return np.argsort(np.where(known[at] == shingles, counts[at], 0), kind="stable")


def recurring(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a span that recur in a RECURS-th of its sets, with their counts."""
    found, counts = np.unique(np.concatenate(sets), return_counts=True)
    often = counts >= max(LEAST, len(sets) / RECURS)
    return found[often], counts[often]


def profile(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_key) of every row, and the recurring shingles (tok, total)."""
    names = ["doc_id", "n_shingles", "set_key", "tok", "total"]

    def run(batches):
        span, held = [], 0

        def told():
            toks, totals = recurring(span)
            none = pa.nulls(len(toks), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(toks), pa.binary()), pa.array(toks.view(np.int64)), pa.array(totals)], names=names)

        for batch in batches:
            sizes, keys = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for words in read_words(batch.column(1), lower=True):
                for k, own in shingle_sets(words, n):
                    sizes[k] = len(own)
                    if len(own):
                        keys[k] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                        span.append(own)
                        held += len(own)
                if held >= SPAN:
                    yield told()
                    span, held = [], 0
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(keys, pa.binary()), none, none], names=names)
        if span:
            yield told()

    schema = "doc_id long, n_shingles long, set_key binary, tok long, total long"
    both = staged(docs.mapInArrow(run, schema), "shingle-profile")
    rows = both.filter("tok is null").select("doc_id", "n_shingles", "set_key")
    return rows, both.filter("tok is not null").groupBy("tok").agg(F.sum("total").alias("total"))


def rarity(totals: DataFrame, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, counts) of the common ones."""
    least = max(LEAST, documents / COMMON)
    found = totals.filter(F.col("total") >= least).orderBy(F.desc("total"), "tok").limit(LISTED).toPandas()
    toks = found["tok"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(toks)
    return toks[order], found["total"].to_numpy(np.int64)[order]


def prefixes(docs: DataFrame, n: int, percent: int, common) -> DataFrame:
    """(tok, doc, pos, n): each document's prefix shingles with their places in rare-first order."""

    def run(batches):
        order_of = common.value
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for words in read_words(batch.column(1), lower=True):
                toks, at, sizes = [], [], []
                for k, own in shingle_sets(words, n):
                    if len(own):
                        length = len(own) - (len(own) * percent + 99) // 100 + 1
                        toks.append(own[rare_first(own, order_of)[:length]])
                        at.append(k)
                        sizes.append(len(own))
                if toks:
                    each = np.array([len(x) for x in toks])
                    ends = np.cumsum(each)
                    place = np.arange(ends[-1]) - np.repeat(ends - each, each)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(toks).view(np.int64)),
                            pa.array(np.repeat(ids[at], each)),
                            pa.array(place.astype(np.int32)),
                            pa.array(np.repeat(sizes, each).astype(np.int32)),
                        ],
                        names=["tok", "doc", "pos", "n"],
                    )

    return docs.mapInArrow(run, "tok long, doc long, pos int, n int")


def filtered(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, pa, pb, na, nb), one row per shared prefix shingle -> distinct pairs that pass
    the length filter and the positional filter.

    With a shared shingle at (pa, pb), at most min(pa, pb) others match before it, and behind
    it no more than either set has left. All shared prefix shingles of a pair being there, those
    before the end of the shorter-reaching prefix are all counted, and at most the rest of a
    set, ceil(t n) - 1, can match behind it.
    """
    na, nb = F.col("na").cast("long"), F.col("nb").cast("long")
    least = (na + nb) * percent  # 100 + percent times the overlap that a link needs
    most = F.least("pa", "pb") + F.least(na - F.col("pa"), nb - F.col("pb"))
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (most * (100 + percent) >= least)
    rest = F.floor((F.greatest(na, nb) * percent + 99) / 100) - 1
    need = F.ceil(least / (100 + percent)) - rest
    counted = pairs.filter(fits).groupBy("a", "b", need.cast("int").alias("need")).agg(F.count("*").alias("shared"))
    return counted.filter("shared >= need").select("a", "b").distinct()


def suffix_differs(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> bool:
    """True if the sets must differ in more than ``most`` shingles: y is cut at the middle of x,
    and the sizes of the parts must differ in at least as many, part by part."""

    def least(x, y, depth):
        if depth == 0 or len(x) < 2 or len(y) < 2:
            return abs(len(x) - len(y))
        middle = len(x) // 2
        cut = int(np.searchsorted(y, x[middle]))
        return least(x[:middle], y[:cut], depth - 1) + least(x[middle:], y[cut:], depth - 1)

    return least(x, y, depth) > most


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, read from whole texts."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    texts = texts_of(docs, ids.distinct())
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        for batch in batches:
            sides = []
            for column in (2, 3):
                own = {}
                for words in read_words(batch.column(column), lower=True):
                    own.update(shingle_sets(words, n))
                sides.append(own)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                x, y = sides[0][k], sides[1][k]
                total = len(x) + len(y)
                # 100 (total - d) / 2 >= percent (total + d) / 2, d shingles being in one set only
                if total and not suffix_differs(x, y, total * (100 - percent) // (100 + percent)):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = 100 * shared >= percent * (total - shared)
            yield batch.select([0, 1]).filter(pa.array(keep))

    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return rows.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Two documents link when 100 * shared >= percent * union of their shingle sets (words are
    lower-cased in A-Z; fewer words than ``n`` make one shingle). component_id is the smallest
    doc_id reachable by links, itself included.

    A null or empty text, or one of white space only, has no shingle and links with nothing.
    Rows of one doc_id are one document with several texts: they share a component. A row
    without a doc_id links with nothing and has no component. Very long texts are read a piece
    at a time; a task holds the text, the places and hashes of its words. Other columns are not
    read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, totals = profile(docs, n)
    common = docs.sparkSession.sparkContext.broadcast(rarity(totals, rows.count()))
    known = rows.filter("doc_id is not null and n_shingles > 0")
    first = staged(known.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "first-copies")
    copies = known.join(first, "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    of = known.join(first, "set_key").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    copies = staged(copies.distinct(), "copies")
    of = staged(of.filter("rep <> doc_id and rep = last").select("doc_id", "rep"), "representatives")
    unstaged(first)

    every = prefixes(docs.filter("doc_id is not null"), n, percent, common)
    hubs = every.groupBy("tok").agg(F.min(F.struct("doc", "pos", "n")).alias("hub"), F.max("doc").alias("top")).filter("hub.doc < top")
    hubs = staged(hubs.select("tok", F.col("hub.doc").alias("b"), F.col("hub.pos").alias("pb"), F.col("hub.n").alias("nb")), "hubs")
    # Written out, so that the join is one of two exchanges, which Spark can split by skew.
    groups = staged(every.join(hubs, "tok"), "prefix-groups")
    unstaged(hubs)

    def by_class(pairs: DataFrame) -> DataFrame:
        """Pairs of representatives; pairs of copies are links already."""
        for side in ("a", "b"):
            pairs = pairs.join(of.select(F.col("doc_id").alias(side), F.col("rep").alias("r")), side, "left")
            pairs = pairs.withColumn(side, F.coalesce("r", side)).drop("r")
        return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    star = groups.filter("doc <> b").select(F.col("doc").alias("a"), "b", F.col("pos").alias("pa"), "pb", F.col("n").alias("na"), "nb")
    tried = staged(by_class(filtered(star, percent)), "star-pairs")
    links = staged(verified(docs, tried, n, percent).union(copies), "star-links")
    found = staged(components(links), "star-components")

    labels = found.select(F.col("id").alias("doc"), "component")
    members = groups.join(of.select(F.col("doc_id").alias("doc")), "doc", "left_anti").select("tok", "doc", "pos", "n")
    labelled = members.join(labels, "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component")
    open_groups = labelled.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("tok")
    open_groups = staged(open_groups, "open-shingles")
    members = staged(labelled.join(open_groups, "tok"), "open-groups")
    unstaged(groups, open_groups)
    x = members.select("tok", F.col("doc").alias("a"), F.col("pos").alias("pa"), F.col("n").alias("na"), F.col("label").alias("la"))
    y = members.select("tok", F.col("doc").alias("b"), F.col("pos").alias("pb"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.col("la") < F.col("lb"))
    rest = by_class(filtered(x.join(y, "tok").filter(fits), percent)).join(tried, ["a", "b"], "left_anti")
    rest = staged(rest, "cross-pairs")
    unstaged(members, tried)
    more = staged(verified(docs, rest, n, percent), "cross-links")
    unstaged(rest)
    found = staged(components(links.union(more)), "cross-components") if more.take(1) else found
    return (
        rows.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """All columns of the rows that stay: one document (the smallest doc_id) of each component,
    and every row without a doc_id. Rows that repeat a kept doc_id stay as they are."""
    gone = jaccard_components(docs, n, percent).filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
