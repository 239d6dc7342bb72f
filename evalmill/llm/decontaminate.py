"""Benchmark decontamination by greedy string tiling.

Words are lower-cased in A-Z and parted by white space and ASCII marks, so case and punctuation
do not hide a passage. Documents and benchmark items meet on shared seeds, runs of
``min_match`` words; only the stretches of a document made of such seeds can hold a tile, so
only they are kept. A pair whose item has too few of its seeds in the document for the wanted
coverage is left out unread. For each candidate pair the longest match of unmarked words is found by
running Karp-Rabin hashes over both sides and marked, again and again, until no match of
``min_match`` words is left. Tiles may lie in any order, so reordered passages count in full.
A document is contaminated by an item if its tiles cover ``percent`` of the item's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.common import id_filter, may_hold, staged
from evalmill.llm.words import grams, read_words, run_hashes


def item_tokens(items: DataFrame, min_match: int) -> DataFrame:
    """(item_id, words, seeds) of every item long enough for a tile; a seed for each place of the item."""

    def run(batches):
        for batch in batches:
            for words in read_words(batch.column(1), lower=True, marks=True):
                seeds = grams(words.hashes, min_match)
                ids, own, runs = [], [], []
                for k in range(len(words)):
                    a, b = words.bounds[k], words.bounds[k + 1]
                    if b - a >= min_match:
                        ids.append(batch.column(0)[words.first + k])
                        own.append(words.hashes[a:b].view(np.int64))
                        runs.append(seeds[a : b - min_match + 1].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field(0).type), pa.array(own, pa.list_(pa.int64())), pa.array(runs, pa.list_(pa.int64()))],
                    names=["item_id", "words", "seeds"],
                )

    rows = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, words array<long>, seeds array<long>")


def seeded_stretches(docs: DataFrame, marks, min_match: int) -> DataFrame:
    """(doc_id, stretch, seeds): words of each document's stretches of seeds, a 0 behind each stretch."""

    def run(batches):
        for batch in batches:
            for words in read_words(batch.column(1), lower=True, marks=True):
                every = grams(words.hashes, min_match)
                hits = np.flatnonzero(may_hold(marks.value, every))
                doc = np.searchsorted(words.bounds, hits, side="right") - 1
                inside = hits + min_match <= words.bounds[doc + 1]
                hits, doc = hits[inside], doc[inside]
                ids, stretches, seeds = [], [], []
                for k in np.unique(doc):
                    own = hits[doc == k]
                    breaks = np.flatnonzero(np.diff(own) > min_match)
                    parts = []
                    for a, b in zip(np.r_[own[0], own[breaks + 1]], np.r_[own[breaks], own[-1]], strict=True):
                        parts += [words.hashes[a : b + min_match], np.zeros(1, np.uint64)]
                    ids.append(batch.column(0)[words.first + int(k)])
                    stretches.append(np.concatenate(parts).view(np.int64))
                    seeds.append(np.unique(every[own]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(stretches, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))],
                    names=["doc_id", "stretch", "seeds"],
                )

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, stretch array<long>, seeds array<long>")


def common_runs(x: np.ndarray, y: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each place in x of a run of ``size`` words that y holds too, with its places in y (Karp-Rabin)."""
    if size > min(len(x), len(y)):
        return
    at = [np.arange(len(side) - size + 1) for side in (x, y)]
    hx, hy = (run_hashes(side, a, a + size) for side, a in zip((x, y), at, strict=True))
    order = np.argsort(hy, kind="stable")
    low, high = np.searchsorted(hy[order], hx, side="left"), np.searchsorted(hy[order], hx, side="right")
    for i in np.flatnonzero(low < high):
        places = order[low[i] : high[i]]
        if np.array_equal(x[i : i + size], y[places[0] : places[0] + size]):
            yield int(i), places


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in item, place in doc, words) of each tile, longest first.

    Marked words and the ends of stretches become values that occur once, so that no later
    match crosses them. Among matches of one length, the one first in the item goes first.
    """
    x, y = item.copy(), doc.copy()
    fresh = np.uint64(1)

    def block(side, where):
        nonlocal fresh
        n = len(where)
        side[where] = np.arange(n, dtype=np.uint64) + fresh
        fresh += np.uint64(n)

    block(y, np.flatnonzero(y == 0))
    out, most = [], min(len(x), len(y))
    while most >= min_match and next(common_runs(x, y, min_match), None):
        low, high = min_match, most
        while low < high:  # longest length with a match
            middle = (low + high + 1) // 2
            if next(common_runs(x, y, middle), None):
                low = middle
            else:
                high = middle - 1
        in_x, in_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
        for i, places in common_runs(x, y, low):
            if in_x[i : i + low].any():
                continue
            for j in places:
                if not in_y[j] and not in_y[j + low - 1]:
                    in_x[i : i + low] = in_y[j : j + low] = True
                    out.append((i, int(j), low))
                    break
        block(x, np.flatnonzero(in_x))
        block(y, np.flatnonzero(in_y))
        most = low
    return out


def contaminated(docs: DataFrame, items: DataFrame, min_match: int = 4, percent: int = 50) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) of every pair whose tiles cover at least
    ``percent`` of the item's words.

    Null and empty texts hold no words and match nothing, nor do items of fewer than
    ``min_match`` words: no tile fits them. Of rows that repeat a doc_id or an item_id the pair
    with the highest coverage counts. Rows without an id are not compared. Other columns of
    either table are not read.
    """
    bench = staged(item_tokens(items, min_match).withColumn("row", F.monotonically_increasing_id()), "items")
    seeds = bench.select(F.explode("seeds").alias("seed"), "row", F.size("words").alias("size"))
    seeds = seeds.groupBy("seed", "row", "size").agg(F.count("*").alias("times"))
    marks = docs.sparkSession.sparkContext.broadcast(id_filter(seeds.select("seed").distinct()))
    found = staged(seeded_stretches(docs, marks, min_match).withColumn("place", F.monotonically_increasing_id()), "stretches")
    # A covered word lies in one of the item's seeds that the document holds, so their number bounds the coverage.
    met = found.select("place", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("place", "row", "size").agg(F.sum("times").alias("held"))
    pairs = met.filter(100 * min_match * F.col("held") >= percent * F.col("size")).select("place", "row")

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, item_id, stretch, words in zip(*(batch.column(k) for k in range(4)), strict=True):
                item = np.asarray(words.values, dtype=np.int64).view(np.uint64)
                own = tiles(item, np.asarray(stretch.values, dtype=np.int64).view(np.uint64), min_match)
                covered = sum(t[2] for t in own)
                if 100 * covered >= percent * len(item):
                    rows.append((doc_id.as_py(), item_id.as_py(), covered / len(item), len(own), own[0][2]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "coverage", "n_tiles", "longest"])

    wide = pairs.join(found.select("place", "doc_id", "stretch"), "place").join(bench.select("row", "item_id", "words"), "row")
    # Few bytes, much work: a number of tasks is named, or they would be merged into one by size.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiled = wide.repartition(tasks, "place", "row").select("doc_id", "item_id", "stretch", "words").mapInArrow(run, "doc_id long, item_id long, coverage double, n_tiles long, longest long")
    best = F.max(F.struct("coverage", (-F.col("n_tiles")).alias("fewest"), "longest")).alias("best")
    one = tiled.groupBy("doc_id", "item_id").agg(best)
    return one.select("doc_id", "item_id", F.col("best.coverage").alias("coverage"), (-F.col("best.fewest")).alias("n_tiles"), F.col("best.longest").alias("longest"))


def clean_documents(docs: DataFrame, items: DataFrame, min_match: int = 4, percent: int = 50) -> DataFrame:
    """All columns of the documents that no item contaminates; rows without a doc_id stay."""
    bad = contaminated(docs, items, min_match, percent).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
