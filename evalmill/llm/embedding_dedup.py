"""Embedding near-duplicates through a pivot-permutation index.

Reference points (pivots) are vectors drawn by their hash, none near to another: a family of
near vectors gets about one, however large it is, and so shares its other nearest pivots too.
A vector is described by its nearest pivots, nearest first; near vectors see nearly the same ones. The inverted lists
are kept by pairs of pivots, so the vectors that meet in a list share at least two of their
NEAREST pivots, the count that a candidate needs. Candidates are verified by their cosine in
double precision, each pair in one list only: that of the two smallest pivots they share.

Equal vectors are one class with a multiplicity. A list gives back sums of links and, for
each vector, the smallest vector that it reaches inside the list, so its output is as long as
the list however many pairs link. Lists are packed into groups of about GROUP rows; a longer
list is cut into blocks, and all pairs of its blocks become groups.

The number of pivots grows with the square root of the number of vectors (PIVOTS at least),
so that lists stay short; the pivots are the only part that is broadcast. More pivots lie closer
together and are confused more easily, so a vector keeps one more of them for each doubling,
which holds recall. Every vector length has pivots of its own; one with too few vectors for
pivots is a single list, in which every pair is compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.common import components, staged

#: Least number of pivots, and the most: 16,384 pivots of 1,024 numbers are 128 MB.
PIVOTS, MOST_PIVOTS = 256, 16_384
#: Nearest pivots that describe a vector, of PIVOTS pivots.
NEAREST = 6
#: Pivots are less alike than this, and chosen from SAMPLE times as many vectors.
TOO_NEAR, SAMPLE = 0.8, 4
#: Vector lengths that get pivots of their own.
LENGTHS = 64
#: Rows of lists that are handled together.
GROUP = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    vectors = vectors.astype(np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(column: str):
    """True for vectors that have a direction."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(column) > 0) & ~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` of the unit ``vectors`` that have no cosine of TOO_NEAR or more to one taken before."""
    taken = np.empty((min(count, len(vectors)), vectors.shape[1]))
    n = 0
    for v in vectors:
        if n == count:
            break
        if not (taken[:n] @ v >= TOO_NEAR).any():
            taken[n] = v
            n += 1
    return taken[:n]


def draw_pivots(classes: DataFrame, least: int) -> dict[int, np.ndarray]:
    """Pivots of each vector length with more than ``least`` vectors, of the LENGTHS most frequent ones."""
    sizes = classes.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).filter(F.col("n") > least)
    found, left = {}, MOST_PIVOTS
    for d, n in sizes.orderBy(F.desc("n"), "d").limit(LENGTHS).collect():
        count = max(least, min(2 ** round(math.log2(math.sqrt(n))), left))
        left -= count
        drawn = classes.filter(F.size("vec") == d).orderBy(F.xxhash64("vec"), "id").limit(SAMPLE * count).select("vec").toPandas()["vec"]
        found[d] = apart(unit(np.stack(drawn)), count)
    return found


def described_by(points: int, nearest: int) -> int:
    """Nearest pivots that describe a vector, of ``points`` pivots."""
    return min(nearest + max(0, math.ceil(math.log2(points / PIVOTS))), points)


def postings(classes: DataFrame, pivots, nearest: int) -> DataFrame:
    """(key, p, q, id, copies, near, vec): one row for each pair of a vector's nearest pivots."""

    def run(batches):
        for batch in batches:
            lengths = np.asarray(batch.column(2).value_lengths())
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                own = batch.take(pa.array(rows))
                points = pivots.value.get(int(d))
                if points is None:  # one list for all vectors of this length
                    m, near = 1, np.zeros((len(rows), 1), np.int64)
                else:
                    m = described_by(len(points), nearest)
                    vectors = np.asarray(own.column(2).flatten()).reshape(len(rows), d)
                    far = -(unit(vectors) @ points.T)
                    near = np.argsort(far, axis=1, kind="stable")[:, :m].astype(np.int64)
                    near.sort(axis=1)
                pairs = [(a, b) for a in range(m) for b in range(a + 1, m)] or [(0, 0)]
                for a, b in pairs:
                    p, q = near[:, a], near[:, b]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, m, dtype=np.int32)), pa.array(near.ravel()))
                    key = (int(d) * MOST_PIVOTS + p) * MOST_PIVOTS + q
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(p), pa.array(q), own.column(0), own.column(1), lists, own.column(2)],
                        names=["key", "p", "q", "id", "copies", "near", "vec"],
                    )

    kind = classes.schema["vec"].dataType.simpleString()
    return classes.select("id", "copies", "vec").mapInArrow(run, f"key long, p long, q long, id long, copies long, near array<bigint>, vec {kind}")


def list_links(x: dict, rows: np.ndarray, other: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within one list, or between two blocks of it: (row, links, smallest id reached)."""
    every = rows if other is None else np.concatenate([rows, other])
    u, ids, near = x["unit"][every], x["id"][every], x["near"][every]
    near_enough = u @ u.T >= least
    np.fill_diagonal(near_enough, False)
    if other is not None:
        side = np.arange(len(every)) < len(rows)
        near_enough &= side[:, None] != side[None, :]
    p, q = x["p"][every[0]], x["q"][every[0]]
    earlier = np.where((near < q) & (near != p), near, -1)  # a shared one means another list's pair
    shared = np.zeros_like(near_enough)
    for pivot in np.unique(earlier[earlier >= 0]):
        has = (earlier == pivot).any(axis=1)
        shared |= has[:, None] & has[None, :]
    links = (near_enough & ~shared) @ x["copies"][every]
    low = ids.copy()
    while True:
        reach = np.where(near_enough, low[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(low, reach)
        if np.array_equal(new, low):
            return every, links, low
        low = new


def near_duplicates(
    vectors: DataFrame, least: float = 0.9, pivots: int = PIVOTS, nearest: int = NEAREST, group: int = GROUP
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Two vectors link if the index finds them and their cosine is at least ``least``; none
    below it link. n_links counts the other rows linked directly; component_id is the smallest
    vec_id reachable, itself included; kept says that it is the row's own.

    Vectors that are null, empty, zero or hold a null or non-finite number link with nothing,
    nor do vectors of different lengths. Equal vectors always link. Rows that repeat a vec_id
    count as vectors of their own and share a component. Rows without a vec_id link with
    nothing, and have neither component nor kept. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    good = rows.filter(F.col("vec_id").isNotNull() & usable("vec"))
    classes = staged(good.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")
    n = classes.count()
    drawn = draw_pivots(classes, pivots)
    most = max((described_by(len(points), nearest) for points in drawn.values()), default=nearest)
    shared = vectors.sparkSession.sparkContext.broadcast(drawn)
    lists = postings(classes, shared, nearest)
    sizes = lists.groupBy("key").agg(F.count("*").alias("n"))
    long_lists = staged(sizes.filter(F.col("n") > group).select("key", F.ceil(F.col("n") / group).alias("blocks")), "long-lists")
    packs = max(1, math.ceil(n * most * (most - 1) / 2 / group))
    placed = lists.join(long_lists, "key", "left").withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1),
        lambda b: F.struct(F.least(b, "block").alias("low"), F.greatest(b, "block").alias("high")),
    )
    placed = placed.withColumn("pair", F.explode(pairs)).withColumn("pack", F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("key"), F.lit(packs))).otherwise(-F.col("key") - 1))

    def run(key, table):
        low, high = key[1].as_py(), key[2].as_py()
        x = {c: np.asarray(table.column(c).combine_chunks()) for c in ("key", "p", "q", "id", "copies", "block")}
        vec, near = (table.column(c).combine_chunks() for c in ("vec", "near"))
        lengths, widths = np.asarray(vec.value_lengths()), np.asarray(near.value_lengths())
        starts, at = np.cumsum(lengths) - lengths, np.cumsum(widths) - widths
        numbers, points = np.asarray(vec.flatten()), np.asarray(near.flatten())
        order = np.argsort(x["key"], kind="stable")
        out = [[], [], []]
        for rows in np.split(order, np.flatnonzero(np.diff(x["key"][order])) + 1):
            if len(rows) < 2:
                continue
            d, m = lengths[rows[0]], widths[rows[0]]
            own = {c: x[c][rows] for c in ("p", "q", "id", "copies")}
            own["unit"] = unit(numbers[starts[rows][:, None] + np.arange(d)])
            own["near"] = points[at[rows][:, None] + np.arange(m)]
            block = x["block"][rows]
            first, second = np.flatnonzero(block == low), (None if low == high else np.flatnonzero(block == high))
            if not len(first) or (second is not None and not len(second)):
                continue
            every, links, reached = list_links(own, first, second, least)
            told = (links > 0) | (reached < own["id"][every])
            for column, value in zip(out, (own["id"][every][told], links[told], reached[told]), strict=True):
                column.append(value)
        arrays = [pa.array(np.concatenate(c) if c else np.zeros(0), pa.int64()) for c in out]
        return pa.Table.from_arrays(arrays, names=["id", "links", "reached"])

    told = placed.groupBy("pack", "pair.low", "pair.high").applyInArrow(run, "id long, links long, reached long")
    told = staged(told, "list-links")
    links = told.groupBy("id").agg(F.sum("links").alias("links"))
    edges = told.filter("reached < id").select(F.col("id").alias("a"), F.col("reached").alias("b")).distinct()
    # Rows of a repeated vec_id can lie in several classes: members link to their class.
    member = good.join(classes.select("vec", F.col("id").alias("class"), "copies"), "vec")
    member = staged(member.select("vec_id", "class", "copies").distinct(), "members")
    edges = edges.union(member.filter("vec_id <> class").select(F.col("vec_id"), F.col("class")))
    found = components(edges)
    counted = member.join(links, F.col("class") == F.col("id"), "left").groupBy("vec_id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(counted, "vec_id", "left").join(found.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    linked = F.when(usable("vec"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    return out.select("vec_id", linked.alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
