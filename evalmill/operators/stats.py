"""Means, standard errors and resampling over sample scores.

Sample scores are one row per (document, metric). Everything here is a partial
plus final aggregate, so a task holding a third of the rows is combined on the
map side.
"""

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalmill.functions.sequences import md5_words

# Cumulative Poisson(1) probabilities scaled to 65536.
POISSON1_STEPS = [24109, 48218, 60273, 64291, 65296, 65497, 65531, 65535]
#: Most samples drawn for at a time: a few arrays of that many numbers stay in the cache.
SAMPLE_ROWS = 16384


def mean_stderr(col):
    """Sample standard deviation over sqrt(n); NULL for fewer than two values."""
    n = F.count(col)
    return F.when(n > 1, F.stddev_samp(col) / F.sqrt(n))


def overflow_to_nan(col):
    """An aggregate that left the double range becomes NaN."""
    return F.when(F.abs(col) == float("inf"), F.lit(float("nan"))).otherwise(col)


def to_long(df, keys, metrics):
    """Metric columns to (metric, value) rows."""
    return df.unpivot(list(keys), list(metrics), "metric", "value")


@lru_cache(maxsize=1)
def _draw_table():
    """Poisson(1) draw of each 16-bit number as it stands in a little-endian word of a digest."""
    return np.searchsorted(POISSON1_STEPS, np.arange(65536, dtype=np.uint16).byteswap(), side="right").astype(np.uint8)


def poisson_weights(identities, blocks):
    """Poisson(1) draws of each of ``blocks``: an array (8, identity) for each.

    The draws of a block are the eight groups of four hex digits of md5("block:identity").
    They have 16 bits and end at 8, an approximation: the true mass beyond is 1.1e-6.
    Identities are bytes; those of one length are hashed together.
    """
    table = _draw_table()
    lengths = np.array([len(x) for x in identities])
    groups = [(int(n), np.flatnonzero(lengths == n)) for n in np.unique(lengths)]
    laid = {}  # padded messages; those of blocks of as many digits differ in their first bytes only
    for block in blocks:
        start = b"%d:" % block
        out = np.empty((8, len(identities)), dtype=np.uint8)
        for n, at in groups:
            size = len(start) + n
            if size > 55:
                digests = b"".join(hashlib.md5(start + identities[k]).digest() for k in at)
                digest = np.frombuffer(digests, "<u4").reshape(len(at), 4).T
            else:
                if (n, len(start)) not in laid:
                    message = np.zeros((len(at), 64), dtype=np.uint8)
                    message[:, len(start) : size] = np.frombuffer(b"".join(identities[k] for k in at), np.uint8).reshape(len(at), n)
                    message[:, size] = 0x80
                    message[:, 56:58] = np.frombuffer((8 * size).to_bytes(2, "little"), np.uint8)
                    laid[n, len(start)] = [w if w.any() else None for w in np.ascontiguousarray(message.view("<u4").T)]
                first = np.frombuffer(start.ljust(64, b"\0"), "<u4")
                digest = md5_words([p if w is None and p else w if w is None or not p else w | p for w, p in zip(laid[n, len(start)], first, strict=True)])
            to = at if len(groups) > 1 else slice(None)
            for k, word in enumerate(digest):
                out[2 * k, to], out[2 * k + 1, to] = table[word & np.uint32(0xFFFF)], table[word >> np.uint32(16)]
        yield out


def bootstrap_replicates(df, keys, identity, sums, replicates=1000):
    """Weighted sums per (keys, replicate): weights as longs, sums as doubles (longs for whole numbers).

    A replicate gives each sample a Poisson(1) weight drawn from a hash of its
    identity, which resamples the corpus in one pass: no row index, no join
    back. One md5 serves eight replicates. Draws are made in numpy and summed by
    key a few thousand samples at a time; partial aggregates follow, so what is
    shuffled is (keys x replicates) rows per input task whatever the corpus size.
    Samples are dealt out by identity first: a table of scores has few input splits
    for the work that each row makes. A sample without identity has no weight, a
    null value adds nothing to its sum.
    """
    blocks, at_keys = (replicates + 7) // 8, [f"_k{i}" for i in range(len(keys))]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, at_keys, strict=True)], F.col(identity).cast("string").alias("_id"), *[c.alias(n) for n, c in sums.items()])
    whole = {n: isinstance(rows.schema[n].dataType, T.IntegralType) for n in sums}
    rows = rows.withColumns({n: F.col(n).cast("long" if w else "double") for n, w in whole.items()}).repartition(tasks, "_id")
    names = [*keys, "replicate", "weight", *sums]
    types = [rows.schema[a].dataType for a in at_keys] + [T.IntegerType(), T.LongType()] + [T.LongType() if w else T.DoubleType() for w in whole.values()]

    def totals(batch):
        """The keys of a batch; weights and sums (key, replicate) and which keys have any."""
        numbered = pa.table([*batch.columns[: len(keys)], pa.array(np.zeros(len(batch), np.int8)), pa.array(np.arange(len(batch)))], names=[*at_keys, "_all", "_row"])
        groups = numbered.group_by([*at_keys, "_all"], use_threads=False).aggregate([("_row", "list")])
        members = groups["_row_list"].combine_chunks()
        order, starts = members.flatten(), np.asarray(members.offsets)[:-1]
        sorted_rows = batch.take(order)
        ids = sorted_rows["_id"]
        known = np.asarray(ids.is_valid())
        values, filled = [np.int64(1)], [known]
        for n, w in whole.items():
            filled.append(known & np.asarray(sorted_rows[n].is_valid()))
            values.append(np.where(filled[-1], np.asarray(pc.fill_null(sorted_rows[n], 0 if w else 0.0)), 0))
        out = [np.empty((len(starts), blocks * 8), dtype=v.dtype) for v in values]
        for block, drawn in enumerate(poisson_weights([(x or "").encode() for x in ids.to_pylist()], range(blocks))):
            drawn[:, ~known] = 0
            for to, value in zip(out, values, strict=True):
                to[:, 8 * block : 8 * block + 8] = np.add.reduceat(drawn * value, starts, axis=1).T
        return [groups[a].combine_chunks() for a in at_keys], out, [np.logical_or.reduceat(f, starts) for f in filled]

    def run(batches):
        for batch in (b.slice(a, SAMPLE_ROWS) for b in batches for a in range(0, len(b), SAMPLE_ROWS)):
            found, out, filled = totals(batch)
            for a in range(0, len(out[0]), 64):
                n = len(out[0][a : a + 64])
                at = pa.array(np.repeat(np.arange(a, a + n), replicates))
                columns = [c.take(at) for c in found] + [pa.array(np.tile(np.arange(replicates, dtype=np.int32), n))]
                for x, has in zip(out, filled, strict=True):
                    columns.append(pa.array(x[a : a + n, :replicates].ravel(), mask=np.repeat(~has[a : a + n], replicates), from_pandas=False))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])
    return rows.mapInArrow(run, schema).groupBy(*keys, "replicate").agg(*[F.sum(n).alias(n) for n in names[len(keys) + 1 :]])


def bootstrap_stderr(replicates, keys, metric):
    """Spread of a metric over the replicates.

    ``stderr`` divides the spread by sqrt(replicates), as the mean standard
    error does; ``distribution_se`` is the spread itself.
    """
    m = replicates.withColumn("_m", metric)
    return m.groupBy(*keys).agg(
        mean_stderr("_m").alias("stderr"), F.stddev_samp("_m").alias("distribution_se"), F.count("*").alias("replicates")
    )


def stderr_kind(corpus_function, iterations):
    """Which error a metric gets: closed form for means, bootstrap otherwise, none at 0 iterations."""
    return (
        F.when(corpus_function == "mean", "mean_stderr")
        .when(F.lit(iterations) == 0, "none")
        .otherwise("bootstrap")
    )


CORPUS_FUNCTIONS = {
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "mean_div_5": lambda c: F.avg(c) / 5,
}


def aggregate_tasks(scores, functions, keys=("task",)):
    """Corpus value, standard error and count per (keys, metric).

    ``functions`` maps metric name to a corpus function name. All metrics are
    aggregated in one pass; the value is chosen per metric afterwards.
    """
    used = sorted(set(functions.values()))
    spec = F.create_map(*[F.lit(x) for pair in functions.items() for x in pair])
    wide = scores.groupBy(*keys, "metric").agg(
        *[CORPUS_FUNCTIONS[u](F.col("value")).alias(f"_{u}") for u in used],
        mean_stderr("value").alias("_se"),
        F.count("value").alias("n"),
    )
    chosen = F.coalesce(*[F.when(spec[F.col("metric")] == u, F.col(f"_{u}")) for u in used])
    error = F.when(spec[F.col("metric")].isin("mean", "mean_div_5"), F.col("_se"))
    return wide.select(*keys, "metric", overflow_to_nan(chosen).alias("value"), overflow_to_nan(error).alias("stderr"), "n")


def suite_of(task):
    """Name before the first colon."""
    return F.split_part(task, F.lit(":"), F.lit(1))


def subtask_average(task_scores, keys=("shots", "metric")):
    """Unweighted mean over the subtasks of a suite, when there is more than one."""
    return (
        task_scores.filter(F.contains(F.col("task"), F.lit(":")))
        .groupBy(suite_of(F.col("task")).alias("suite"), *keys)
        .agg(F.avg("value").alias("value"), F.avg("stderr").alias("stderr"), F.count("*").alias("n_subtasks"))
        .filter("n_subtasks > 1")
        .select(F.concat("suite", F.lit(":_average|"), F.col("shots").cast("string")).alias("task"), "metric", "value", "stderr")
    )


def overall_average(task_scores):
    """Mean of each metric over the tasks that have it; averages are left out."""
    return (
        task_scores.filter(~F.contains(F.col("task"), F.lit("_average")))
        .groupBy("metric")
        .agg(F.avg("value").alias("value"), F.avg("stderr").alias("stderr"), F.count("*").alias("n_tasks"))
    )


def suite_average(task_scores):
    """Per suite mean of each metric, error metrics left out; one subtask is enough."""
    return (
        task_scores.filter(~F.contains(F.col("metric"), F.lit("stderr")))
        .groupBy(suite_of(F.col("task")).alias("suite"), "metric")
        .agg(F.avg("value").alias("value"))
    )
