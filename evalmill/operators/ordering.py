"""Length sort, contiguous splits, parameter groups, padding and order checks."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalmill.operators.positions import global_positions


def request_length(query, choices):
    """Query length plus the longest choice."""
    return F.length(query) + F.coalesce(F.array_max(F.transform(choices, F.length)), F.lit(0))


def length_sorted(df, size, identity):
    """Longest requests first (range-partitioned global sort)."""
    return df.orderBy(F.desc(size), identity)


def split_in_n(df, size, identity, n):
    """Equal contiguous splits of the length-sorted list; one split when n >= rows."""
    ranked = global_positions(df.withColumn("_neg", -F.col(size)), "_neg", identity).drop("_neg")
    total = df.agg(F.count("*")).scalar()
    width = F.ceil(total / n)
    return ranked.withColumn("split", F.when(n >= total, F.lit(0).cast("long")).otherwise(F.floor(F.col("position") / width)))


def group_by_params(df, params, size, identity):
    """Group number per parameter set and position (longest first) inside it.

    Groups are numbered over the distinct parameter sets, a small aggregate;
    positions inside a group come from range buckets, so one group may hold
    most of the rows.
    """
    groups = df.groupBy(*params).agg(F.count("*").alias("group_size"))
    groups = groups.withColumn("group", F.dense_rank().over(W.orderBy(*params)) - 1)
    ranked = global_positions(df.withColumn("_neg", -F.col(size)), "_neg", identity, part=params).drop("_neg")
    return ranked.join(groups, list(params))


def restore_order(docs, results, order, keys):
    """Results in document order; a document without a result raises."""
    joined = docs.select(order, *keys).join(results.withColumn("_has", F.lit(True)), list(keys), "left")
    checked = F.when(F.col("_has"), F.col(order)).otherwise(
        F.raise_error(F.concat(F.lit("no result for row "), F.col(order).cast("string")))
    )
    return joined.withColumn(order, checked).drop("_has").orderBy(order)


def even_pad(df, index, replicas):
    """Repeat the last row so every replica gets as many rows, then stride by rank."""
    numbered = global_positions(df, index, index)
    total = df.agg(F.count("*")).scalar()
    pad = F.pmod(-total, F.lit(replicas))
    copies = F.when(F.col("position") == total - 1, pad).otherwise(F.lit(0))
    padded = numbered.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long"))))
    padded = padded.withColumn("position", F.col("position") + F.col("_copy")).drop("_copy")
    return padded.withColumn("replica", F.col("position") % replicas)


def shuffle_select(df, identity, n, seed=42):
    """First n rows in hash order."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(identity).cast("string"))), identity).limit(n)


def preview_first(details, task, identity, fields):
    """First stored sample of every task."""
    first = details.groupBy(task).agg(F.min(F.struct(identity, *fields)).alias("s"))
    return first.select(task, "s.*")
