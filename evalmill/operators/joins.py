"""Joins of documents, responses, caches and runs.

The reference pairs by list position; here every pairing is an equi-join on
explicit keys. No side is force-broadcast: the planner (and AQE at run time)
broadcasts a side only below ``spark.sql.autoBroadcastJoinThreshold`` and
splits skewed partitions of a sort-merge join otherwise.
"""

from functools import reduce

from pyspark.sql import functions as F

KEYS = ("task", "doc_id", "sampling_method")


def route_by_sampling(docs, methods="sampling_methods"):
    """One request row per (document, sampling method)."""
    return docs.withColumn("sampling_method", F.explode(methods)).drop(methods)


def pair_with_responses(requests, responses, keys=KEYS):
    """Each request with its response."""
    return requests.join(responses, list(keys))


def cache_miss(docs, cache, keys=("task", "doc_id")):
    """Documents without a cached response."""
    return docs.join(cache.select(*keys), list(keys), "left_anti")


def cache_fetch(docs, cache, keys=("task", "doc_id")):
    """Cached responses of the asked documents."""
    return docs.join(cache, list(keys))


def cache_merge(old, new, keys=("task", "doc_id")):
    """Old rows plus the new ones whose key is unknown: the existing row wins."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def cache_valid_rows(cache, required, non_empty=()):
    """Rows whose key columns are present and whose arrays hold something."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    for c in non_empty:
        ok = ok & (F.coalesce(F.size(c), F.lit(0)) > 0)
    return cache.filter(ok)


def compare_runs(a, b, keys, compared):
    """Sample-by-sample difference of two runs.

    One row per key of either run with an ``only_in`` flag and one
    ``<column>_same`` flag per compared column (null-safe).
    """
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in compared], F.lit(True).alias("_in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in compared], F.lit(True).alias("_in_b"))
    joined = left.join(right, list(keys), "full_outer")
    only = F.when(F.col("_in_b").isNull(), "a").when(F.col("_in_a").isNull(), "b").otherwise("")
    same = [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")).alias(f"{c}_same") for c in compared]
    return joined.withColumn("only_in", only).select(
        *keys, "only_in", *[f"{c}_a" for c in compared], *[f"{c}_b" for c in compared], *same
    )


def metric_spec_lookup(rows, specs, key="metric"):
    """Corpus function and direction of every metric row."""
    return rows.join(specs, key, "left")


def version_lookup(rows, versions):
    """Task version of every row, blank when unknown."""
    return rows.join(versions, "task", "left").withColumn("version", F.coalesce(F.col("version").cast("string"), F.lit("")))


def baseline_delta(rows, baseline, value="value"):
    """Difference of every row to the one-row baseline (a scalar subquery)."""
    base = baseline.scalar()
    return rows.withColumn("baseline", base).withColumn("delta", F.col(value) - base)
