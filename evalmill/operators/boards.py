"""Result tables, leaderboards, hashes and run bookkeeping."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group_hierarchy(samples, group, subject, value):
    """Pooled value by subject, by group and in total."""
    return samples.rollup(group, subject).agg(
        F.avg(value).alias("value"), F.count("*").alias("n"), F.grouping_id().alias("level")
    )


def mean_by_prefix(task_scores):
    """Task rows plus one mean row per (model, prefix, metric)."""
    rows = task_scores.select("model", "task", "metric", "value")
    means = rows.groupBy("model", F.split_part("task", F.lit(":"), F.lit(1)).alias("task"), "metric").agg(
        F.avg("value").alias("value")
    )
    return rows.unionByName(means)


def leaderboard(task_scores, tasks, max_columns=None):
    """Model x task table of two-digit strings, ``-`` where a score is missing.

    ``tasks`` names the columns, which saves the pass that would look for them.
    With ``max_columns`` the middle columns are replaced by one gap column.
    """
    shown = list(tasks)
    gap = None
    if max_columns and len(shown) > max_columns:
        head = (max_columns + 1) // 2
        tail = max_columns - head
        gap = head
        shown = shown[:head] + (shown[-tail:] if tail else [])
    wide = (
        task_scores.filter(F.col("task").isin(shown)).groupBy("model").pivot("task", shown).agg(F.first("value"))
    )
    cells = [
        F.when(F.col(f"`{t}`").isNull(), "-").otherwise(F.format_string("%.2f", F.col(f"`{t}`"))).alias(t) for t in shown
    ]
    if gap is not None:
        cells.insert(gap, F.lit("...").alias("..."))
    return wide.select("model", *cells)


def results_table(task_scores, versions):
    """Printed rows: task, version (blank when unknown), metric, value, error."""
    joined = task_scores.join(versions, "task", "left")
    four = lambda c: F.format_string("%.4f", F.col(c))
    return joined.select(
        "task",
        F.coalesce(F.col("version").cast("string"), F.lit("")).alias("version"),
        "metric",
        four("value").alias("value"),
        F.when(F.col("stderr").isNull(), "").otherwise("±").alias("sign"),
        F.when(F.col("stderr").isNull(), "").otherwise(four("stderr")).alias("stderr"),
    )


def sample_hash(*cols):
    """md5 over the given text columns."""
    return F.md5(F.concat_ws("\u0001", *cols))


def _word(hash_col, i):
    return F.conv(F.substr(hash_col, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long")


def multiset_hash(hash_col):
    """Order-independent hash of a group of md5 hashes, as an aggregate.

    The four 32-bit words are summed and the sums hashed with the count, so the
    group is combined map-side and never collected.
    """
    h = F.col(hash_col) if isinstance(hash_col, str) else hash_col
    parts = [F.sum(_word(h, i)).cast("string") for i in range(4)]
    return F.md5(F.concat_ws(":", F.count("*").cast("string"), *parts))


def truncation_counts(samples, key="task"):
    """Truncated, padded and all samples per task and overall (task 'all')."""
    return (
        samples.rollup(key)
        .agg(
            F.count_if(F.col("truncated") > 0).alias("truncated"),
            F.count_if(F.col("truncated") == 0).alias("non_truncated"),
            F.count_if(F.col("padded") > 0).alias("padded"),
            F.count_if(F.col("padded") == 0).alias("non_padded"),
        )
        .withColumn(key, F.coalesce(key, F.lit("all")))
    )


def config_hash(fields):
    """First 16 hex digits of sha256 over the key-sorted JSON of ``fields``."""
    ordered = sorted(fields)
    text = F.to_json(F.struct(*[fields[k].alias(k) for k in ordered]))
    return F.substring(F.sha2(text, 256), 1, 16)


def latest_run_per_task(runs, task="task", when="run_time", key="run_id"):
    """Newest run of every task and whether it is the newest of all.

    One row per task after the first aggregate; the overall maximum is a scalar
    subquery over those rows.
    """
    newest = runs.groupBy(task).agg(F.max(F.struct(when, key)).alias("m")).select(task, f"m.{when}", f"m.{key}")
    return newest.withColumn("is_latest", F.col(when) == newest.agg(F.max(when)).scalar())


def union_suite_details(details, suite):
    """All subtasks of one suite as one table, per run date."""
    own = (F.col("task") == suite) | F.col("task").startswith(suite + ":")
    return details.filter(own)


def top_per_task(df, task, order, n=1):
    """First ``n`` rows of every task; the rank filter runs below the shuffle."""
    w = W.partitionBy(task).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
