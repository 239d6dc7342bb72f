"""Global row numbers and running sums without a single-partition window.

Rows fall into value ranges of the order key (bounds are approximate quantiles,
a bounded list of numbers). Totals per range give offsets; a window numbers the
rows inside each range. A key value frequent enough to be a bound gets ranges
of its own, cut again by the tie key, so one value holding a third of all rows
is still spread over many tasks. Bounds are literals, so every branch of the
plan and every re-run of a lost task sees the same ranges.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalmill.functions.arrays import let

#: Rows drawn for each range to find the bounds of a text column.
SAMPLE = 50


def _rank(df, name):
    """The column in a form that bounds compare with: text as it is, anything else as a number."""
    kind, col = dict(df.dtypes)[name], F.col(name)
    if kind == "string":
        return col
    if kind == "date":
        return F.unix_date(col).cast("double")
    if kind.startswith("timestamp"):
        return col.cast("timestamp").cast("double")
    return col.cast("double")


def default_ranges(df):
    """Ranges that keep every task of a shuffle busy."""
    return max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def quantile_bounds(df, cols, ranges):
    """Approximate quantiles of the columns, each a short sorted list.

    Numbers by one aggregate; text by the rows that come first in the order of a hash of all
    ``cols``, SAMPLE for each range.
    """
    probs = [i / ranges for i in range(1, ranges)]
    text = [c for c in cols if dict(df.dtypes)[c] == "string"]
    numbers = [c for c in cols if c not in text]
    found = {}
    if numbers:
        aggs = [F.percentile_approx(_rank(df, c), probs, 10000).alias(f"q{i}") for i, c in enumerate(numbers)]
        row = df.agg(*aggs).first()
        found |= {c: sorted({float(x) for x in (row[f"q{i}"] or [])}) for i, c in enumerate(numbers)}
    for c in text:
        drawn = df.select(c, F.xxhash64(*cols).alias("_h")).filter(F.col(c).isNotNull()).orderBy("_h", c).limit(SAMPLE * ranges)
        values = sorted(r[0] for r in drawn.select(c).collect())
        found[c] = sorted({values[int(p * len(values))] for p in probs}) if values else []
    return [found[c] for c in cols]


def _bucket(v, bounds):
    """Number of bounds below the value, doubled, plus one on a bound; -1 for null, which comes first.

    A binary search: the bounds are one literal array and the value is bound once, since a Column
    named inside a lambda is evaluated again for every element.
    """
    if not bounds:
        return F.when(v.isNull(), -1).otherwise(0)
    arr = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def search(x):
        below = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(arr, n + step - 1) < x, n + step).otherwise(n))
        return let(below, lambda n: 2 * n + F.coalesce(F.get(arr, n) == x, F.lit(False)).cast("int"))

    return F.when(v.isNull(), -1).otherwise(let(v, search))


def range_buckets(df, key, tie, ranges=None):
    """Add ``_b`` and ``_t``: ordered ranges of the key and, on bound values and nulls, of the tie."""
    ranges = ranges or default_ranges(df)
    key_bounds, tie_bounds = quantile_bounds(df, [key, tie], ranges)
    b = _bucket(_rank(df, key), key_bounds)
    t = F.when((b % 2 == 1) | (b == -1), _bucket(_rank(df, tie), tie_bounds)).otherwise(F.lit(0))
    return df.withColumn("_b", b).withColumn("_t", t)


def global_running_sum(df, key, tie, amount, part=(), ranges=None, out="running"):
    """Inclusive running sum of ``amount`` in (key, tie) order, per ``part``."""
    part = list(part)
    cut = range_buckets(df, key, tie, ranges)
    totals = cut.groupBy(*part, "_b", "_t").agg(F.sum(amount).alias("_sum"))
    before = W.partitionBy(*part).orderBy("_b", "_t").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*part, "_b", "_t", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*part, "_b", "_t").orderBy(key, tie).rowsBetween(W.unboundedPreceding, 0)
    numbered = cut.withColumn("_inside", F.sum(amount).over(inside))
    return (
        numbered.join(offsets, [*part, "_b", "_t"])
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", "_b", "_t")
    )


def global_positions(df, key, tie, part=(), ranges=None, out="position"):
    """Zero-based row number in (key, tie) order, per ``part``."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    numbered = global_running_sum(ones, key, tie, "_one", part, ranges, out)
    return numbered.withColumn(out, F.col(out) - 1).drop("_one")


def hashed_positions(df, seed, identity, part=(), out="position"):
    """Zero-based position in ``md5(seed:identity)`` order, per ``part``.

    The first three hex digits are ordered ranges of known, even size (4096),
    so no bounds have to be looked up.
    """
    part = list(part)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(identity).cast("string")))
    cut = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, 3))
    totals = cut.groupBy(*part, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*part).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*part, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*part, "_b").orderBy("_h", identity)
    numbered = cut.withColumn("_inside", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [*part, "_b"]).withColumn(out, F.col("_inside") + F.col("_offset")).drop(
        "_inside", "_offset", "_b", "_h"
    )
