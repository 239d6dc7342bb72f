"""Metrics over several generations per document.

Input is one row per generation: document keys, ``pos`` (0-based), ``answer``
and ``gold`` (or a ready ``score``). All of them are aggregates with map-side
partial results.
"""

from pyspark.sql import functions as F

from evalmill.functions.arrays import array_sum, dbl
from evalmill.functions.text import strip


def sampling_preprocess(df, normalise=None, strip_strings=True):
    """Answer and gold stripped and normalised; a missing answer becomes empty."""

    def clean(name):
        out = F.coalesce(F.col(name), F.lit(""))
        out = strip(out) if strip_strings else out
        return normalise(out) if normalise else out

    return df.withColumns({"answer": clean("answer"), "gold": clean("gold")})


def match_score(mode="full"):
    """0/1 score Column of ``answer`` against ``gold``; empty answers score 0."""
    a, g = F.col("answer"), F.col("gold")
    hit = {"full": a == g, "prefix": a.startswith(g), "suffix": a.endswith(g)}[mode]
    return F.when(a == "", 0).otherwise(hit.cast("int"))


def avg_at_n(df, keys, n, score=None):
    """Mean score of the first n generations."""
    score = match_score() if score is None else score
    return df.filter(F.col("pos") < n).groupBy(*keys).agg(F.avg(score).alias("avg"))


def maj_at_n(df, keys, n):
    """Most frequent of the first n answers (earliest on a tie), then its match."""
    counts = df.filter(F.col("pos") < n).groupBy(*keys, "gold", "answer").agg(
        F.count("*").alias("votes"), F.min("pos").alias("first")
    )
    winner = F.min(F.struct((-F.col("votes")).alias("v"), "first", "answer", "gold"))
    best = counts.groupBy(*keys).agg(winner.alias("w")).select(*keys, "w.answer", "w.gold")
    return best.select(*keys, F.col("answer").alias("majority"), match_score().alias("maj"))


def pass_at_k(n, c, k):
    """1 - prod(1 - k / i) for i in n-c+1 .. n; 1 when fewer than k are wrong."""
    n, c = F.lit(n) if isinstance(n, int) else n, c
    factors = F.when(c > 0, F.sequence(n - c + 1, n)).otherwise(F.array().cast("array<bigint>"))
    miss = F.aggregate(factors, dbl(1), lambda acc, i: acc * (1.0 - dbl(k) / i))
    return F.when(n - c < k, dbl(1)).otherwise(1.0 - miss)


def _choose_ratio(n, c, k, i):
    """Hypergeometric P(exactly i of k drawn are correct) as a product of ratios."""

    def log_choose(a, b):
        steps = F.when(b > 0, F.sequence(F.lit(1).cast("bigint"), b)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(steps, dbl(0), lambda acc, j: acc + F.log((a - b + j) / j))

    valid = (i <= c) & (k - i <= n - c) & (i >= 0) & (k - i >= 0)
    return F.when(valid, F.exp(log_choose(c, i) + log_choose(n - c, k - i) - log_choose(n, k))).otherwise(dbl(0))


def hypergeometric_tail(n, c, k, m):
    """P(at least m of k drawn from n with c correct); 0 outside the valid range."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("bigint")
    k, m = F.lit(k).cast("bigint"), F.lit(m).cast("bigint")
    c = c.cast("bigint")
    ok = (m <= F.least(c, k)) & (k <= n)
    terms = F.transform(F.sequence(m, k), lambda i: _choose_ratio(n, c, k, i))
    return F.when(ok, F.least(array_sum(terms), dbl(1))).otherwise(dbl(0))


def g_pass_at_k(n, c, k, thresholds=(0.0, 0.25, 0.5, 0.75, 1.0)):
    """Name -> Column: chance that at least ceil(k t) of k draws are correct."""
    out = {}
    for t in thresholds:
        m = max(-int(-(k * t) // 1), 1)
        out[f"g_pass_{k}_{t}"] = hypergeometric_tail(n, c, k, m)
    return out


def mg_pass_at_k(n, c, k):
    """2/k times the sum of the tails above ceil(k/2)."""
    low = -(-k // 2)
    total = dbl(0)
    for i in range(low + 1, k + 1):
        total = total + hypergeometric_tail(n, c, k, i)
    return 2.0 * total / k


def correct_counts(df, keys, n=None, score=None):
    """Per document: number of scores equal to 1 (``c``) among its n rows; the first n if given."""
    score = match_score() if score is None else score
    rows = df if n is None else df.filter(F.col("pos") < n)
    return rows.groupBy(*keys).agg(F.count_if(score == 1).alias("c"), F.count("*").alias("n"))


def codegen_pass_at_k(tests, problem, generation, result, ks):
    """Generation correct iff every test result > 0; pass@k per problem with at least k generations."""
    graded = tests.groupBy(problem, generation).agg((F.min(result) > 0).alias("ok"))
    counts = graded.groupBy(problem).agg(F.count("*").alias("n"), F.count_if(F.col("ok")).alias("c"))
    cols = [F.when(F.col("n") >= k, pass_at_k(F.col("n"), F.col("c"), k)).alias(f"pass_{k}") for k in ks]
    return counts.select(problem, "n", "c", *cols)


def epoch_reducer(df, keys, value, n=2, k=2):
    """Repeated epochs of a sample reduced in every supported way."""
    v = F.col(value)
    mode = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    mode = mode.groupBy(*keys).agg(F.max(F.struct("_n", value))[value].alias("mode"))
    base = df.groupBy(*keys).agg(
        F.avg(v).alias("mean"),
        F.median(v).alias("median"),
        F.max(v).alias("max"),
        (F.count_if(v >= 1) >= n).cast("double").alias("at_least_n"),
        F.count("*").alias("_total"),
        F.count_if(v >= 1).alias("_c"),
    )
    base = base.withColumn("pass_at_k", pass_at_k(F.col("_total"), F.col("_c"), k)).drop("_total", "_c")
    return base.join(mode, list(keys))
