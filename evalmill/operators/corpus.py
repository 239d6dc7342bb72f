"""Corpus scores from confusion counts, perplexity sums and calibration bins."""

from pyspark.sql import functions as F

from evalmill.functions.arrays import dbl
from evalmill.operators.positions import global_positions


def confusion(df, keys, gold, pred):
    """Counts per (keys, gold, pred): the only pass over the samples."""
    return df.groupBy(*keys, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_counts(conf, keys):
    """Per (keys, class): tp, gold count and pred count, from the confusion counts."""
    sides = conf.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("gold").alias("cls"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")),
                F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")),
            )
        ),
    )
    return sides.groupBy(*keys, "cls").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))


def mcc(conf, keys):
    """Matthews correlation, binary or multi-class; 0 on a zero denominator."""
    d = lambda c: F.col(c).cast("double")
    sums = class_counts(conf, keys).groupBy(*keys).agg(
        F.sum("tp").alias("c"),
        F.sum("t").alias("s"),
        F.sum(d("t") * d("p")).alias("tp_"),
        F.sum(d("p") * d("p")).alias("pp"),
        F.sum(d("t") * d("t")).alias("tt"),
    )
    den = (d("s") * d("s") - F.col("pp")) * (d("s") * d("s") - F.col("tt"))
    return sums.select(*keys, F.when(den > 0, (d("c") * d("s") - F.col("tp_")) / F.sqrt(den)).otherwise(dbl(0)).alias("mcc"))


def f1_scores(conf, keys):
    """Macro, micro, weighted and best-class F1 from the same class counts."""
    per = class_counts(conf, keys).withColumn(
        "f1", F.when(F.col("t") + F.col("p") > 0, 2.0 * F.col("tp") / (F.col("t") + F.col("p"))).otherwise(dbl(0))
    )
    return per.groupBy(*keys).agg(
        F.avg("f1").alias("macro"),
        (2.0 * F.sum("tp") / (F.sum("t") + F.sum("p"))).alias("micro"),
        (F.sum(F.col("f1") * F.col("t")) / F.sum("t")).alias("weighted"),
        F.max("f1").alias("best_class"),
    )


def multi_f1(conf, keys, classes):
    """Mean over ``classes`` of one-vs-rest F1 and of one-vs-rest accuracy (the micro variant)."""
    known = F.array(*[F.lit(c) for c in classes])
    totals = conf.groupBy(*keys).agg(F.sum("n").alias("total"))
    per = class_counts(conf, keys).filter(F.array_contains(known, F.col("cls")))
    sums = per.groupBy(*keys).agg(
        F.sum(F.when(F.col("t") + F.col("p") > 0, 2.0 * F.col("tp") / (F.col("t") + F.col("p"))).otherwise(dbl(0))).alias("f"),
        F.sum(F.col("t") + F.col("p") - 2 * F.col("tp")).alias("wrong"),
    )
    k = len(classes)
    return totals.join(sums, list(keys), "left").select(
        *keys,
        (F.coalesce("f", dbl(0)) / k).alias("one_vs_rest_f1"),
        (1 - F.coalesce("wrong", F.lit(0)) / (k * F.col("total"))).alias("micro"),
    )


def perplexities(df, keys, logprob, words, nbytes):
    """All perplexity variants from one aggregate of sums; null for a group without units."""
    s, n = F.sum(logprob), F.count("*")
    return df.groupBy(*keys).agg(
        F.exp(-s / n).alias("perplexity"),
        F.exp(F.try_divide(-s, F.sum(words))).alias("word_perplexity"),
        F.exp(F.try_divide(-s, F.sum(nbytes))).alias("byte_perplexity"),
        (F.try_divide(-s, F.sum(nbytes)) / F.log(dbl(2))).alias("bits_per_byte"),
    )


def judge_calibration(df, keys, correct):
    """Accuracy in percent and the Wald 95% half width, both to two digits."""
    p = F.avg(dbl(F.col(correct)))
    half = 100 * 1.96 * F.sqrt(p * (1 - p) / F.count("*"))
    return df.groupBy(*keys).agg(F.bround(100 * p, 2).alias("accuracy"), F.bround(half, 2).alias("half_width"), F.count("*").alias("n"))


def calibration_error(df, confidence, correct, tie, beta=100, norm="2"):
    """Calibration error over equal-count bins of sorted confidence.

    Rows are numbered by a two-level prefix sum, so no task holds the sorted
    table. The last bin takes the remainder and, as in the source of the
    metric, is left out of the sum; -1 with fewer rows than one bin.
    """
    ranked = global_positions(df.select(confidence, correct, tie), confidence, tie)
    total = df.agg(F.count("*")).scalar()
    n_bins = F.floor(total / beta)
    bins = ranked.groupBy(F.least(F.floor(F.col("position") / beta), n_bins - 1).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(confidence).alias("conf"), F.avg(dbl(F.col(correct))).alias("acc")
    )
    used = bins.withColumn("total", total).withColumn("n_bins", n_bins)
    gap = F.abs(F.col("conf") - F.col("acc"))
    inside = F.col("bin") < F.col("n_bins") - 1
    share = F.col("n") / F.col("total")
    value = {
        "2": F.sqrt(F.sum(F.when(inside, share * gap * gap).otherwise(dbl(0)))),
        "1": F.sum(F.when(inside, share * gap).otherwise(dbl(0))),
        "max": F.coalesce(F.max(F.when(inside, gap)), dbl(0)),
    }
    picked = {n: value[n] for n in ([norm] if isinstance(norm, str) else norm)}
    small = F.max("total") < beta
    return used.agg(*[F.when(small, dbl(-1)).otherwise(v).alias(f"error_{n}") for n, v in picked.items()])


def grouped_accuracy(df, task, correct):
    """Accuracy per task and over all rows pooled (task 'all')."""
    return df.rollup(task).agg(F.avg(dbl(F.col(correct))).alias("accuracy"), F.count("*").alias("n")).withColumn(
        task, F.coalesce(task, F.lit("all"))
    )


def block_perplexity(blocks, nll, tokens):
    """exp of the token-weighted mean negative log-likelihood."""
    return blocks.agg(F.exp(F.sum(nll) / F.sum(tokens)).alias("perplexity"), F.sum(tokens).alias("tokens"))


def loss_to_perplexity(df, loss):
    """exp(loss); overflow is infinity."""
    return df.withColumn("perplexity", F.exp(loss))


def irt_estimates(items, keys, theta, seen_weight="weight"):
    """IRT, performance-IRT and generalised estimates from item parameters.

    Columns: ``y`` (score of a seen item, NULL when unseen), ``a``, ``b`` (item
    parameters), ``weight`` (balance weight), ability ``theta`` and ``lam``.
    """
    z = F.greatest(F.least(F.col("a") * F.col(theta) - F.col("b"), dbl(30)), dbl(-30))
    p = 1 / (1 + F.exp(-z))
    seen = F.col("y").isNotNull()
    agg = items.groupBy(*keys).agg(
        (F.sum(F.when(seen, F.col("y") * F.col(seen_weight))) / F.sum(F.when(seen, F.col(seen_weight)))).alias("irt"),
        F.avg(F.when(seen, F.col("y"))).alias("seen_mean"),
        F.avg(F.when(~seen, p)).alias("unseen_mean"),
        F.count_if(seen).alias("n_seen"),
        F.count("*").alias("n"),
        F.max("lam").alias("lam"),
    )
    share = F.col("n_seen") / F.col("n")
    pirt = share * F.coalesce("seen_mean", dbl(0)) + (1 - share) * F.coalesce("unseen_mean", dbl(0))
    out = agg.withColumn("pirt", pirt)
    return out.select(*keys, "irt", "pirt", (F.col("lam") * F.col("irt") + (1 - F.col("lam")) * F.col("pirt")).alias("gp_irt"))


def column_means(df, model, metrics, keep=None):
    """Means of the metric columns per model, in long form and pivoted."""
    names = [m for m in metrics if keep is None or m in keep]
    means = df.groupBy(model).agg(*[F.avg(m).alias(m) for m in names])
    return means.unpivot([model], names, "metric", "value")


def pivot_models(long, model, models):
    """Metric rows, one column per model."""
    return long.groupBy("metric").pivot(model, list(models)).agg(F.first("value"))


def subset_name(*cols):
    """First non-empty of the candidate subset fields, else ``unknown``."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit("unknown"))


def token_share(df, subset, tokens):
    """Tokens and percent of all tokens by subset, largest first."""
    sums = df.groupBy(subset).agg(F.sum(tokens).alias("tokens"))
    total = sums.agg(F.sum("tokens")).scalar()
    return sums.withColumn("percent", 100.0 * F.col("tokens") / total).orderBy(F.desc("tokens"), subset)


