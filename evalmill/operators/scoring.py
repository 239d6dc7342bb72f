"""One scoring job from metric names.

A name is ``base`` or ``base:option=value&...``, as in ``loglik_acc:norm=char`` or
``exact_match:norm=helm&mode=prefix``. The job is planned as a whole:

1. derived columns, that is normalised texts and scores; metrics that ask for the same one share it,
2. the parts of all metrics per sample, in one projection over them,
3. one partial and final aggregate per task with values, errors and counts,
4. the means over tasks, from the few rows of step 3.

So samples are scanned once and shuffled once, as partial sums. A part is null for a task that
does not ask for its metric or a sample that lacks its input, and does not count there.
"""

from dataclasses import dataclass
from typing import Any, Callable

from pyspark.sql import functions as F

from evalmill.functions import logprob as lp
from evalmill.functions import pairs as pr
from evalmill.functions import text as tx
from evalmill.functions.arrays import argmax
from evalmill.operators.extension import MetricSpec
from evalmill.operators.stats import mean_stderr

TEXT_NORMS = {
    "lower": F.lower, "strip": tx.strip, "helm": tx.norm_helm, "triviaqa": tx.norm_triviaqa,
    "bigbench": tx.norm_bigbench, "gsm8k": tx.norm_gsm8k, "math": tx.norm_math,
}
SCORE_NORMS = {
    "char": (["logprobs", "choices"], lambda: lp.norm_char(F.col("logprobs"), F.col("choices"))),
    "token": (["logprobs", "token_counts"], lambda: lp.norm_token(F.col("logprobs"), F.col("token_counts"))),
    "pmi": (["logprobs", "uncond"], lambda: lp.norm_pmi(F.col("logprobs"), F.col("uncond"))),
}


@dataclass(frozen=True)
class Metric:
    """A planned metric: the inputs it reads, the derived columns it shares, its parts per
    sample, and its value and error as aggregates of the parts."""

    name: str
    inputs: tuple
    derived: dict
    parts: tuple
    value: Callable[..., Any]
    error: Callable[..., Any]
    higher_is_better: bool = True


def ratio_stderr(a, b):
    """Error of sum(a) / sum(b) over samples, linearised; NULL for fewer than two samples."""
    n, ratio = F.count(a + b), F.sum(a) / F.sum(b)
    squares = F.sum(a * a) - 2 * ratio * F.sum(a * b) + ratio * ratio * F.sum(b * b)
    return F.when(n > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) * n / (n - 1)) / F.abs(F.sum(b)))


def _texts(norm):
    """(inputs, derived columns, names) of golds and predictions under a normaliser."""
    if norm is None:
        return ("gold_texts", "pred_texts"), {}, ("gold_texts", "pred_texts")
    names = (f"_gold_texts_{norm}", f"_pred_texts_{norm}")
    return ("gold_texts", "pred_texts"), {n: F.transform(n[1:].rpartition("_")[0], TEXT_NORMS[norm]) for n in names}, names


def _scores(norm):
    if norm is None:
        return ("logprobs",), {}, "logprobs"
    inputs, column = SCORE_NORMS[norm]
    return tuple(inputs), {f"_logprobs_{norm}": column()}, f"_logprobs_{norm}"


def _mean(name, inputs, derived, part, higher=True):
    return Metric(name, tuple(inputs), derived, (part.cast("double"),), F.avg, mean_stderr, higher)


def _choice(fn):
    """A metric of choice scores and gold positions, under ``norm``."""

    def make(name, norm=None, **options):
        inputs, derived, scores = _scores(norm)
        return _mean(name, (*inputs, "golds"), derived, fn(F.col(scores), F.col("golds"), **options))

    return make


def _text(fn):
    """A metric of gold and predicted texts, under ``norm``."""

    def make(name, norm=None, **options):
        inputs, derived, (golds, preds) = _texts(norm)
        return _mean(name, inputs, derived, fn(F.col(golds), F.col(preds), **options))

    return make


def _perplexity(name, unit="token"):
    """exp of minus the log-probability of the first gold for each token, or character, of a task."""
    at = F.get("golds", F.lit(0))
    units = {"token": ("token_counts", lambda: F.get("token_counts", at)), "char": ("choices", lambda: F.length(F.get("choices", at)))}
    source, count = units[unit]
    parts = (-F.get("logprobs", at).cast("double"), count().cast("double"))
    value = lambda a, b: F.exp(F.sum(a) / F.sum(b))
    return Metric(name, ("logprobs", "golds", source), {}, parts, value, lambda a, b: value(a, b) * ratio_stderr(a, b), False)


def _recall(scores, golds, k="1"):
    return lp.recall_at_k(scores, golds, int(k))


def _match(golds, preds, mode="full", strip="false"):
    return pr.exact_match(golds, preds, mode=mode, strip_strings=strip == "true")


def _confidence(scores, golds):
    """Probability of the best choice among all."""
    return lp.mc_prob(scores, F.array(argmax(scores)))


BUILT_IN = {
    "loglik_acc": _choice(lp.loglik_acc), "mc_prob": _choice(lp.mc_prob), "mrr": _choice(lp.mrr), "recall": _choice(_recall),
    "confidence": _choice(_confidence), "exact_match": _text(_match), "bow_f1": _text(pr.bow_f1), "perplexity": _perplexity,
}


def named(metric):
    """The planned metric of a name, or of a user's MetricSpec (its own corpus function; an error for means only)."""
    if isinstance(metric, MetricSpec):
        (name, column), = metric.columns().items()
        corpus = metric.aggregates()[name]
        error = mean_stderr if corpus is F.avg else (lambda c: F.lit(None).cast("double"))
        return Metric(name, (), {}, (column.cast("double"),), corpus, error, metric.higher_is_better)
    base, _, options = metric.partition(":")
    if base not in BUILT_IN:
        raise ValueError(f"no metric named {base!r}; known: {', '.join(sorted(BUILT_IN))}")
    pairs = [x.partition("=") for x in options.split("&") if x]
    try:
        return BUILT_IN[base](metric, **{k: v for k, _, v in pairs})
    except (KeyError, TypeError) as error:
        raise ValueError(f"metric {metric!r}: unknown option or value ({error})") from error


def assigned(metrics):
    """[(metric, tasks that ask for it, or None for all)] of a list, or of {task: list} with "*" for all tasks."""
    lists = metrics if isinstance(metrics, dict) else {"*": metrics}
    found = {}
    for task, own in lists.items():
        for metric in own:
            _, tasks = found.setdefault(getattr(metric, "name", metric), (metric, set()))
            tasks.add(task)
    return [(metric, None if "*" in tasks else sorted(tasks)) for metric, tasks in found.values()]


def score(df, metrics, task="task"):
    """(task, metric, value, stderr, n, higher_is_better): a row per task and metric, and per metric
    the mean over tasks, as task "all", with mean error and the sum of the counts.

    Inputs, as far as metrics read them: ``logprobs``, ``uncond``, ``choices`` and ``token_counts``
    (arrays over choices), ``golds`` (positions), ``gold_texts`` and ``pred_texts``. ``metrics`` is
    a list of names and specs, or lists by task.
    """
    plan = [(named(m), tasks) for m, tasks in assigned(metrics)]
    for metric, _ in plan:
        missing = [c for c in metric.inputs if c not in df.columns]
        if missing:
            raise ValueError(f"metric {metric.name!r} needs column(s) {', '.join(missing)}")
    derived = {n: c for metric, _ in plan for n, c in metric.derived.items()}
    parts = []
    for k, (metric, tasks) in enumerate(plan):
        for j, part in enumerate(metric.parts):
            parts.append((part if tasks is None else F.when(F.col(task).isin(tasks), part)).alias(f"_{k}_{j}"))
    samples = df.withColumns(derived).select(F.col(task).alias("task"), *parts) if derived else df.select(F.col(task).alias("task"), *parts)
    aggregates = []
    for k, (metric, _) in enumerate(plan):
        own = [F.col(f"_{k}_{j}") for j in range(len(metric.parts))]
        complete = own[0] if len(own) == 1 else sum(own[1:], own[0])
        aggregates += [metric.value(*own).alias(f"v{k}"), metric.error(*own).alias(f"e{k}"), F.count(complete).alias(f"n{k}")]
    tasks = samples.groupBy("task").agg(*aggregates)
    rows = F.array(*[
        F.struct(F.lit(m.name).alias("metric"), F.col(f"v{k}").cast("double").alias("value"), F.col(f"e{k}").alias("stderr"),
                 F.col(f"n{k}").alias("n"), F.lit(m.higher_is_better).alias("higher_is_better"))
        for k, (m, _) in enumerate(plan)
    ])
    long = tasks.select("task", F.explode(rows).alias("r")).select("task", "r.*").filter("n > 0")
    both = long.rollup("metric", "higher_is_better", "task").agg(
        F.avg("value").alias("value"), F.avg("stderr").alias("stderr"), F.sum("n").alias("n"), F.grouping_id().alias("_level")
    )
    name = F.when(F.col("_level") == 1, "all").otherwise(F.col("task"))
    return both.filter("_level <= 1").select(name.alias("task"), "metric", "value", "stderr", "n", "higher_is_better")
