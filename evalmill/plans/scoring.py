"""Scoring jobs from metric names."""

from pyspark.sql import functions as F

from evalmill.functions.arrays import argmax, pick, r6
from evalmill.operators.extension import MetricSpec
from evalmill.operators.scoring import score
from evalmill.plans import fixtures as fx
from evalmill.plans.registry import query, view

BEST = "list_position({0}, list_max({0})) - 1"
view(
    "answers",
    f"""
    SELECT *, list_transform(golds, lambda g: choices[g + 1]) AS gold_texts,
           [CASE doc_id % 3 WHEN 0 THEN upper(best) || '.' WHEN 1 THEN best ELSE 'the ' || best || ' x' END] AS pred_texts
    FROM (SELECT *, choices[{BEST.format('logprobs')} + 1] AS best FROM mcq)
    """,
)


def answers(spark, sf_dir):
    """Choice responses that are texts as well: the best choice, changed in two of three rows."""
    best = F.get("choices", argmax(F.col("logprobs")))
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat(F.upper(best), F.lit("."))).when(k == 1, best).otherwise(F.concat(F.lit("the "), best, F.lit(" x")))
    return fx.mcq(spark, sf_dir).withColumns({"gold_texts": pick(F.col("choices"), F.col("golds")), "pred_texts": F.array(text)})


def _overlap(gold, pred):
    words = "list_distinct(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))"
    a, b = words.format(gold), words.format(pred)
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def _best(body):
    return f"list_max(list_transform(gold_texts, lambda g: {body}))"


P = "pred_texts[1]"
NAMED = {
    "loglik_acc": f"list_contains(golds, {BEST.format('logprobs')})::INT",
    "loglik_acc:norm=char": f"list_contains(golds, {BEST.format('by_char')})::INT",
    "loglik_acc:norm=pmi": f"list_contains(golds, {BEST.format('pmi')})::INT",
    "mrr:norm=char": "1.0::DOUBLE / (1 + len(list_filter(by_char, lambda x: x > list_max(list_transform(golds, lambda g: by_char[g + 1])))))",
    "mc_prob": "list_max(list_transform(golds, lambda g: exp(logprobs[g + 1]))) / list_sum(list_transform(logprobs, lambda x: exp(x)))",
    "exact_match": _best(f"({P} = g)::INT"),
    "exact_match:norm=lower&mode=prefix": _best(f"starts_with(lower({P}), lower(g))::INT"),
    "bow_f1:norm=lower": _best(_overlap("lower(g)", f"lower({P})")),
}
LENGTH = MetricSpec("length", lambda: F.length(F.get("pred_texts", F.lit(0))), corpus=F.max, higher_is_better=False)
RATE = "sum(-logprobs[golds[1] + 1]) / sum(token_counts[golds[1] + 1])"
RATE_ERROR = """sqrt(greatest(sum(logprobs[golds[1] + 1] ** 2) - 2 * r * sum(-logprobs[golds[1] + 1] * token_counts[golds[1] + 1]) + r * r * sum(token_counts[golds[1] + 1] ** 2), 0)
    * count(*) / (count(*) - 1)) / sum(token_counts[golds[1] + 1])"""


def _mean_rows(name, sql, where="true"):
    return f"SELECT task, '{name}' AS metric, avg(x) AS value, stddev_samp(x) / sqrt(count(x)) AS stderr, count(x) AS n, true AS higher_is_better FROM (SELECT task, ({sql})::DOUBLE AS x FROM s WHERE {where}) GROUP BY task"


def _scored_sql(rows):
    return f"""
    WITH s AS (
      SELECT *, list_transform(range(0, n), lambda i: logprobs[i + 1] / length(choices[i + 1])) AS by_char,
             list_transform(range(0, n), lambda i: logprobs[i + 1] - uncond[i + 1]) AS pmi FROM answers),
    t AS ({" UNION ALL ".join(rows)})
    SELECT task, metric, round(value, 6) AS value, round(stderr, 6) AS stderr, CAST(n AS BIGINT) AS n, higher_is_better FROM t
    UNION ALL SELECT 'all', metric, round(avg(value), 6), round(avg(stderr), 6), CAST(sum(n) AS BIGINT), higher_is_better FROM t GROUP BY metric, higher_is_better
    """


PERPLEXITY_ROWS = f"""
    SELECT a.task, 'perplexity' AS metric, exp(any_value(r)) AS value, exp(any_value(r)) * any_value(e) AS stderr, any_value(c) AS n, false AS higher_is_better
    FROM (SELECT s.task, any_value(r) AS r, count(*) AS c, {RATE_ERROR.replace(' r ', ' any_value(r) ')} AS e
          FROM s JOIN (SELECT task, {RATE} AS r FROM s GROUP BY task) q ON q.task = s.task GROUP BY s.task) a GROUP BY a.task
"""
LENGTH_ROWS = f"SELECT task, 'length' AS metric, max(length({P}))::DOUBLE AS value, CAST(NULL AS DOUBLE) AS stderr, count(*) AS n, false AS higher_is_better FROM s GROUP BY task"


def _shown(df):
    return df.withColumns({"value": r6(F.col("value")), "stderr": r6(F.col("stderr"))})


@query("scoring_job", _scored_sql([*(_mean_rows(n, q) for n, q in NAMED.items()), PERPLEXITY_ROWS, LENGTH_ROWS]))
def scoring_job(spark, sf_dir):
    """Ten metrics of choices, texts and corpora by name, with errors and means over tasks."""
    return _shown(score(answers(spark, sf_dir), [*NAMED, "perplexity", LENGTH]))


BY_TASK = {"task:0": ["loglik_acc", "mc_prob"], "task:1": ["exact_match", "mc_prob"], "*": ["bow_f1:norm=lower"]}


@query(
    "scoring_by_task",
    _scored_sql([
        _mean_rows("loglik_acc", NAMED["loglik_acc"], "task = 'task:0'"), _mean_rows("mc_prob", NAMED["mc_prob"], "task IN ('task:0', 'task:1')"),
        _mean_rows("exact_match", NAMED["exact_match"], "task = 'task:1'"), _mean_rows("bow_f1:norm=lower", NAMED["bow_f1:norm=lower"]),
    ]),
)
def scoring_by_task(spark, sf_dir):
    """Each task with metrics of its own, and one for all tasks, still in one pass."""
    return _shown(score(answers(spark, sf_dir), BY_TASK))
