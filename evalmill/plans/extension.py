"""User-supplied metrics, prompts and filters."""

from pyspark.sql import functions as F

from evalmill.functions import pairs as pr
from evalmill.functions.arrays import r6
from evalmill.operators import extension as xt
from evalmill.operators import generations as gen
from evalmill.plans import fixtures as fx
from evalmill.plans.documents import mcq_rows
from evalmill.plans.registry import query

LENGTH_RATIO = xt.MetricSpec("length_ratio", lambda: F.length("pred") / F.length("gold"))


@query("custom_sample_metric", "SELECT doc_id, round(length(pred)::DOUBLE / length(gold), 6) AS length_ratio FROM string_pairs")
def custom_sample_metric(spark, sf_dir):
    out = xt.score_samples(fx.string_pairs(spark, sf_dir), ["doc_id"], [LENGTH_RATIO])
    return out.withColumn("length_ratio", r6(F.col("length_ratio")))


@query("custom_corpus_metric", "SELECT task, round(sqrt(avg(power(length(pred)::DOUBLE / length(gold), 2))), 6) AS length_ratio FROM string_pairs GROUP BY task")
def custom_corpus_metric(spark, sf_dir):
    """Root mean square as the corpus function."""
    spec = xt.MetricSpec("length_ratio", LENGTH_RATIO.sample, corpus=lambda c: F.sqrt(F.avg(c * c)))
    samples = xt.score_samples(fx.string_pairs(spark, sf_dir), ["task"], [spec])
    return xt.score_tasks(samples, "task", [spec]).withColumn("length_ratio", r6(F.col("length_ratio")))


def _group():
    golds, preds = F.array("gold"), F.array("pred")
    return {"em": pr.exact_match(golds, preds), "f1": pr.bow_f1(golds, preds), "chars": F.length("pred")}


@query(
    "metric_group",
    """
    SELECT task, round(avg((gold = pred)::INT), 6) AS em, round(max(len(list_intersect(list_distinct(string_split(gold, ' ')), list_distinct(list_filter(string_split(pred, ' '), lambda w: w <> ''))))
             * 2.0::DOUBLE / (len(list_distinct(string_split(gold, ' '))) + len(list_distinct(list_filter(string_split(pred, ' '), lambda w: w <> ''))))), 6) AS f1, CAST(sum(length(pred)) AS BIGINT) AS chars
    FROM string_pairs GROUP BY task
    """,
)
def metric_group(spark, sf_dir):
    """Three outputs of one computation, each with its own corpus function."""
    spec = xt.MetricSpec("group", _group, corpus={"em": F.avg, "f1": F.max, "chars": F.sum})
    samples = xt.score_samples(fx.string_pairs(spark, sf_dir), ["task"], [spec])
    out = xt.score_tasks(samples, "task", [spec])
    return out.select("task", r6(F.col("em")).alias("em"), r6(F.col("f1")).alias("f1"), "chars")


@query(
    "metric_params",
    """
    WITH c AS (SELECT doc_id, task, count(*) FILTER (answer = gold) AS c, count(*) AS n FROM generations GROUP BY doc_id, task)
    SELECT task, round(avg(c / n::DOUBLE), 6) AS "pass@k:k=1",
           round(avg(CASE WHEN n - c < 2 THEN 1.0::DOUBLE ELSE 1 - (n - c) * (n - 1 - c) / (n * (n - 1))::DOUBLE END), 6) AS "pass@k:k=2"
    FROM c GROUP BY task
    """,
)
def metric_params(spark, sf_dir):
    """The same metric with k=1 and k=2; the parameters show in the names."""
    base = xt.MetricSpec("pass@k", lambda k: gen.pass_at_k(F.col("n"), F.col("c"), k))
    specs = [base.with_params(k=1), base.with_params(k=2)]
    counts = gen.correct_counts(fx.generations(spark, sf_dir), ["task", "doc_id"])
    out = xt.score_tasks(xt.score_samples(counts, ["task"], specs), "task", specs)
    return out.select("task", *[r6(F.col(f"`{s.name}`")).alias(s.name) for s in specs])


@query("batched_metric", "SELECT doc_id, CAST(length(trim(pred)) AS DOUBLE) AS score FROM string_pairs")
def batched_metric(spark, sf_dir):
    def stripped_length(batch):
        return batch.assign(score=batch["pred"].str.strip().str.len().astype(float))[["doc_id", "score"]]

    rows = fx.string_pairs(spark, sf_dir).select("doc_id", "pred")
    return xt.batched_metric(rows, stripped_length, "doc_id long, score double")


@query("custom_prompt_fn", "SELECT id, 'Think: ' || upper(question) AS query FROM mcq_rows")
def custom_prompt_fn(spark, sf_dir):
    return xt.apply_prompt(mcq_rows(spark, sf_dir), lambda df: df.select("id", F.concat(F.lit("Think: "), F.upper("question")).alias("query")))


@query("custom_filter", "SELECT id, question FROM mcq_rows WHERE gold = 3 AND length(question) > 25")
def custom_filter(spark, sf_dir):
    return xt.apply_filter(mcq_rows(spark, sf_dir), (F.col("gold") == 3) & (F.length("question") > 25)).select("id", "question")
