"""Log-probability metrics over choice arrays and choice rows."""

from pyspark.sql import functions as F

from evalmill.functions import logprob as lp
from evalmill.functions.arrays import array_sum, r6
from evalmill.operators import choices as long_form
from evalmill.operators import stats
from evalmill.plans import fixtures as fx
from evalmill.plans.registry import query

IX = "lambda i: {}"


@query(
    "task_accuracy",
    """
    WITH ranked AS (
      SELECT *, row_number() OVER (PARTITION BY task, doc_id
               ORDER BY logprob DESC, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn,
             count(*) OVER (PARTITION BY task, doc_id) AS n,
             count(*) FILTER (is_gold) OVER (PARTITION BY task, doc_id) AS n_gold
      FROM choice_scores),
    docs AS (SELECT task, CASE WHEN is_gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS acc, n_gold / n AS base
             FROM ranked WHERE rn = 1)
    SELECT task, count(*) AS n, round(avg(acc), 6) AS acc,
           round(stddev_samp(acc) / sqrt(count(*)), 6) AS acc_stderr,
           round(avg(base), 6) AS random_baseline
    FROM docs GROUP BY task
    """,
)
def task_accuracy(spark, sf_dir):
    """Accuracy, standard error and chance level per task from choice rows."""
    docs = long_form.best_choice(
        fx.choice_scores(spark, sf_dir),
        ["task", "doc_id"],
        "logprob",
        ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"],
    )
    return docs.groupBy("task").agg(
        F.count("*").alias("n"),
        r6(F.avg("acc")).alias("acc"),
        r6(stats.mean_stderr("acc")).alias("acc_stderr"),
        r6(F.avg(F.col("n_gold") / F.col("n"))).alias("random_baseline"),
    )


def _arr(expr):
    return f"array_to_string(list_transform({expr}, lambda v: CAST(round(v, 6) AS VARCHAR)), ',')"


def _join(col):
    return F.array_join(F.transform(col, lambda v: F.round(v, 6).cast("string")), ",")


@query(
    "logprob_norm_char",
    """
    SELECT doc_id, i, round(logprobs[i + 1] / length(choices[i + 1]), 6) AS norm,
           round(logprobs[i + 1] / nullif(CASE WHEN choices[i + 1][1] = ' ' THEN length(choices[i + 1]) - 1 ELSE length(choices[i + 1]) END, 0), 6) AS norm_no_space
    FROM (SELECT *, unnest(range(0, n)) AS i FROM mcq)
    """,
)
def logprob_norm_char(spark, sf_dir):
    """A lone space has no character left, and no value."""
    df = fx.mcq(spark, sf_dir)
    zipped = F.arrays_zip(
        lp.norm_char(F.col("logprobs"), F.col("choices")).alias("a"),
        lp.norm_char(F.col("logprobs"), F.col("choices"), ignore_first_space=True).alias("b"),
    )
    return df.select("doc_id", F.posexplode(zipped).alias("i", "z")).select(
        "doc_id", F.col("i").cast("long").alias("i"), r6(F.col("z.a")).alias("norm"), r6(F.col("z.b")).alias("norm_no_space")
    )


@query(
    "logprob_norm_token",
    """
    SELECT doc_id, i, round(logprobs[i + 1] / token_counts[i + 1], 6) AS norm
    FROM (SELECT *, unnest(range(0, n)) AS i FROM mcq)
    """,
)
def logprob_norm_token(spark, sf_dir):
    col = lp.norm_token(F.col("logprobs"), F.col("token_counts"))
    return fx.mcq(spark, sf_dir).select("doc_id", F.posexplode(col).alias("i", "v")).select(
        "doc_id", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("norm")
    )


@query(
    "logprob_norm_pmi",
    """
    SELECT doc_id, i, round(logprobs[i + 1] - uncond[i + 1], 6) AS norm
    FROM (SELECT *, unnest(range(0, n)) AS i FROM mcq)
    """,
)
def logprob_norm_pmi(spark, sf_dir):
    both = F.concat("logprobs", "uncond")
    return fx.mcq(spark, sf_dir).select("doc_id", F.posexplode(lp.split_pmi(both, F.col("n"))).alias("i", "v")).select(
        "doc_id", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("norm")
    )


ARGMAX = "list_position({0}, list_max({0})) - 1"


@query(
    "loglik_acc",
    f"""
    WITH s AS (
      SELECT *, list_transform(range(0, n), lambda i: logprobs[i + 1] / length(choices[i + 1])) AS by_char,
             list_transform(range(0, n), lambda i: logprobs[i + 1] / token_counts[i + 1]) AS by_token,
             list_transform(range(0, n), lambda i: logprobs[i + 1] - uncond[i + 1]) AS pmi FROM mcq)
    SELECT doc_id, task,
           CAST(list_contains(golds, {ARGMAX.format('logprobs')}) AS INT) AS acc,
           CAST(list_contains(golds, {ARGMAX.format('by_char')}) AS INT) AS acc_char,
           CAST(list_contains(golds, {ARGMAX.format('by_token')}) AS INT) AS acc_token,
           CAST(list_contains(golds, {ARGMAX.format('pmi')}) AS INT) AS acc_pmi
    FROM s
    """,
)
def loglik_acc(spark, sf_dir):
    scores, golds = F.col("logprobs"), F.col("golds")
    return fx.mcq(spark, sf_dir).select(
        "doc_id",
        "task",
        lp.loglik_acc(scores, golds).alias("acc"),
        lp.loglik_acc(lp.norm_char(scores, F.col("choices")), golds).alias("acc_char"),
        lp.loglik_acc(lp.norm_token(scores, F.col("token_counts")), golds).alias("acc_token"),
        lp.loglik_acc(lp.norm_pmi(scores, F.col("uncond")), golds).alias("acc_pmi"),
    )


@query(
    "mc_prob_norm",
    """
    SELECT doc_id, round(max(p) FILTER (gold) / sum(p), 6) AS prob
    FROM (SELECT doc_id, exp(logprobs[i + 1]) AS p, list_contains(golds, i) AS gold
          FROM (SELECT *, unnest(range(0, n)) AS i FROM mcq))
    GROUP BY doc_id
    """,
)
def mc_prob_norm(spark, sf_dir):
    return fx.mcq(spark, sf_dir).select("doc_id", r6(lp.mc_prob(F.col("logprobs"), F.col("golds"))).alias("prob"))


@query(
    "mc_prob_norm_rows",
    """
    SELECT task, round(avg(prob), 6) AS prob, count(*) AS n FROM (
      SELECT task, doc_id, coalesce(max(exp(logprob)) FILTER (is_gold), 0) / sum(exp(logprob)) AS prob
      FROM choice_scores GROUP BY task, doc_id) GROUP BY task
    """,
)
def mc_prob_norm_rows(spark, sf_dir):
    """The same mass from choice rows: one partial aggregate, no array is built."""
    docs = long_form.probability_mass(fx.choice_scores(spark, sf_dir), ["task", "doc_id"], "logprob")
    return docs.groupBy("task").agg(r6(F.avg("prob")).alias("prob"), F.count("*").alias("n"))


@query(
    "gold_prob",
    """
    SELECT doc_id, round(max(exp(logprobs[i + 1])), 6) AS prob, round(max(exp(logprobs[i + 1] / token_counts[i + 1])), 6) AS prob_token
    FROM (SELECT *, unnest(range(0, n)) AS i FROM mcq) GROUP BY doc_id
    """,
)
def gold_prob(spark, sf_dir):
    return fx.mcq(spark, sf_dir).select(
        "doc_id",
        r6(lp.gold_prob(F.col("logprobs"))).alias("prob"),
        r6(lp.gold_prob(lp.norm_token(F.col("logprobs"), F.col("token_counts")))).alias("prob_token"),
    )


@query(
    "recall_at_k",
    """
    WITH r AS (
      SELECT doc_id, list_contains(golds, i) AS gold,
             row_number() OVER (PARTITION BY doc_id ORDER BY logprobs[i + 1] DESC, i) AS lo,
             row_number() OVER (PARTITION BY doc_id ORDER BY logprobs[i + 1] DESC, i DESC) AS hi
      FROM (SELECT *, unnest(range(0, n)) AS i FROM mcq))
    SELECT doc_id, CAST(bool_or(gold AND lo = 1) AS INT) AS recall_1, CAST(bool_or(gold AND hi <= 2) AS INT) AS recall_2,
           CAST(bool_or(gold AND hi <= 5) AS INT) AS recall_5
    FROM r GROUP BY doc_id
    """,
)
def recall_at_k(spark, sf_dir):
    s, g = F.col("logprobs"), F.col("golds")
    return fx.mcq(spark, sf_dir).select(
        "doc_id", *[lp.recall_at_k(s, g, k).alias(f"recall_{k}") for k in (1, 2, 5)]
    )


@query(
    "mrr",
    """
    WITH r AS (
      SELECT doc_id, list_contains(golds, i) AS gold,
             rank() OVER (PARTITION BY doc_id ORDER BY logprobs[i + 1] DESC) AS r,
             rank() OVER (PARTITION BY doc_id ORDER BY logprobs[i + 1] / length(choices[i + 1]) DESC) AS rc
      FROM (SELECT *, unnest(range(0, n)) AS i FROM mcq))
    SELECT doc_id, round(1.0::DOUBLE / min(r) FILTER (gold), 6) AS mrr, round(1.0::DOUBLE / min(rc) FILTER (gold), 6) AS mrr_char
    FROM r GROUP BY doc_id
    """,
)
def mrr(spark, sf_dir):
    s, g = F.col("logprobs"), F.col("golds")
    return fx.mcq(spark, sf_dir).select(
        "doc_id",
        r6(lp.mrr(s, g)).alias("mrr"),
        r6(lp.mrr(lp.norm_char(s, F.col("choices")), g)).alias("mrr_char"),
    )


@query(
    "acc_gold_greedy",
    """
    SELECT doc_id, CAST(bool_or(logprobs[i + 1] > -1.9 AND list_contains(golds, i)) AS INT) AS acc
    FROM (SELECT *, unnest(range(0, n)) AS i FROM mcq) GROUP BY doc_id
    """,
)
def acc_gold_greedy(spark, sf_dir):
    flags = F.transform("logprobs", lambda s, i: (s > -1.9) & F.array_contains("golds", i))
    return fx.mcq(spark, sf_dir).select("doc_id", lp.acc_gold_greedy(flags).alias("acc"))


@query(
    "truthfulqa_mc",
    """
    WITH c AS (
      SELECT doc_id, 3 AS m, i, logprobs[i + 1] AS s, n,
             i = 0 OR (i >= 3 AND i < 4 + doc_id % 2) OR i = 6 AS gold
      FROM (SELECT *, unnest(range(0, n)) AS i FROM mcq)),
    gap AS (SELECT doc_id, coalesce(min(i) FILTER (i >= 3 AND NOT gold), max(n)) AS stop FROM c GROUP BY doc_id)
    SELECT doc_id, CAST(max(s) FILTER (i = 0) = max(s) FILTER (i < 3) AS INT) AS mc1,
           round(sum(exp(s)) FILTER (i >= 3 AND i < stop) / sum(exp(s)) FILTER (i >= 3), 6) AS mc2
    FROM c JOIN gap USING (doc_id) GROUP BY doc_id
    """,
)
def truthfulqa_mc(spark, sf_dir):
    """Three choices in the first block; gold 6 leaves a gap the true block must not cross."""
    gold = F.filter(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: (i == 0) | ((i >= 3) & (i < 4 + F.col("doc_id") % 2)) | (i == 6),
    )
    mc1, mc2 = lp.two_part_truth(F.col("logprobs"), gold, F.lit(3))
    return fx.mcq(spark, sf_dir).select("doc_id", mc1.alias("mc1"), r6(mc2).alias("mc2"))


@query(
    "tqa_mc_scores",
    """
    WITH c AS (
      SELECT doc_id, i, logprobs[i + 1] AS s, i < 2 AS truth FROM (SELECT *, unnest(range(0, n)) AS i FROM mcq)),
    f AS (SELECT doc_id, max(s) FILTER (NOT truth) AS mf FROM c GROUP BY doc_id)
    SELECT doc_id, round(max(s) FILTER (truth), 6) AS "max", round(max(s) FILTER (truth) - max(mf), 6) AS diff,
           CAST(bool_or(i = 1 AND s > mf) AS DOUBLE) AS mc1,
           round(sum(exp(s)) FILTER (truth) / sum(exp(s)), 6) AS mc2,
           round(count(*) FILTER (truth AND s > mf) / 2.0::DOUBLE, 6) AS mc3
    FROM c JOIN f USING (doc_id) GROUP BY doc_id
    """,
)
def tqa_mc_scores(spark, sf_dir):
    s = F.col("logprobs")
    scores = lp.true_false_scores(F.slice(s, 1, 2), F.slice(s, 3, F.size(s)), F.lit(1))
    df = fx.mcq(spark, sf_dir).select("doc_id", scores.alias("s"))
    return df.select("doc_id", *[r6(F.col(f"s.{c}")).alias(c) for c in ("max", "diff", "mc1", "mc2", "mc3")])


@query(
    "answer_logprob_sum",
    """
    SELECT vec_id AS doc_id, round(sum(embedding[i]::DOUBLE), 5) AS score
    FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)
    WHERE i > 10 + vec_id % 7 + 3 GROUP BY vec_id
    """,
)
def answer_logprob_sum(spark, sf_dir):
    df = fx.table(spark, sf_dir, "embeddings")
    scores = F.col("embedding").cast("array<double>")
    prompt = (10 + F.col("vec_id") % 7).cast("int")
    return df.select(F.col("vec_id").alias("doc_id"), F.round(lp.answer_logprob_sum(scores, prompt), 5).alias("score"))


@query(
    "choice_logit_label",
    f"""
    SELECT doc_id, label, CAST(label = doc_id % 3 AS INT) AS correct FROM (
      SELECT doc_id, CASE task WHEN 'task:0' THEN [0, 1, 2] WHEN 'task:1' THEN [1, 0, 2] ELSE [2, 1, 0] END
             [{ARGMAX.format('logprobs[1:3]')} + 1] AS label FROM mcq)
    """,
)
def choice_logit_label(spark, sf_dir):
    """Label remap by task, as a literal array per task."""
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    remap = F.when(F.col("task") == "task:0", arr(0, 1, 2)).when(F.col("task") == "task:1", arr(1, 0, 2)).otherwise(
        arr(2, 1, 0)
    )
    label = lp.choice_label(F.slice("logprobs", 1, 3), remap)
    return fx.mcq(spark, sf_dir).select("doc_id", label.alias("label")).select(
        "doc_id", "label", (F.col("label") == F.col("doc_id") % 3).cast("int").alias("correct")
    )


@query(
    "loglik_corpus_input",
    f"""
    SELECT doc_id, array_to_string(golds, ',') AS golds, CAST({ARGMAX.format('logprobs')} AS INT) AS pred,
           CAST(golds[1] AS INT) AS first_gold FROM mcq
    """,
)
def loglik_corpus_input(spark, sf_dir):
    s, g = F.col("logprobs"), F.col("golds")
    df = fx.mcq(spark, sf_dir).select("doc_id", lp.corpus_input(s, g).alias("a"), lp.corpus_input(s, g, True).alias("b"))
    return df.select(
        "doc_id",
        F.array_join("a.golds", ",").alias("golds"),
        F.col("a.pred").alias("pred"),
        F.col("b.golds")[0].alias("first_gold"),
    )


@query(
    "ppl_corpus_input",
    """
    SELECT doc_id, round(logprob, 6) AS logprob, CAST(len(string_split_regex(text, '\\s+')) AS BIGINT) AS words, CAST(strlen(text) AS BIGINT) AS bytes
    FROM ppl_docs
    """,
)
def ppl_corpus_input(spark, sf_dir):
    return fx.ppl_docs(spark, sf_dir).select(
        "doc_id",
        r6(F.col("logprob")).alias("logprob"),
        lp.word_units(F.col("text")).cast("long").alias("words"),
        lp.byte_units(F.col("text")).cast("long").alias("bytes"),
    )


@query(
    "target_ppl_corpus_input",
    """
    SELECT doc_id, round(list_sum(logprobs), 6) AS logprob,
           CAST(len(string_split_regex(t, '\\s+')) AS BIGINT) AS words, CAST(strlen(t) AS BIGINT) AS bytes
    FROM (SELECT *, array_to_string(list_transform(golds, lambda g: choices[g + 1]), ' ') AS t FROM mcq)
    """,
)
def target_ppl_corpus_input(spark, sf_dir):
    text = F.array_join(lp.pick(F.col("choices"), F.col("golds")), " ")
    return fx.mcq(spark, sf_dir).select("doc_id", "logprobs", text.alias("t")).select(
        "doc_id",
        r6(array_sum(F.col("logprobs"))).alias("logprob"),
        lp.word_units(F.col("t")).cast("long").alias("words"),
        lp.byte_units(F.col("t")).cast("long").alias("bytes"),
    )


@query(
    "random_baseline",
    """
    SELECT task, round(avg(len(golds)::DOUBLE / n), 6) AS baseline, 0.0::DOUBLE AS generative_baseline FROM mcq GROUP BY task
    """,
)
def random_baseline(spark, sf_dir):
    return fx.mcq(spark, sf_dir).groupBy("task").agg(
        r6(F.avg(lp.random_baseline(F.col("golds"), F.col("choices")))).alias("baseline"),
        F.lit(0.0).alias("generative_baseline"),
    )
