"""Corpus-level scores."""

from pyspark.sql import functions as F

from evalmill.functions import logprob as lp
from evalmill.functions import ngrams as ng
from evalmill.functions import text as tx
from evalmill.functions.arrays import r6
from evalmill.operators import corpus as cp
from evalmill.operators import textpairs as tp
from evalmill.plans import fixtures as fx
from evalmill.plans.registry import query
from evalmill.plans.uncertainty import scored


def _rounded(df, *cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


@query(
    "mcc",
    """
    WITH c AS (SELECT task, count(*)::DOUBLE AS s, count(*) FILTER (gold = pred)::DOUBLE AS c FROM event_classes GROUP BY task),
    t AS (SELECT task, gold AS k, count(*)::DOUBLE AS t FROM event_classes GROUP BY task, gold),
    p AS (SELECT task, pred AS k, count(*)::DOUBLE AS p FROM event_classes GROUP BY task, pred),
    m AS (SELECT coalesce(t.task, p.task) AS task, coalesce(t, 0) AS t, coalesce(p, 0) AS p FROM t FULL JOIN p ON t.task = p.task AND t.k = p.k)
    SELECT m.task, round((max(c) * max(s) - sum(t * p)) / sqrt((max(s) * max(s) - sum(p * p)) * (max(s) * max(s) - sum(t * t))), 6) AS mcc
    FROM m JOIN c USING (task) GROUP BY m.task
    """,
)
def mcc(spark, sf_dir):
    return _rounded(cp.mcc(cp.confusion(fx.event_classes(spark, sf_dir), ["task"], "gold", "pred"), ["task"]), "mcc")


@query(
    "mcc_binary",
    """
    WITH c AS (SELECT task, count(*) FILTER (gold = 1 AND pred = 1)::DOUBLE AS tp, count(*) FILTER (gold = 0 AND pred = 0)::DOUBLE AS tn,
                      count(*) FILTER (gold = 0 AND pred = 1)::DOUBLE AS fp, count(*) FILTER (gold = 1 AND pred = 0)::DOUBLE AS fn FROM class_labels GROUP BY task)
    SELECT task, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0::DOUBLE
                ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc FROM c
    """,
)
def mcc_binary(spark, sf_dir):
    return _rounded(cp.mcc(cp.confusion(fx.class_labels(spark, sf_dir), ["task"], "gold", "pred"), ["task"]), "mcc")


CLASS_F1 = """
    WITH k AS (SELECT task, gold AS k FROM event_classes UNION SELECT task, pred FROM event_classes),
    f AS (SELECT k.task, k.k, count(*) FILTER (gold = k.k AND pred = k.k)::DOUBLE AS tp, count(*) FILTER (gold = k.k)::DOUBLE AS t,
                 count(*) FILTER (pred = k.k)::DOUBLE AS p, count(*)::DOUBLE AS n FROM k JOIN event_classes e ON k.task = e.task GROUP BY k.task, k.k)
"""


@query(
    "f1_scores",
    CLASS_F1
    + """
    SELECT task, round(avg(2 * tp / (t + p)), 6) AS macro, round(2 * sum(tp) / sum(t + p), 6) AS micro,
           round(sum(2 * tp / (t + p) * t) / sum(t), 6) AS weighted, round(max(2 * tp / (t + p)), 6) AS best_class FROM f GROUP BY task
    """,
)
def f1_scores(spark, sf_dir):
    out = cp.f1_scores(cp.confusion(fx.event_classes(spark, sf_dir), ["task"], "gold", "pred"), ["task"])
    return _rounded(out, "macro", "micro", "weighted", "best_class")


@query(
    "multi_f1",
    CLASS_F1
    + """
    SELECT task, round(sum(2 * tp / (t + p)) / 3, 6) AS one_vs_rest_f1, round(sum((n - t - p + 2 * tp) / n) / 3, 6) AS micro
    FROM f WHERE k IN ('click', 'error', 'view') GROUP BY task
    """,
)
def multi_f1(spark, sf_dir):
    conf = cp.confusion(fx.event_classes(spark, sf_dir), ["task"], "gold", "pred")
    return _rounded(cp.multi_f1(conf, ["task"], ["click", "error", "view"]), "one_vs_rest_f1", "micro")


WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"


def _gram_sql(n):
    return (
        f"SELECT task, doc_id, {n} AS n, array_to_string(t[i:i + {n - 1}], ' ') AS gram, side FROM "
        f"(SELECT *, unnest(range(1, len(t) - {n - 2})) AS i FROM t)"
    )


@query(
    "bleu_corpus",
    f"""
    WITH t AS (SELECT task, doc_id, {WORDS.format('source')} AS t, 'g' AS side FROM text_pairs
               UNION ALL SELECT task, doc_id, {WORDS.format("source || ' ' || summary")}, 'p' FROM text_pairs),
    grams AS ({" UNION ALL ".join(_gram_sql(n) for n in (1, 2, 3, 4))}),
    c AS (SELECT task, doc_id, n, gram, count(*) FILTER (side = 'g') AS g, count(*) FILTER (side = 'p') AS p FROM grams GROUP BY ALL),
    s AS (SELECT task, n, sum(least(g, p))::DOUBLE AS m, sum(p)::DOUBLE AS t FROM c GROUP BY task, n),
    l AS (SELECT task, sum(len(t)) FILTER (side = 'g')::DOUBLE AS lg, sum(len(t)) FILTER (side = 'p')::DOUBLE AS lp FROM t GROUP BY task)
    SELECT s.task, round(100 * CASE WHEN max(lp) > max(lg) THEN 1.0::DOUBLE ELSE exp(1 - max(lg) / max(lp)) END * exp(avg(ln(m / s.t))), 6) AS bleu
    FROM s JOIN l USING (task) GROUP BY s.task
    """,
)
def bleu_corpus(spark, sf_dir):
    """Prediction: the source and the summary; every order has matches here."""
    pred = F.concat("source", F.lit(" "), "summary")
    df = fx.text_pairs(spark, sf_dir).select("task", "doc_id", tx.words(F.col("source")).alias("g"), tx.words(pred).alias("p"))
    return _rounded(tp.corpus_bleu(df, ["doc_id"], "task", F.col("g"), F.col("p")).select("task", "bleu"), "bleu")


def _chars(n):
    return (
        f"SELECT task, doc_id, {n} AS n, substr(s, i, {n}) AS gram, side FROM "
        f"(SELECT *, unnest(range(1, length(s) - {n - 2})) AS i FROM s)"
    )


CHRF = f"""
    WITH s AS (SELECT task, doc_id, regexp_replace(gold, '\\s+', '', 'g') AS s, gold AS raw, 'g' AS side FROM string_pairs
               UNION ALL SELECT task, doc_id, regexp_replace(pred, '\\s+', '', 'g'), pred, 'p' FROM string_pairs),
    w AS (SELECT task, doc_id, side, flatten(list_transform(list_filter(string_split(raw, ' '), lambda x: x <> ''), lambda x: CASE
            WHEN length(x) = 1 THEN [x] WHEN regexp_matches(right(x, 1), '[[:punct:]]') THEN [left(x, length(x) - 1), right(x, 1)]
            WHEN regexp_matches(left(x, 1), '[[:punct:]]') THEN [left(x, 1), substr(x, 2)] ELSE [x] END)) AS t FROM s),
    cg AS ({" UNION ALL ".join(_chars(n) for n in range(1, 7))}),
    wg AS ({" UNION ALL ".join(f"SELECT task, doc_id, {100 + n} AS n, array_to_string(t[i:i + {n - 1}], ' ') AS gram, side FROM (SELECT *, unnest(range(1, len(t) - {n - 2})) AS i FROM w)" for n in (1, 2))})
"""
CHRF_END = """,
    c AS (SELECT task, doc_id, n, gram, count(*) FILTER (side = 'g') AS g, count(*) FILTER (side = 'p') AS p FROM {grams} GROUP BY ALL),
    o AS (SELECT task, n, sum(least(g, p))::DOUBLE AS m, sum(g)::DOUBLE AS g, sum(p)::DOUBLE AS p FROM c GROUP BY task, n),
    a AS (SELECT task, avg(m / p) AS pr, avg(m / g) AS re FROM o WHERE g > 0 AND p > 0 GROUP BY task)
    SELECT task, round(100 * 5 * pr * re / (4 * pr + re), 6) AS chrf FROM a
"""


@query("chrf", CHRF + CHRF_END.format(grams="cg"))
def chrf(spark, sf_dir):
    df = fx.string_pairs(spark, sf_dir)
    return _rounded(tp.corpus_chrf(df, ["doc_id"], "task", F.col("gold"), F.col("pred")), "chrf")


@query("chrf_pp", CHRF + CHRF_END.format(grams="(SELECT * FROM cg UNION ALL SELECT * FROM wg)"))
def chrf_pp(spark, sf_dir):
    df = fx.string_pairs(spark, sf_dir)
    return _rounded(tp.corpus_chrf(df, ["doc_id"], "task", F.col("gold"), F.col("pred"), word_order=2), "chrf")


@query(
    "word_edit_rate",
    """
    WITH t AS (SELECT task, list_filter(string_split(pred, ' '), lambda w: w <> '') AS c, list_filter(string_split(gold, ' '), lambda w: w <> '') AS r FROM string_pairs)
    SELECT task, round(sum(levenshtein(array_to_string(list_transform(c, lambda w: chr(CAST(65 + list_position(list_distinct(list_concat(c, r)), w) AS INT))), ''),
                                 array_to_string(list_transform(r, lambda w: chr(CAST(65 + list_position(list_distinct(list_concat(c, r)), w) AS INT))), '')))::DOUBLE / sum(len(r)), 6) AS rate
    FROM t GROUP BY task
    """,
)
def word_edit_rate(spark, sf_dir):
    df = fx.string_pairs(spark, sf_dir).select("task", tx.words(F.col("pred")).alias("c"), tx.words(F.col("gold")).alias("r"))
    rate = F.sum(ng.token_distance(F.col("r"), F.col("c"))) / F.sum(F.size("r"))
    return df.groupBy("task").agg(r6(rate).alias("rate"))


PPL_SQL = r"SELECT task, logprob, len(string_split_regex(text, '\s+')) AS w, strlen(text) AS b FROM ppl_docs"


def _perplexities(spark, sf_dir):
    """Log-probabilities scaled so that exp stays in range."""
    df = fx.ppl_docs(spark, sf_dir).select(
        "task", "logprob", lp.word_units(F.col("text")).alias("w"), lp.byte_units(F.col("text")).alias("b")
    )
    return cp.perplexities(df.withColumn("logprob", F.col("logprob") / 100), ["task"], "logprob", "w", "b")


@query("perplexity", f"WITH p AS ({PPL_SQL}) SELECT task, round(exp(-avg(logprob / 100)), 5) AS perplexity FROM p GROUP BY task")
def perplexity(spark, sf_dir):
    return _perplexities(spark, sf_dir).select("task", F.round("perplexity", 5).alias("perplexity"))


@query(
    "weighted_perplexity",
    f"WITH p AS ({PPL_SQL}) SELECT task, round(exp(-sum(logprob / 100) / sum(w)), 6) AS word_perplexity, round(exp(-sum(logprob / 100) / sum(b)), 6) AS byte_perplexity FROM p GROUP BY task",
)
def weighted_perplexity(spark, sf_dir):
    return _rounded(_perplexities(spark, sf_dir).select("task", "word_perplexity", "byte_perplexity"), "word_perplexity", "byte_perplexity")


@query("bits_per_byte", f"WITH p AS ({PPL_SQL}) SELECT task, round(-sum(logprob / 100) / sum(b) / ln(2), 6) AS bits_per_byte FROM p GROUP BY task")
def bits_per_byte(spark, sf_dir):
    return _rounded(_perplexities(spark, sf_dir).select("task", "bits_per_byte"), "bits_per_byte")


@query(
    "loss_to_ppl",
    "SELECT event_id, event_id // 1000 AS epoch, CASE WHEN value * 2 > 700 THEN 'Infinity' ELSE CAST(round(ln(exp(value * 2)), 4) AS VARCHAR) END AS log_perplexity FROM events",
)
def loss_to_ppl(spark, sf_dir):
    """Losses above 700 are pushed past the double range."""
    loss = F.when(F.col("value") * 2 > 700, 1000.0).otherwise(F.col("value") * 2)
    df = fx.table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 1000).alias("epoch"), loss.alias("loss"))
    p = F.col("perplexity")
    shown = F.when(p == float("inf"), "Infinity").otherwise(F.round(F.log(p), 4).cast("string"))
    return cp.loss_to_perplexity(df, "loss").select("event_id", "epoch", shown.alias("log_perplexity"))


@query(
    "grouped_accuracy",
    "SELECT coalesce(task, 'all') AS task, round(avg(correct), 6) AS accuracy, count(*) AS n FROM confidences GROUP BY ROLLUP (task)",
)
def grouped_accuracy(spark, sf_dir):
    return _rounded(cp.grouped_accuracy(fx.confidences(spark, sf_dir), "task", "correct"), "accuracy")


@query(
    "judge_calibration",
    """
    SELECT task, round_even(100 * avg(correct), 2) AS accuracy, round_even(100 * 1.96::DOUBLE * sqrt(avg(correct) * (1 - avg(correct)) / count(*)), 2) AS half_width, count(*) AS n
    FROM confidences GROUP BY task
    """,
)
def judge_calibration(spark, sf_dir):
    return cp.judge_calibration(fx.confidences(spark, sf_dir), ["task"], "correct")


@query(
    "calibration_error",
    """
    WITH r AS (SELECT confidence, correct, row_number() OVER (ORDER BY confidence, doc_id) - 1 AS p, count(*) OVER () AS total FROM confidences),
    b AS (SELECT least(p // 100, total // 100 - 1) AS bin, max(total) AS total, count(*) AS n, abs(avg(confidence) - avg(correct)) AS gap FROM r GROUP BY 1)
    SELECT round(sqrt(sum(n::DOUBLE / total * gap * gap)), 6) AS error_2, round(sum(n::DOUBLE / total * gap), 6) AS error_1, round(max(gap), 6) AS error_max
    FROM b WHERE bin < total // 100 - 1
    """,
)
def calibration_error(spark, sf_dir):
    out = cp.calibration_error(fx.confidences(spark, sf_dir), "confidence", "correct", "doc_id", 100, ["2", "1", "max"])
    return _rounded(out, "error_2", "error_1", "error_max")


@query(
    "irt_estimates",
    """
    WITH i AS (SELECT l_suppkey AS model, CASE WHEN l_linenumber <= 2 THEN (l_returnflag = 'R')::INT END AS y, 0.5::DOUBLE + l_discount AS a, l_tax * 10 - 0.4::DOUBLE AS b, l_quantity AS w, l_suppkey % 5 - 2 AS theta FROM lineitem),
    s AS (SELECT model, sum(y * w) / sum(w) FILTER (y IS NOT NULL) AS irt, avg(y) AS ys, avg(1 / (1 + exp(-(a * theta - b)))) FILTER (y IS NULL) AS un, count(y)::DOUBLE / count(*) AS sh FROM i GROUP BY model)
    SELECT model, round(irt, 6) AS irt, round(sh * ys + (1 - sh) * un, 6) AS pirt, round(0.3::DOUBLE * irt + 0.7::DOUBLE * (sh * ys + (1 - sh) * un), 6) AS gp_irt FROM s
    """,
)
def irt_estimates(spark, sf_dir):
    """Suppliers as models, lines as items; lines 1 and 2 are the seen ones."""
    items = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("model"),
        F.when(F.col("l_linenumber") <= 2, (F.col("l_returnflag") == "R").cast("int")).alias("y"),
        (0.5 + F.col("l_discount")).alias("a"),
        (F.col("l_tax") * 10 - 0.4).alias("b"),
        F.col("l_quantity").alias("weight"),
        (F.col("l_suppkey") % 5 - 2).cast("double").alias("theta"),
        F.lit(0.3).alias("lam"),
    )
    return _rounded(cp.irt_estimates(items, ["model"], "theta"), "irt", "pirt", "gp_irt")


@query(
    "tqa_summary",
    """
    SELECT metric, round(max(v) FILTER (model = 'model0'), 6) AS model0, round(max(v) FILTER (model = 'model1'), 6) AS model1, round(max(v) FILTER (model = 'model2'), 6) AS model2
    FROM (SELECT 'em' AS metric, model, avg(em) AS v FROM scored GROUP BY model UNION ALL SELECT 'f1', model, avg(f1) FROM scored GROUP BY model) GROUP BY metric
    """,
)
def tqa_summary(spark, sf_dir):
    long = cp.column_means(scored(spark, sf_dir), "model", ["em", "f1", "value"], keep=["em", "f1"])
    models = ["model0", "model1", "model2"]
    return _rounded(cp.pivot_models(long, "model", models), *models)


@query(
    "subset_token_share",
    rf"""
    WITH t AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 5 = 1 THEN lang ELSE source END AS subset, len({WORDS.format('text')}) AS n FROM documents)
    SELECT subset, CAST(sum(n) AS BIGINT) AS tokens, round(100.0::DOUBLE * sum(n) / (SELECT sum(n) FROM t), 6) AS percent FROM t GROUP BY subset
    """,
)
def subset_token_share(spark, sf_dir):
    k = F.col("doc_id") % 5
    first = F.when(k >= 2, F.col("source")).otherwise("")
    second = F.when(k == 1, F.col("lang"))
    df = fx.table(spark, sf_dir, "documents").select(
        cp.subset_name(first, second).alias("subset"), F.size(tx.words(F.col("text"))).alias("n")
    )
    return _rounded(cp.token_share(df, "subset", "n"), "percent")
