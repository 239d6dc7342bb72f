"""Queries over sampled generations."""

from pyspark.sql import functions as F

from evalmill.functions import text as tx
from evalmill.functions.arrays import r6
from evalmill.operators import generations as gen
from evalmill.plans import fixtures as fx
from evalmill.plans.registry import query, view

KEYS = ["task", "doc_id"]


@query(
    "sampling_preprocess",
    """
    SELECT doc_id, pos, trim(CASE WHEN pos % 5 = 4 THEN '' ELSE ' ' || upper(answer) || ' ' END) AS answer, upper(gold) AS gold,
           CAST(pos % 5 <> 4 AND starts_with(answer, left(gold, 3)) AS INT) AS score
    FROM generations
    """,
)
def sampling_preprocess(spark, sf_dir):
    raw = fx.generations(spark, sf_dir).withColumn(
        "answer", F.when(F.col("pos") % 5 != 4, F.concat(F.lit(" "), "answer", F.lit(" ")))
    )
    df = gen.sampling_preprocess(raw, F.upper)
    short = df.withColumn("full", F.col("gold")).withColumn("gold", F.left("gold", F.lit(3)))
    return short.select("doc_id", "pos", "answer", F.col("full").alias("gold"), gen.match_score("prefix").alias("score"))


@query(
    "avg_at_n",
    "SELECT task, doc_id, round(avg((answer = gold)::INT), 6) AS avg FROM generations WHERE pos < 8 GROUP BY task, doc_id",
)
def avg_at_n(spark, sf_dir):
    return gen.avg_at_n(fx.generations(spark, sf_dir), KEYS, 8).withColumn("avg", r6(F.col("avg")))


@query(
    "maj_at_n",
    """
    WITH c AS (SELECT task, doc_id, answer, max(gold) AS gold, count(*) AS votes, min(pos) AS f FROM generations WHERE pos < 8 GROUP BY task, doc_id, answer),
    r AS (SELECT *, row_number() OVER (PARTITION BY task, doc_id ORDER BY votes DESC, f) AS rn FROM c)
    SELECT task, doc_id, answer AS majority, CAST(answer = gold AS INT) AS maj FROM r WHERE rn = 1
    """,
)
def maj_at_n(spark, sf_dir):
    return gen.maj_at_n(fx.generations(spark, sf_dir), KEYS, 8)


COUNTS = "SELECT task, doc_id, count(*) AS n, count(*) FILTER (answer = gold) AS c FROM generations GROUP BY task, doc_id"


def _choose(a, b):
    """Binomial coefficient through log-gamma, which does not overflow."""
    f = lambda x: f"lgamma(greatest(CAST({x} AS DOUBLE), 0) + 1)"
    return f"exp({f(a)} - {f(b)} - {f(f'({a}) - ({b})')})"


def _tail(n, c, k, m):
    """Closed form sum of hypergeometric terms as SQL."""
    terms = []
    for i in range(m, k + 1):
        ok = f"{i} <= {c} AND {k - i} <= {n} - {c}"
        terms.append(f"CASE WHEN {ok} THEN {_choose(c, i)} * {_choose(f'{n} - {c}', k - i)} / {_choose(n, k)} ELSE 0.0::DOUBLE END")
    return f"CASE WHEN {m} > least({c}, {k}) OR {k} > {n} THEN 0.0::DOUBLE ELSE {' + '.join(terms)} END"


@query(
    "pass_at_k",
    f"""
    WITH c AS ({COUNTS})
    SELECT task, doc_id, {", ".join(f"round(CASE WHEN n - c < {k} THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - {_choose('n - c', k)} / {_choose('n', k)} END, 6) AS pass_{k}" for k in (1, 4, 8))} FROM c
    """,
)
def pass_at_k(spark, sf_dir):
    """The oracle uses the binomial form 1 - C(n-c, k) / C(n, k)."""
    counts = gen.correct_counts(fx.generations(spark, sf_dir), KEYS)
    return counts.select(*KEYS, *[r6(gen.pass_at_k(F.col("n"), F.col("c"), k)).alias(f"pass_{k}") for k in (1, 4, 8)])


@query(
    "g_pass_at_k",
    f"""
    WITH c AS ({COUNTS})
    SELECT task, doc_id, {", ".join(f'round({_tail("n", "c", 4, m)}, 6) AS "g_pass_4_{t}"' for t, m in ((0.0, 1), (0.25, 1), (0.5, 2), (0.75, 3), (1.0, 4)))} FROM c
    """,
)
def g_pass_at_k(spark, sf_dir):
    counts = gen.correct_counts(fx.generations(spark, sf_dir), KEYS)
    return counts.select(*KEYS, *[r6(v).alias(n) for n, v in gen.g_pass_at_k(F.col("n"), F.col("c"), 4).items()])


@query(
    "mg_pass_at_k",
    f"""
    WITH c AS ({COUNTS})
    SELECT task, doc_id, round(2.0::DOUBLE / 4 * ({_tail("n", "c", 4, 3)} + {_tail("n", "c", 4, 4)}), 6) AS mg_pass_4 FROM c
    """,
)
def mg_pass_at_k(spark, sf_dir):
    counts = gen.correct_counts(fx.generations(spark, sf_dir), KEYS)
    return counts.select(*KEYS, r6(gen.mg_pass_at_k(F.col("n"), F.col("c"), 4)).alias("mg_pass_4"))


@query(
    "codegen_pass_at_k",
    f"""
    WITH g AS (SELECT l_suppkey AS problem, l_orderkey % 20 AS generation, bool_and(l_discount > 0) AS ok FROM lineitem GROUP BY l_suppkey, l_orderkey % 20),
    c AS (SELECT problem, count(*) AS n, count(*) FILTER (ok) AS c FROM g GROUP BY problem)
    SELECT problem, n, c, {", ".join(f"round(CASE WHEN n < {k} THEN NULL WHEN n - c < {k} THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - {_choose('n - c', k)} / {_choose('n', k)} END, 6) AS pass_{k}" for k in (1, 5))} FROM c
    """,
)
def codegen_pass_at_k(spark, sf_dir):
    """Lines as test outcomes: a discount above 0 passes."""
    tests = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("problem"), (F.col("l_orderkey") % 20).alias("generation"), F.col("l_discount").alias("result")
    )
    out = gen.codegen_pass_at_k(tests, "problem", "generation", "result", (1, 5))
    return out.select("problem", "n", "c", r6(F.col("pass_1")).alias("pass_1"), r6(F.col("pass_5")).alias("pass_5"))


@query(
    "epoch_reducer",
    f"""
    WITH s AS (SELECT doc_id, (answer = gold)::DOUBLE + (pos % 3) / 4.0::DOUBLE AS v FROM generations),
    m AS (SELECT doc_id, v FROM (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, v DESC) AS rn FROM s GROUP BY doc_id, v) WHERE rn = 1),
    a AS (SELECT doc_id, avg(v) AS mean, median(v) AS median, max(v) AS mx, count(*) AS n, count(*) FILTER (v >= 1) AS c FROM s GROUP BY doc_id)
    SELECT a.doc_id, round(mean, 6) AS mean, round(median, 6) AS median, mx AS "max", CASE WHEN c >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS at_least_n,
           round(CASE WHEN n - c < 2 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - {_choose('n - c', 2)} / {_choose('n', 2)} END, 6) AS pass_at_k, m.v AS mode
    FROM a JOIN m USING (doc_id)
    """,
)
def epoch_reducer(spark, sf_dir):
    df = fx.generations(spark, sf_dir)
    v = (F.col("answer") == F.col("gold")).cast("double") + (F.col("pos") % 3) / 4.0
    out = gen.epoch_reducer(df.select("doc_id", v.alias("v")), ["doc_id"], "v", n=2, k=2)
    return out.select("doc_id", r6(F.col("mean")).alias("mean"), r6(F.col("median")).alias("median"), "max", "at_least_n", r6(F.col("pass_at_k")).alias("pass_at_k"), "mode")


view(
    "judged_turns",
    """
    SELECT conv_id, turn // 2 AS pair, max(text) FILTER (role = 'user') AS question, max(text) FILTER (role = 'assistant') AS answer
    FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id, turn // 2
    """,
)


@query(
    "multi_turn_scores",
    """
    WITH p AS (SELECT *, lag(pair) OVER w AS p0, lag(question) OVER w AS q0, lag(answer) OVER w AS a0 FROM judged_turns WINDOW w AS (PARTITION BY conv_id ORDER BY pair)),
    s AS (SELECT conv_id, pair, concat(CASE WHEN p0 = pair - 1 THEN concat('Question: ', q0, chr(10), 'Answer: ', a0, chr(10)) ELSE '' END, 'Question: ', question, chr(10), 'Answer: ', answer) AS prompt,
                 length(answer) % 10 AS score FROM p)
    SELECT conv_id, CAST(pair AS INT) AS pair, md5(prompt) AS prompt_hash, CAST(coalesce(score, -1) AS INT) AS judge_score FROM s
    """,
)
def multi_turn_scores(spark, sf_dir):
    """Every judged exchange of a dialogue, a user and an assistant row, with the exchange before it.

    The exchange before is joined by its number, so a long dialogue is no group of its own.
    """
    conv = fx.table(spark, sf_dir, "conversations").filter("role IN ('user', 'assistant')")
    part = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    turns = conv.groupBy("conv_id", F.floor(F.col("turn") / 2).cast("int").alias("pair")).agg(
        part("user").alias("question"), part("assistant").alias("answer")
    )
    none = F.lit("")
    block = lambda q, a: F.concat(F.lit("Question: "), F.coalesce(q, none), F.lit("\nAnswer: "), F.coalesce(a, none))
    own = block(F.col("question"), F.col("answer"))
    before = turns.select("conv_id", (F.col("pair") + 1).alias("pair"), F.concat(own, F.lit("\n")).alias("before"))
    verdict = F.concat(F.lit("<score> "), (F.length("answer") % 10).cast("string"), F.lit(" </score>"))
    judged = turns.join(before, ["conv_id", "pair"], "left").withColumn("prompt", F.concat(F.coalesce("before", none), own))
    score = F.when(F.col("answer").isNotNull(), tx.verdict_score(verdict))
    return judged.select("conv_id", "pair", F.md5("prompt").alias("prompt_hash"), F.coalesce(score, F.lit(-1)).alias("judge_score"))
