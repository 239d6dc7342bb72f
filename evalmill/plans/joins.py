"""Pairing, cache and comparison queries."""

from pyspark.sql import functions as F

from evalmill.functions.arrays import r6
from evalmill.operators import joins, stats
from evalmill.plans import fixtures as fx
from evalmill.plans.registry import query, view
from evalmill.plans.uncertainty import scored, task_scores

view(
    "order_docs",
    """
    SELECT 'prio:' || o_orderpriority AS task, o_orderkey AS doc_id, unnest(CASE WHEN o_orderkey % 3 = 0
           THEN ['GENERATIVE', 'LOGPROBS'] ELSE ['GENERATIVE'] END) AS sampling_method FROM orders
    """,
)


def order_docs(spark, sf_dir):
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return fx.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("prio:"), "o_orderpriority").alias("task"),
        F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderkey") % 3 == 0, lit("GENERATIVE", "LOGPROBS"))
        .otherwise(lit("GENERATIVE"))
        .alias("sampling_methods"),
    )


@query("route_by_sampling", "SELECT task, sampling_method, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM order_docs GROUP BY task, sampling_method")
def route_by_sampling(spark, sf_dir):
    rows = joins.route_by_sampling(order_docs(spark, sf_dir))
    return rows.groupBy("task", "sampling_method").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(
    "docs_x_responses",
    """
    SELECT d.task, d.doc_id, d.sampling_method, r.l_linenumber AS line, round(-r.l_extendedprice / 10000, 6) AS logprob
    FROM order_docs d JOIN lineitem r ON d.doc_id = r.l_orderkey
      AND d.sampling_method = CASE WHEN r.l_linenumber % 2 = 1 THEN 'GENERATIVE' ELSE 'LOGPROBS' END
    """,
)
def docs_x_responses(spark, sf_dir):
    responses = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.when(F.col("l_linenumber") % 2 == 1, "GENERATIVE").otherwise("LOGPROBS").alias("sampling_method"),
        F.col("l_linenumber").alias("line"),
        r6(-F.col("l_extendedprice") / 10000).alias("logprob"),
    )
    docs = joins.route_by_sampling(order_docs(spark, sf_dir))
    return joins.pair_with_responses(docs, responses, ("doc_id", "sampling_method"))


def _docs(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("task"), "doc_id", "n_chars")


def _cache(spark, sf_dir):
    return fx.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")


@query("cache_miss", "SELECT lang AS task, doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_miss(spark, sf_dir):
    return joins.cache_miss(_docs(spark, sf_dir), _cache(spark, sf_dir), ("doc_id",))


@query("cache_fetch", "SELECT lang AS task, doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def cache_fetch(spark, sf_dir):
    return joins.cache_fetch(_docs(spark, sf_dir), _cache(spark, sf_dir), ("doc_id",)).orderBy("doc_id")


@query(
    "cache_merge",
    """
    SELECT doc_id, CAST(quality AS BIGINT) AS answer, 'old' AS origin FROM labels
    UNION ALL SELECT doc_id, n_chars, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    """,
)
def cache_merge(spark, sf_dir):
    old = _cache(spark, sf_dir).select("doc_id", F.col("quality").cast("long").alias("answer"), F.lit("old").alias("origin"))
    new = _docs(spark, sf_dir).select("doc_id", F.col("n_chars").alias("answer"), F.lit("new").alias("origin"))
    return joins.cache_merge(old, new, ("doc_id",))


@query(
    "cache_valid_rows",
    """
    SELECT CAST(nullif(vec_id % 7, 0) AS BIGINT) AS key, count(*) AS n FROM embeddings
    WHERE vec_id % 7 <> 0 AND len(list_filter(embedding, lambda x: x > 0.3)) > 0 GROUP BY ALL
    """,
)
def cache_valid_rows(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select(
        F.nullif(F.col("vec_id") % 7, F.lit(0)).alias("key"),
        F.filter("embedding", lambda x: x > 0.3).alias("logprobs"),
    )
    return joins.cache_valid_rows(rows, ["key"], ["logprobs"]).groupBy("key").agg(F.count("*").alias("n"))


@query(
    "compare_runs",
    """
    WITH a AS (SELECT task, doc_id, pos, answer FROM generations WHERE pos % 2 = 0),
         b AS (SELECT task, doc_id, pos - 1 AS pos, answer FROM generations WHERE pos % 2 = 1 UNION ALL SELECT task, doc_id, -1, answer FROM generations WHERE pos = 0)
    SELECT task, doc_id, pos, CASE WHEN b.answer IS NULL THEN 'a' WHEN a.answer IS NULL THEN 'b' ELSE '' END AS only_in,
           coalesce(a.answer, '') AS answer_a, coalesce(b.answer, '') AS answer_b, a.answer IS NOT DISTINCT FROM b.answer AS answer_same
    FROM a FULL JOIN b USING (task, doc_id, pos)
    """,
)
def compare_runs(spark, sf_dir):
    g = fx.generations(spark, sf_dir).select("task", "doc_id", "pos", "answer")
    """Even and odd positions as two runs; an odd number of events, or the first one, is missing on a side."""
    a = g.filter("pos % 2 = 0")
    b = g.filter("pos % 2 = 1").withColumn("pos", F.col("pos") - 1).union(g.filter("pos = 0").withColumn("pos", F.lit(-1).cast("long")))
    out = joins.compare_runs(a, b, ["task", "doc_id", "pos"], ["answer"])
    return out.fillna("", ["answer_a", "answer_b"])


@query(
    "aggregation_lookup",
    """
    SELECT task, metric, CASE metric WHEN 'em' THEN 'mean' ELSE 'max' END AS corpus_function, metric = 'em' AS higher_is_better,
           round(CASE metric WHEN 'em' THEN avg(v) ELSE max(v) END, 6) AS value
    FROM (SELECT task, 'em' AS metric, em AS v FROM scored UNION ALL SELECT task, 'f1', f1 FROM scored) GROUP BY task, metric
    """,
)
def aggregation_lookup(spark, sf_dir):
    """The metric table decides the corpus function of every score row."""
    df = scored(spark, sf_dir)
    long = stats.to_long(df, ["doc_id", "task"], ["em", "f1"])
    specs = long.select("metric").distinct().select(
        "metric",
        F.when(F.col("metric") == "em", "mean").otherwise("max").alias("corpus_function"),
        (F.col("metric") == "em").alias("higher_is_better"),
    )
    out = stats.aggregate_tasks(long, {"em": "mean", "f1": "max"})
    return joins.metric_spec_lookup(out, specs).select(
        "task", "metric", "corpus_function", "higher_is_better", r6(F.col("value")).alias("value")
    )


@query(
    "version_lookup",
    """
    SELECT t.task, metric, round(value, 6) AS value, coalesce(v.version, '') AS version
    FROM task_scores t LEFT JOIN (SELECT task, CAST(count(DISTINCT user_id) AS VARCHAR) AS version FROM scored WHERE suite <> 'signup' GROUP BY task) v ON t.task = v.task
    """,
)
def version_lookup(spark, sf_dir):
    versions = scored(spark, sf_dir).filter("suite <> 'signup'").groupBy("task").agg(F.countDistinct("user_id").alias("version"))
    rows = task_scores(spark, sf_dir).select("task", "metric", r6(F.col("value")).alias("value"))
    return joins.version_lookup(rows, versions)


@query(
    "baseline_delta",
    """
    SELECT start, round(acc, 6) AS acc, round(acc - (SELECT avg(f1) FROM scored), 6) AS delta
    FROM (SELECT user_id % 32 AS start, avg(f1) AS acc FROM scored GROUP BY user_id % 32)
    """,
)
def baseline_delta(spark, sf_dir):
    df = scored(spark, sf_dir)
    sweep = df.groupBy((F.col("user_id") % 32).alias("start")).agg(F.avg("f1").alias("acc"))
    out = joins.baseline_delta(sweep, df.agg(F.avg("f1")), "acc")
    return out.select("start", r6(F.col("acc")).alias("acc"), r6(F.col("delta")).alias("delta"))
