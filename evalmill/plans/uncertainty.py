"""Standard errors, bootstrap, rollups and result tables."""

from pyspark.sql import functions as F

from evalmill.functions.arrays import r6
from evalmill.operators import boards, stats
from evalmill.plans import fixtures as fx
from evalmill.plans.registry import query, view

view(
    "scored",
    """
    SELECT event_id AS doc_id, 'model' || (user_id % 3) AS model, event_type || ':sub' || (user_id % 4) AS task,
           event_type AS suite, CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em,
           value / 500 AS f1, value, user_id, ts, props
    FROM events
    """,
)


def scored(spark, sf_dir):
    """Events as scored samples of three models over suites of four subtasks."""
    user = F.col("user_id")
    return fx.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"),
        F.concat(F.lit("model"), (user % 3).cast("string")).alias("model"),
        F.concat("event_type", F.lit(":sub"), (user % 4).cast("string")).alias("task"),
        F.col("event_type").alias("suite"),
        F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(0.0).alias("em"),
        (F.col("value") / 500).alias("f1"),
        "value",
        "user_id",
        "ts",
        "props",
    )


view(
    "task_scores",
    """
    SELECT task, metric, avg(v) AS value, stddev_samp(v) / sqrt(count(*)) AS stderr, count(*) AS n
    FROM (SELECT task, 'em' AS metric, em AS v FROM scored UNION ALL SELECT task, 'f1', f1 FROM scored)
    GROUP BY task, metric
    """,
)


def task_scores(spark, sf_dir, keys=("task",)):
    long = stats.to_long(scored(spark, sf_dir), ["doc_id", *keys], ["em", "f1"])
    return stats.aggregate_tasks(long, {"em": "mean", "f1": "mean"}, keys)


def _rounded(df, *cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


@query("mean_stderr", "SELECT task, round(stddev_samp(f1) / sqrt(count(*)), 6) AS stderr, count(*) AS n FROM scored GROUP BY task")
def mean_stderr(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("task").agg(r6(stats.mean_stderr("f1")).alias("stderr"), F.count("*").alias("n"))


@query(
    "stderr_choice",
    """
    SELECT task, corpus_function, CASE WHEN corpus_function = 'mean' THEN 'mean_stderr' ELSE 'bootstrap' END AS kind, count(*) AS n
    FROM (SELECT task, CASE WHEN suite IN ('click', 'view') THEN 'mean' ELSE 'mcc' END AS corpus_function FROM scored)
    GROUP BY task, corpus_function
    """,
)
def stderr_choice(spark, sf_dir):
    fn = F.when(F.col("suite").isin("click", "view"), "mean").otherwise("mcc")
    df = scored(spark, sf_dir).groupBy("task", fn.alias("corpus_function")).agg(F.count("*").alias("n"))
    return df.withColumn("kind", stats.stderr_kind(F.col("corpus_function"), 1000))


BOOT = """
    WITH draws AS (
      SELECT suite, f1, doc_id, b, j,
             len(list_filter([24109, 48218, 60273, 64291, 65296, 65497, 65531, 65535],
                 lambda t: t <= CAST('0x' || substr(h, j * 4 + 1, 4) AS INT))) AS w
      FROM (SELECT suite, f1, doc_id, b, md5(b || ':' || doc_id) AS h, unnest(range(0, 8)) AS j
            FROM (SELECT suite, f1, doc_id, unnest(range(0, 125)) AS b FROM scored))),
    reps AS (SELECT suite, b * 8 + j AS replicate, sum(f1 * w) / sum(w) AS m FROM draws GROUP BY suite, b * 8 + j)
"""


@query(
    "bootstrap_stderr",
    BOOT
    + """
    SELECT suite, round(stddev_samp(m) / sqrt(count(*)), 6) AS stderr, count(*) AS replicates FROM reps GROUP BY suite
    """,
)
def bootstrap_stderr(spark, sf_dir):
    reps = stats.bootstrap_replicates(scored(spark, sf_dir), ["suite"], "doc_id", {"s": F.col("f1")}, 1000)
    out = stats.bootstrap_stderr(reps, ["suite"], F.col("s") / F.col("weight"))
    return out.select("suite", r6(F.col("stderr")).alias("stderr"), "replicates")


@query(
    "bootstrap_distribution_se",
    BOOT + "SELECT suite, round(stddev_samp(m), 6) AS distribution_se FROM reps GROUP BY suite",
)
def bootstrap_distribution_se(spark, sf_dir):
    reps = stats.bootstrap_replicates(scored(spark, sf_dir), ["suite"], "doc_id", {"s": F.col("f1")}, 1000)
    out = stats.bootstrap_stderr(reps, ["suite"], F.col("s") / F.col("weight"))
    return out.select("suite", r6(F.col("distribution_se")).alias("distribution_se"))


@query(
    "overflow_to_nan",
    """
    SELECT task, max(value) > 470 AS is_nan, round(CASE WHEN max(value) > 470 THEN -1.0::DOUBLE ELSE max(value) * 1.5::DOUBLE END, 6) AS value
    FROM scored GROUP BY task
    """,
)
def overflow_to_nan(spark, sf_dir):
    """exp overflows above 709.78; values above 470 are mapped past it."""
    exponent = F.when(F.col("value") > 470, 1000.0).otherwise(F.col("value") * 1.5)
    agg = scored(spark, sf_dir).groupBy("task").agg(F.max(F.exp(exponent)).alias("v"))
    v = stats.overflow_to_nan(F.col("v"))
    return agg.select("task", F.isnan(v).alias("is_nan"), r6(F.when(F.isnan(v), -1.0).otherwise(F.log(v))).alias("value"))


@query(
    "log_sample_scores",
    """
    SELECT model, task, doc_id, metric, round(v, 6) AS value FROM (
      SELECT model, task, doc_id, 'em' AS metric, em AS v FROM scored UNION ALL SELECT model, task, doc_id, 'f1', f1 FROM scored)
    """,
)
def log_sample_scores(spark, sf_dir):
    return _rounded(stats.to_long(scored(spark, sf_dir), ["model", "task", "doc_id"], ["em", "f1"]), "value")


@query(
    "aggregate_tasks",
    "SELECT task, metric, round(value, 6) AS value, round(stderr, 6) AS stderr, n FROM task_scores",
)
def aggregate_tasks(spark, sf_dir):
    return _rounded(task_scores(spark, sf_dir), "value", "stderr")


@query(
    "subtask_average",
    """
    SELECT split_part(task, ':', 1) || ':_average|0' AS task, metric, round(avg(value), 6) AS value, round(avg(stderr), 6) AS stderr
    FROM task_scores GROUP BY split_part(task, ':', 1), metric HAVING count(*) > 1
    """,
)
def subtask_average(spark, sf_dir):
    df = task_scores(spark, sf_dir).withColumn("shots", F.lit(0))
    return _rounded(stats.subtask_average(df), "value", "stderr")


@query(
    "overall_average",
    "SELECT 'all' AS task, metric, round(avg(value), 6) AS value, round(avg(stderr), 6) AS stderr, count(*) AS n_tasks FROM task_scores GROUP BY metric",
)
def overall_average(spark, sf_dir):
    base = task_scores(spark, sf_dir)
    with_means = base.select("task", "metric", "value", "stderr").unionByName(
        stats.subtask_average(base.withColumn("shots", F.lit(0)))
    )
    return _rounded(stats.overall_average(with_means), "value", "stderr").select(F.lit("all").alias("task"), "*")


@query(
    "group_hierarchy",
    """
    SELECT coalesce(suite, 'total') AS suite, coalesce(task, 'all') AS task, round(avg(em), 6) AS value, count(*) AS n,
           CAST(grouping(suite) * 2 + grouping(task) AS BIGINT) AS level
    FROM scored GROUP BY ROLLUP (suite, task)
    """,
)
def group_hierarchy(spark, sf_dir):
    df = boards.group_hierarchy(scored(spark, sf_dir), "suite", "task", "em")
    return df.select(
        F.coalesce("suite", F.lit("total")).alias("suite"),
        F.coalesce("task", F.lit("all")).alias("task"),
        r6(F.col("value")).alias("value"),
        "n",
        F.col("level").cast("long").alias("level"),
    )


view(
    "model_scores",
    "SELECT model, task, 'f1' AS metric, avg(f1) AS value FROM scored GROUP BY model, task",
)


def model_scores(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("model", "task").agg(F.avg("f1").alias("value")).withColumn("metric", F.lit("f1"))


@query(
    "mean_by_prefix",
    """
    SELECT model, task, metric, round(value, 6) AS value FROM model_scores
    UNION ALL SELECT model, split_part(task, ':', 1), metric, round(avg(value), 6) FROM model_scores GROUP BY model, split_part(task, ':', 1), metric
    """,
)
def mean_by_prefix(spark, sf_dir):
    return _rounded(boards.mean_by_prefix(model_scores(spark, sf_dir)), "value")


def _cell(task):
    return f"""coalesce(printf('%.2f', max(value) FILTER (task = '{task}')), '-') AS "{task}" """


@query(
    "leaderboard_pivot",
    f"""
    WITH m AS (SELECT * FROM model_scores WHERE NOT (model = 'model1' AND task = 'view:sub3'))
    SELECT model, {_cell('click:sub0')}, {_cell('click:sub1')}, '...' AS "...", {_cell('view:sub3')} FROM m GROUP BY model
    """,
)
def leaderboard_pivot(spark, sf_dir):
    """Twenty subtasks shown in three columns and a gap; one score is missing."""
    rows = model_scores(spark, sf_dir).filter(~((F.col("model") == "model1") & (F.col("task") == "view:sub3")))
    tasks = [f"{s}:sub{i}" for s in ("click", "error", "signup", "purchase", "view") for i in range(4)]
    return boards.leaderboard(rows, tasks, max_columns=3)


@query(
    "results_table",
    """
    SELECT task, CASE WHEN task LIKE 'click%' THEN '' ELSE CAST(length(split_part(task, ':', 1)) AS VARCHAR) END AS version, metric,
           printf('%.4f', value) AS value, '±' AS sign, printf('%.4f', stderr) AS stderr FROM task_scores
    """,
)
def results_table(spark, sf_dir):
    df = task_scores(spark, sf_dir)
    versions = df.select("task").distinct().filter(~F.col("task").startswith("click"))
    versions = versions.withColumn("version", F.length(stats.suite_of(F.col("task"))))
    return boards.results_table(df, versions).orderBy("task", "metric")


@query("sample_hashes", "SELECT doc_id, md5(text) AS query_hash, md5(text || chr(1) || lang) AS full_hash FROM documents")
def sample_hashes(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", boards.sample_hash("text").alias("query_hash"), boards.sample_hash("text", "lang").alias("full_hash")
    )


def _sum_hash(col):
    words = ", ".join(f"CAST(sum(CAST('0x' || substr({col}, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(4))
    return f"md5(concat_ws(':', CAST(count(*) AS VARCHAR), {words}))"


@query("task_hash", f"SELECT lang AS task, {_sum_hash('h')} AS hash FROM (SELECT lang, md5(text) AS h FROM documents) GROUP BY lang")
def task_hash(spark, sf_dir):
    df = fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("task"), boards.sample_hash("text").alias("h"))
    return df.groupBy("task").agg(boards.multiset_hash("h").alias("hash"))


@query(
    "run_hash",
    f"""
    SELECT md5(string_agg(task || '=' || hash, ';' ORDER BY task)) AS hash FROM (
      SELECT lang AS task, {_sum_hash('h')} AS hash FROM (SELECT lang, md5(text) AS h FROM documents) GROUP BY lang)
    """,
)
def run_hash(spark, sf_dir):
    """One row per task reaches the last step, in task order."""
    tasks = task_hash(spark, sf_dir)
    pairs = F.array_sort(F.collect_list(F.struct("task", "hash")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["task"], F.lit("="), p["hash"])), ";")
    return tasks.agg(F.md5(text).alias("hash"))


@query(
    "truncation_counts",
    """
    SELECT coalesce(lang, 'all') AS task, count(*) FILTER (n_chars > 2000) AS truncated, count(*) FILTER (n_chars <= 2000) AS non_truncated,
           count(*) FILTER (n_chars < 300) AS padded, count(*) FILTER (n_chars >= 300) AS non_padded
    FROM documents GROUP BY ROLLUP (lang)
    """,
)
def truncation_counts(spark, sf_dir):
    df = fx.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("task"),
        F.greatest(F.col("n_chars") - 2000, F.lit(0)).alias("truncated"),
        F.greatest(300 - F.col("n_chars"), F.lit(0)).alias("padded"),
    )
    return boards.truncation_counts(df)


@query(
    "config_hash",
    """
    SELECT p_partkey, substr(sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}'), 1, 16) AS hash FROM part
    """,
)
def config_hash(spark, sf_dir):
    fields = {"name": F.col("p_name"), "size": F.col("p_size"), "brand": F.col("p_brand")}
    return fx.table(spark, sf_dir, "part").select("p_partkey", boards.config_hash(fields).alias("hash"))


@query(
    "latest_run_per_task",
    """
    SELECT task, run_id, run_id = max(run_id) OVER () AS is_latest FROM (
      SELECT event_type AS task, max(strftime(ts, '%Y-%m-%dT%H-%M-%S')) AS run_id FROM events GROUP BY event_type)
    """,
)
def latest_run_per_task(spark, sf_dir):
    """Run ids are ISO times with dashes for colons, parsed back to timestamps."""
    runs = fx.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("task"), F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss").alias("run_id")
    )
    runs = runs.withColumn("run_time", F.to_timestamp("run_id", "yyyy-MM-dd'T'HH-mm-ss"))
    return boards.latest_run_per_task(runs).select("task", "run_id", "is_latest")


@query(
    "suite_average",
    "SELECT split_part(task, ':', 1) AS suite, metric, round(avg(value), 6) AS value FROM task_scores GROUP BY split_part(task, ':', 1), metric",
)
def suite_average(spark, sf_dir):
    base = task_scores(spark, sf_dir)
    errors = base.select("task", F.concat("metric", F.lit("_stderr")).alias("metric"), F.col("stderr").alias("value"))
    rows = base.select("task", "metric", "value").unionByName(errors)
    return _rounded(stats.suite_average(rows), "value")


@query(
    "union_suite_details",
    "SELECT strftime(ts, '%Y-%m-%d') AS run_date, task, count(*) AS n, round(avg(f1), 6) AS f1 FROM scored WHERE suite = 'click' GROUP BY run_date, task",
)
def union_suite_details(spark, sf_dir):
    details = boards.union_suite_details(scored(spark, sf_dir), "click")
    return details.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_date"), "task").agg(
        F.count("*").alias("n"), r6(F.avg("f1")).alias("f1")
    )


@query(
    "corpus_mean",
    "SELECT task, round(avg(f1), 6) AS value FROM scored GROUP BY task",
)
def corpus_mean(spark, sf_dir):
    long = stats.to_long(scored(spark, sf_dir), ["doc_id", "task"], ["f1"])
    return _rounded(stats.aggregate_tasks(long, {"f1": "mean"}).select("task", "value"), "value")


@query(
    "corpus_max_min",
    "SELECT task, round(max(f1), 6) AS longest_prefix, round(min(value), 6) AS edit_distance, round(max(em), 6) AS drop_em FROM scored GROUP BY task",
)
def corpus_max_min(spark, sf_dir):
    """Each member of a metric group keeps its own corpus function."""
    df = scored(spark, sf_dir).select("doc_id", "task", F.col("f1").alias("longest_prefix"), F.col("value").alias("edit_distance"), F.col("em").alias("drop_em"))
    names = ["longest_prefix", "edit_distance", "drop_em"]
    spec = {"longest_prefix": "max", "edit_distance": "min", "drop_em": "max"}
    out = stats.aggregate_tasks(stats.to_long(df, ["doc_id", "task"], names), spec)
    return _rounded(out.groupBy("task").pivot("metric", names).agg(F.first("value")), *names)


@query(
    "corpus_sum",
    "SELECT task, CAST(sum(em) AS DOUBLE) AS total FROM scored GROUP BY task",
)
def corpus_sum(spark, sf_dir):
    long = stats.to_long(scored(spark, sf_dir), ["doc_id", "task"], ["em"])
    return stats.aggregate_tasks(long, {"em": "sum"}).select("task", F.col("value").alias("total"))


@query(
    "mean_div_5",
    "SELECT task, round(avg(value) / 5, 6) AS value FROM scored GROUP BY task",
)
def mean_div_5(spark, sf_dir):
    df = scored(spark, sf_dir).select("doc_id", "task", F.col("value").alias("judge"))
    long = stats.to_long(df, ["doc_id", "task"], ["judge"])
    return _rounded(stats.aggregate_tasks(long, {"judge": "mean_div_5"}).select("task", "value"), "value")
