"""Writers: details, results, scores, logs."""

from pyspark.sql import functions as F


def write_outputs_jsonl(df, path):
    df.write.mode("overwrite").json(path)


def save_questions(df, path):
    """Scored frame to CSV with a header; blanks at the edges of a text are kept."""
    edges = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, escape='"', **edges).csv(path)


def save_details(df, path, drop=("id",)):
    """One folder per run and task; columns in name order, ids dropped.

    Every input partition writes its own files, so nothing is shuffled and one
    large task is written by many executors.
    """
    names = sorted(c for c in df.columns if c not in drop and c not in ("run_id", "task"))
    df.select(*names, "run_id", "task").write.mode("append").partitionBy("run_id", "task").parquet(path)


def results_document(task_scores, config):
    """One row: the nested result document as JSON."""
    entries = F.array_sort(F.collect_list(F.struct("metric", "value")))
    per_task = task_scores.groupBy("task").agg(entries.alias("scores"))
    tasks = F.array_sort(F.collect_list(F.struct("task", "scores")))
    nested = F.transform(tasks, lambda t: F.struct(t["task"], F.map_from_entries(t["scores"])))
    results = F.map_from_entries(nested)
    conf = F.create_map(*[F.lit(str(x)) for kv in sorted(config.items()) for x in kv])
    return per_task.agg(results.alias("results")).select(conf.alias("config_general"), "results")


def results_path(root, model, run_id, template="{root}/results/{org}/{model}"):
    """Path of a result document from an ``org/model`` name."""
    org, _, name = model.rpartition("/")
    return template.format(root=root, org=org, model=name) + f"/results_{run_id}"


def save_results(document, path):
    """The document as one JSON line."""
    document.select(F.to_json(F.struct(*document.columns)).alias("value")).write.mode("overwrite").text(path)


def results_as_parquet(document, path):
    """One JSON-encoded column per section."""
    document.select(*[F.to_json(c).alias(c) for c in document.columns]).write.mode("overwrite").parquet(path)


def append_eval_log(rows, path):
    """Append (epoch, step, perplexity) rows."""
    rows.select("epoch", "step", "perplexity").write.mode("append").option("header", True).csv(path)


def sweep_csv(rows, path):
    rows.select("label", "start", "acc").write.mode("overwrite").option("header", True).csv(path)
