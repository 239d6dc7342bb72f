"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from evalmill.plans import load_all  # noqa: E402

HEADLINE = [
    "task_accuracy",
    "mc_prob_norm_rows",
    "loglik_acc",
    "docs_x_responses",
    "aggregate_tasks",
    "bootstrap_stderr",
    "compare_runs",
    "g_pass_at_k",
    "maj_at_n",
    "f1_scores",
    "weighted_perplexity",
    "rouge_n",
    "bleu_corpus",
    "chrf",
    "string_distance",
    "ngram_novelty",
    "norm_multilingual",
    "extract_number",
    "tmpl_multichoice",
    "dedup_docs",
    "fewshot_attach",
    "calibration_error",
    "pack_blocks",
    "check_keywords_forbidden_words",
    "if_report",
    "scoring_job",
    "group_by_generation_params",
    "token_budget",
    "nli_pairs",
]


def session(cpus):
    """Small input splits, so single-file tables still use every core."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(max(int(cpus), 1) * 2))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(2 * 1024 * 1024))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    queries, _ = load_all()
    # warm-up: session, readers and generated code are not part of the first query
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{times[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
