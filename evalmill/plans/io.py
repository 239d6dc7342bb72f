"""Sources and sinks as round trips: a table is written, then read back.

Every run writes into a new folder of its own under the shared folder.
"""

import uuid

from pyspark.sql import functions as F

from evalmill.functions.arrays import r6
from evalmill.operators.joins import baseline_delta
from evalmill.plans import fixtures as fx
from evalmill.plans.documents import mcq_rows
from evalmill.plans.registry import query
from evalmill.plans.uncertainty import scored, task_scores
from evalmill.session import shared_folder
from evalmill.sources import readers as rd
from evalmill.sources import writers as wr


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "load_mcq_csv",
    """
    SELECT question || chr(10) || 'choose "one"' AS question, choices[1] || '|' || choices[4] AS ends, ['A', 'B', 'C', 'D'][gold + 1] AS answer, subject FROM mcq_rows
    """,
)
def load_mcq_csv(spark, sf_dir):
    """Questions with line breaks and quotes survive the CSV."""
    c = lambda i: F.get("choices", F.lit(i))
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    rows = mcq_rows(spark, sf_dir).select(
        F.concat("question", F.lit('\nchoose "one"')).alias("question"), c(0).alias("a"), c(1).alias("b"), c(2).alias("c"), c(3).alias("d"),
        F.get(letters, F.col("gold")).alias("answer"), "subject",
    )
    path = _folder(spark, "mcq")
    rows.write.partitionBy("subject").option("escape", '"').csv(path)
    return rd.load_mcq_csv(spark, path).select("question", F.concat_ws("|", "a", "d").alias("ends"), "answer", "subject")


@query("load_dataset", "SELECT doc_id, n_chars, lang AS split FROM documents")
def load_dataset(spark, sf_dir):
    path = _folder(spark, "dataset")
    fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("lang").alias("split")).write.partitionBy("split").parquet(path)
    return rd.load_dataset(spark, path, ["de", "en", "es", "fr"])


@query(
    "load_many",
    """
    SELECT 'docs' AS task, doc_id AS id, text, -1 AS turn FROM documents UNION ALL SELECT 'chat', conv_id, text, turn FROM conversations
    """,
)
def load_many(spark, sf_dir):
    rows = rd.load_many(spark, {"docs": f"{sf_dir}/documents.parquet", "chat": f"{sf_dir}/conversations.parquet"})
    return rows.select("task", F.coalesce("doc_id", "conv_id").alias("id"), "text", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"))


@query(
    "load_prompt_jsonl",
    "SELECT id AS key, question AS prompt, 'punctuation:no_comma,format:list' AS ids, CAST(gold AS VARCHAR) AS n FROM mcq_rows",
)
def load_prompt_jsonl(spark, sf_dir):
    ids = F.array(F.lit("punctuation:no_comma"), F.lit("format:list"))
    kwargs = F.array(F.create_map(F.lit("n"), F.col("gold").cast("string")))
    path = _folder(spark, "prompts")
    wr.write_outputs_jsonl(mcq_rows(spark, sf_dir).select(F.col("id").alias("key"), F.col("question").alias("prompt"), ids.alias("instruction_id_list"), kwargs.alias("kwargs")), path)
    return rd.load_prompt_jsonl(spark, path).select("key", "prompt", F.array_join("instruction_id_list", ",").alias("ids"), F.col("kwargs")[0]["n"].alias("n"))


@query(
    "prompt_to_response",
    """
    WITH r AS (SELECT DISTINCT question AS prompt, upper(question) AS response FROM mcq_rows WHERE id % 2 = 0)
    SELECT id, question AS prompt, coalesce(response, '') AS response FROM mcq_rows LEFT JOIN r ON question = prompt
    """,
)
def prompt_to_response(spark, sf_dir):
    rows = mcq_rows(spark, sf_dir)
    path = _folder(spark, "responses")
    wr.write_outputs_jsonl(rows.filter("id % 2 = 0").select(F.col("question").alias("prompt"), F.upper("question").alias("response")), path)
    responses = spark.read.json(path, schema="prompt string, response string")
    out = rd.prompt_to_response(rows.select("id", F.col("question").alias("prompt")), responses)
    return out.fillna("", ["response"])


@query(
    "load_task_json",
    "SELECT subject AS task, question, CAST(gold AS VARCHAR) AS label FROM mcq_rows",
)
def load_task_json(spark, sf_dir):
    """One JSON object per subject and chunk of 50 rows, task -> records, on a line of its own."""
    record = F.create_map(F.lit("question"), F.col("question"), F.lit("label"), F.col("gold").cast("string"))
    rows = mcq_rows(spark, sf_dir).select("id", "subject", record.alias("r"))
    chunks = rows.groupBy(F.floor(F.col("id") / 50).alias("chunk"), "subject").agg(F.collect_list("r").alias("rs"))
    path = _folder(spark, "tasks")
    chunks.select(F.to_json(F.create_map("subject", "rs")).alias("value")).write.text(path)
    files = rd.load_task_json(spark, path, lines=True)
    return files.select("task", F.col("record")["question"].alias("question"), F.col("record")["label"].alias("label"))


@query("drop_all_null_columns", "SELECT id, question FROM mcq_rows")
def drop_all_null_columns(spark, sf_dir):
    rows = mcq_rows(spark, sf_dir).select("id", "question", F.lit(None).cast("double").alias("max_score"), F.lit(None).cast("string").alias("note"))
    path = _folder(spark, "nulls")
    wr.save_questions(rows, path)
    back = spark.read.csv(path, header=True, schema="id long, question string, max_score double, note string")
    return rd.drop_all_null_columns(back)


@query("save_questions", "SELECT id, question, round(gold / 4.0::DOUBLE, 6) AS score FROM mcq_rows")
def save_questions(spark, sf_dir):
    path = _folder(spark, "questions")
    wr.save_questions(mcq_rows(spark, sf_dir).select("id", "question", (F.col("gold") / 4.0).alias("score")), path)
    return spark.read.csv(path, header=True, schema="id long, question string, score double")


def _details(spark, sf_dir):
    runs = F.concat(F.lit("2024-01-0"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("T00-00-00"))
    return scored(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("sample"), "task", runs.alias("run_id"), "em", "f1")


@query(
    "save_details",
    "SELECT CAST('2024-01-0' || (1 + doc_id % 3) || 'T00-00-00' AS VARCHAR) AS run_id, task, count(*) AS n, round(sum(f1), 5) AS f1 FROM scored GROUP BY 1, task",
)
def save_details(spark, sf_dir):
    path = _folder(spark, "details")
    wr.save_details(_details(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(F.col("run_id").cast("string").alias("run_id"), "task").agg(F.count("*").alias("n"), F.round(F.sum("f1"), 5).alias("f1"))


@query(
    "load_details",
    "SELECT doc_id AS sample, task, em FROM scored WHERE doc_id % 3 = 2 AND task IN ('click:sub0', 'view:sub3')",
)
def load_details(spark, sf_dir):
    path = _folder(spark, "details")
    wr.save_details(_details(spark, sf_dir), path)
    return rd.load_details(spark, path, ["click:sub0", "view:sub3"], "last").select("sample", "task", "em")


CONFIG = {"model_name": "org/model", "num_fewshot": 0}


@query(
    "save_results",
    "SELECT task, metric, round(value, 6) AS value, 'org/model' AS model_name FROM task_scores",
)
def save_results(spark, sf_dir):
    """The nested document is small (one row per task and metric) by construction."""
    path = wr.results_path(_folder(spark, "out"), "org/model", "run1")
    wr.save_results(wr.results_document(task_scores(spark, sf_dir), CONFIG), path)
    doc = spark.read.text(path).select(
        F.from_json("value", "config_general map<string,string>, results map<string,map<string,double>>").alias("d")
    )
    rows = doc.select(F.col("d.config_general")["model_name"].alias("model_name"), F.explode("d.results").alias("task", "scores"))
    return rows.select("model_name", "task", F.explode("scores").alias("metric", "v")).select("model_name", "task", "metric", r6(F.col("v")).alias("value"))


@query("results_as_parquet", "SELECT 'org/model' AS model_name, count(DISTINCT task) AS n_tasks, '0' AS num_fewshot FROM task_scores")
def results_as_parquet(spark, sf_dir):
    path = _folder(spark, "results")
    wr.results_as_parquet(wr.results_document(task_scores(spark, sf_dir), CONFIG), path)
    back = spark.read.parquet(path)
    conf = F.from_json("config_general", "map<string,string>")
    n = F.size(F.map_keys(F.from_json("results", "map<string,map<string,double>>")))
    return back.select(conf["model_name"].alias("model_name"), n.cast("long").alias("n_tasks"), conf["num_fewshot"].alias("num_fewshot"))


@query(
    "append_eval_log",
    "SELECT event_id // 1000 AS epoch, event_id AS step, round(exp(value / 100), 6) AS perplexity FROM events",
)
def append_eval_log(spark, sf_dir):
    """Two appends, read as one log."""
    rows = fx.table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 1000).alias("epoch"), F.col("event_id").alias("step"), r6(F.exp(F.col("value") / 100)).alias("perplexity")
    )
    path = _folder(spark, "log")
    wr.append_eval_log(rows.filter("step % 2 = 0"), path)
    wr.append_eval_log(rows.filter("step % 2 = 1"), path)
    return spark.read.csv(path, header=True, schema="epoch long, step long, perplexity double")


@query(
    "sweep_csv",
    "SELECT 'drop_' || (user_id % 32) AS label, user_id % 32 AS start, round(avg(f1), 6) AS acc FROM scored GROUP BY user_id % 32",
)
def sweep_csv(spark, sf_dir):
    df = scored(spark, sf_dir)
    sweep = df.groupBy((F.col("user_id") % 32).alias("start")).agg(r6(F.avg("f1")).alias("acc"))
    rows = baseline_delta(sweep, df.agg(F.avg("f1")), "acc").withColumn("label", F.concat(F.lit("drop_"), F.col("start").cast("string")))
    path = _folder(spark, "sweep")
    wr.sweep_csv(rows, path)
    return spark.read.csv(path, header=True, schema="label string, start long, acc double")
