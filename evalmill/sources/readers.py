"""Readers: CSV questions, JSON prompts, task JSON, saved details."""

from functools import reduce

from pyspark.sql import functions as F

MCQ_SCHEMA = "question string, a string, b string, c string, d string, answer string"


def load_mcq_csv(spark, path):
    """Headless six-column multiple choice CSVs; the subject is the file's folder or name.

    Quoted fields may span lines, so a file is the unit of parallelism.
    """
    rows = spark.read.csv(path, schema=MCQ_SCHEMA, header=False, multiLine=True, escape='"', recursiveFileLookup=True)
    name = F.input_file_name()
    folder = F.regexp_extract(name, r"subject=([^/]+)/", 1)
    stem = F.regexp_extract(name, r"([^/]+?)(?:_(?:test|dev|val))?\.csv", 1)
    return rows.select("*", F.when(folder != "", folder).otherwise(stem).alias("subject"))


def load_dataset(spark, path, splits=None, fmt="parquet", schema=None):
    """All splits of a dataset laid out as ``split=<name>`` folders (pruned when named)."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.format(fmt).load(path)
    return rows.filter(F.col("split").isin(list(splits))) if splits else rows


def load_many(spark, sources):
    """Several datasets as one frame; missing columns become NULL. ``sources`` maps name -> path."""
    parts = [spark.read.parquet(p).withColumn("task", F.lit(n)) for n, p in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


PROMPT_SCHEMA = "key long, prompt string, instruction_id_list array<string>, kwargs array<map<string,string>>"


def load_prompt_jsonl(spark, path, schema=PROMPT_SCHEMA):
    """One instruction prompt per line."""
    return spark.read.json(path, schema=schema)


def prompt_to_response(prompts, responses):
    """Responses looked up by prompt text; of several for one prompt the greatest is kept on every run."""
    return prompts.join(responses.groupBy("prompt").agg(F.max("response").alias("response")), "prompt", "left")


def load_task_json(spark, path, record="map<string,string>", lines=False):
    """JSON objects task -> records to one row per record.

    A file holds one object and is read whole; with ``lines`` it holds an object on
    each line, so there are few files for many objects and a large one is split.
    """
    text = spark.read.text(path, wholetext=not lines)
    tasks = text.select(F.explode(F.from_json("value", f"map<string,array<{record}>>")).alias("task", "records"))
    return tasks.select("task", F.posexplode("records").alias("row_ix", "record"))


def drop_all_null_columns(df):
    """Columns that hold at least one value (one aggregate over all columns decides)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] > 0])


def load_details(spark, path, tasks=None, run="last"):
    """Saved details of one run (an id, ``first`` or ``last``) for the wanted tasks.

    The run is chosen from the partition folder names, so only its files are
    read; a wanted task without details raises.
    """
    details = spark.read.parquet(path)
    if run in ("first", "last"):
        pick = F.min if run == "first" else F.max
        run = details.select("run_id").agg(pick(F.col("run_id").cast("string"))).first()[0]
    chosen = details.filter(F.col("run_id").cast("string") == run)
    if tasks is None:
        return chosen
    found = {r["task"] for r in chosen.filter(F.col("task").isin(list(tasks))).select("task").distinct().collect()}
    missing = sorted(set(tasks) - found)
    if missing:
        raise ValueError(f"no details for {missing} in run {run}")
    return chosen.filter(F.col("task").isin(list(tasks)))
