"""Sorts, splits, limits and padding."""

from pyspark.sql import functions as F

from evalmill.operators import ordering as od
from evalmill.plans import fixtures as fx
from evalmill.plans.registry import query


def _docs(spark, sf_dir):
    choices = F.array("lang", F.concat("source", "lang"))
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("task"), "source", od.request_length(F.col("text"), choices).cast("long").alias("size")
    )


SIZED = "(SELECT doc_id, lang AS task, source, n_chars + greatest(length(lang), length(source || lang)) AS size FROM documents)"


@query("length_sorted", f"SELECT doc_id, size FROM {SIZED} ORDER BY size DESC, doc_id")
def length_sorted(spark, sf_dir):
    return od.length_sorted(_docs(spark, sf_dir).select("doc_id", "size"), "size", "doc_id")


@query(
    "split_in_n",
    f"SELECT doc_id, p AS position, p // CAST(ceil(n / 7.0) AS BIGINT) AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY size DESC, doc_id) - 1 AS p, count(*) OVER () AS n FROM {SIZED})",
)
def split_in_n(spark, sf_dir):
    return od.split_in_n(_docs(spark, sf_dir).select("doc_id", "size"), "size", "doc_id", 7).select("doc_id", "position", "split")


@query(
    "group_by_generation_params",
    f"""
    SELECT doc_id, dense_rank() OVER (ORDER BY task, source) - 1 AS "group", row_number() OVER (PARTITION BY task, source ORDER BY size DESC, doc_id) - 1 AS position FROM {SIZED}
    """,
)
def group_by_generation_params(spark, sf_dir):
    out = od.group_by_params(_docs(spark, sf_dir), ["task", "source"], "size", "doc_id")
    return out.select("doc_id", F.col("group").cast("long").alias("group"), "position")


@query("restore_order", "SELECT doc_id, n_chars * 2 AS result FROM documents ORDER BY doc_id")
def restore_order(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    results = od.length_sorted(docs, "n_chars", "doc_id").select("doc_id", (F.col("n_chars") * 2).alias("result"))
    docs = docs.select(F.col("doc_id").alias("ix"), "doc_id")
    return od.restore_order(docs, results, "ix", ["doc_id"]).select("doc_id", "result")


@query(
    "even_pad",
    """
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents),
    a AS (SELECT doc_id, p + unnest(range(0, 1 + CASE WHEN p = n - 1 THEN (7 - n % 7) % 7 ELSE 0 END)) AS position FROM r)
    SELECT doc_id, position, position % 7 AS replica FROM a
    """,
)
def even_pad(spark, sf_dir):
    return od.even_pad(fx.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7).select("doc_id", "position", "replica")


@query("shuffle_select", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def shuffle_select(spark, sf_dir):
    return od.shuffle_select(fx.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query("preview_first", "SELECT task, doc_id, pos, answer FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY doc_id, pos) AS rn FROM generations) WHERE rn = 1")
def preview_first(spark, sf_dir):
    g = fx.generations(spark, sf_dir)
    return od.preview_first(g, "task", "doc_id", ["pos", "answer"])
