"""Few-shot selection over the benchmark pool."""

from pyspark.sql import functions as F

from evalmill.operators import fewshot as fs
from evalmill.plans import fixtures as fx
from evalmill.plans.registry import query


def pool(spark, sf_dir):
    return fx.table(spark, sf_dir, "benchmark").select("item_id", F.left("text", F.lit(1)).alias("cls"), "text")


@query(
    "fewshot_sequential",
    """
    SELECT item_id, CAST((item_id - 6 + n) % n AS BIGINT) AS rank FROM (SELECT *, count(*) OVER () AS n FROM benchmark) ORDER BY rank LIMIT 4
    """,
)
def fewshot_sequential(spark, sf_dir):
    return fs.sequential(pool(spark, sf_dir), "item_id", 3, seed=2).select("item_id", "rank")


@query("fewshot_random", "SELECT item_id FROM benchmark ORDER BY md5('5:' || item_id), item_id LIMIT 6")
def fewshot_random(spark, sf_dir):
    return fs.shuffled(pool(spark, sf_dir), "item_id", 5, seed=5).select("item_id")


@query(
    "fewshot_balanced",
    """
    WITH p AS (SELECT item_id, left(text, 1) AS cls FROM benchmark),
    r AS (SELECT item_id, cls, row_number() OVER (PARTITION BY cls ORDER BY md5('3:' || item_id), item_id) AS turn, count(*) OVER (PARTITION BY cls) AS size FROM p)
    SELECT item_id, cls, turn FROM r ORDER BY turn, size DESC, md5('3:' || cls), cls LIMIT 30
    """,
)
def fewshot_balanced(spark, sf_dir):
    out = fs.balanced(pool(spark, sf_dir).select("item_id", "cls"), "item_id", "cls", 29, seed=3)
    return out.select("item_id", "cls", F.col("_turn").cast("long").alias("turn"))


T = "(('0x' || substr(md5('7:' || doc_id || ':' || x[1]), 1, 8))::BIGINT % (x[1] + 1))"
DRAWS = f"""
    WITH n AS (SELECT count(*) AS n FROM benchmark),
    d AS (SELECT doc_id, list_reduce(list_transform(range(n - 4, n), lambda j: [j]),
            lambda a, x: list_append(a, CASE WHEN list_contains(a, {T}) THEN x[1] ELSE {T} END), CAST([] AS BIGINT[])) AS p FROM documents, n),
    pool AS (SELECT item_id, text, row_number() OVER (ORDER BY md5('7:' || item_id), item_id) - 1 AS pos FROM benchmark),
    s AS (SELECT doc_id, r, item_id, text FROM (SELECT doc_id, unnest(range(0, 4)) AS r, unnest(p) AS pos FROM d) JOIN pool USING (pos))
"""


@query("fewshot_sampling", DRAWS + "SELECT doc_id, r AS rank, item_id FROM s")
def fewshot_sampling(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id")
    out = fs.sample_per_doc(docs, pool(spark, sf_dir).select("item_id"), "doc_id", "item_id", 3, seed=7)
    return out.select("doc_id", F.col("rank").cast("long").alias("rank"), "item_id")


@query(
    "fewshot_attach",
    DRAWS
    + """
    , o AS (SELECT doc_id, array_to_string(list(item_id ORDER BY r)[1:3], ',') AS shots FROM s WHERE doc_id <> item_id GROUP BY doc_id)
    SELECT doc_id, coalesce(shots, '') AS shots FROM documents LEFT JOIN o USING (doc_id)
    """,
)
def fewshot_attach(spark, sf_dir):
    """Only ids travel through the sample; the shots' texts would be joined last."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id")
    samples = fs.sample_per_doc(docs, pool(spark, sf_dir).select("item_id"), "doc_id", "item_id", 3, seed=7)
    out = fs.attach(docs, samples, "doc_id", "item_id", 3, ["item_id"])
    return out.select("doc_id", F.array_join(F.transform("fewshot", lambda s: s["item_id"].cast("string")), ",").alias("shots"))


@query("fewshot_seeds", "SELECT item_id, unnest(range(0, 3)) AS seed FROM benchmark")
def fewshot_seeds(spark, sf_dir):
    return fs.seeds(pool(spark, sf_dir).select("item_id"), 3).withColumn("seed", F.col("seed").cast("long"))


@query(
    "fewshot_split_choice",
    """
    WITH s AS (SELECT DISTINCT p_brand || p_type AS dataset, ['test', 'auxiliary_train', 'dev', 'validation', 'other'][1 + p_size % 5] AS split FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN split LIKE '%train%' THEN 0 WHEN split LIKE '%dev%' THEN 1 WHEN split LIKE '%valid%' THEN 2 ELSE 3 END, split) AS rn FROM s WHERE split <> 'test')
    SELECT dataset, split AS fewshot_split FROM r WHERE rn = 1
    """,
)
def fewshot_split_choice(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("test", "auxiliary_train", "dev", "validation", "other")])
    splits = fx.table(spark, sf_dir, "part").select(
        F.concat("p_brand", "p_type").alias("dataset"), F.get(names, F.col("p_size") % 5).alias("split")
    )
    return fs.split_choice(splits, "dataset", "split", ["test"])


@query(
    "glue_fixed_fewshot",
    """
    WITH r AS (SELECT doc_id, lang, text || '=' || n_chars || ';' AS ex, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
    p AS (SELECT lang, string_agg(ex, '' ORDER BY doc_id) AS prefix FROM r WHERE rn <= 3 GROUP BY lang)
    SELECT doc_id, lang AS task, md5(prefix) AS prefix_hash FROM r JOIN p USING (lang) WHERE rn > 3
    """,
)
def glue_fixed_fewshot(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("task"), "text", "n_chars")
    example = F.concat("text", F.lit("="), F.col("n_chars").cast("string"), F.lit(";"))
    return fs.fixed_prefix(rows, "task", "doc_id", example, 3).select("doc_id", "task", F.md5("prefix").alias("prefix_hash"))
