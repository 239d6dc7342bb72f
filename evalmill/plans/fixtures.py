"""Fixture views: the evaluation tables derived from the star-schema data.

Each function builds with the DataFrame API what ``registry.view`` states in
SQL for the oracle. Literals are cast to double and every tie has a key.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalmill.plans.registry import view


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- one row per (document, choice) ----------------------------------------

view(
    "choice_scores",
    """
    SELECT 'prio:' || o_orderpriority AS task, l_orderkey AS doc_id,
           -l_extendedprice / 10000 AS logprob, l_quantity AS n_chars,
           l_returnflag = 'R' AS is_gold,
           l_linenumber, l_partkey, l_suppkey, l_shipdate
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)


def choice_scores(spark, sf_dir):
    """Lines of an order as scored choices; gold where the return flag is R."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        (-F.col("l_extendedprice") / 10000).alias("logprob"),
        F.col("l_quantity").alias("n_chars"),
        (F.col("l_returnflag") == "R").alias("is_gold"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("prio:"), "o_orderpriority").alias("task")
    )
    return lines.join(orders, "doc_id")


# --- one row per document, arrays of choice scores --------------------------

view(
    "mcq",
    """
    SELECT vec_id AS doc_id, 'task:' || (label % 3) AS task, n,
           list_transform(range(0, n), lambda i: floor(CAST(embedding[i + 1] AS DOUBLE) * 20) / 10 - 2) AS logprobs,
           list_transform(range(0, n), lambda i: floor(CAST(embedding[n + i + 1] AS DOUBLE) * 20) / 10 - 2) AS uncond,
           list_transform(range(0, n), lambda i: CASE WHEN i % 2 = 0 THEN ' ' ELSE 'x' END || repeat('c', CAST((i * 7 + vec_id) % 11 AS INT))) AS choices,
           list_transform(range(0, n), lambda i: 1 + (i * 3 + vec_id) % 5) AS token_counts,
           list_sort(list_distinct([label % n, (label + vec_id) % n])) AS golds
    FROM (SELECT *, 4 + vec_id % 5 AS n FROM embeddings)
    """,
)


def mcq(spark, sf_dir):
    """Embedding rows as responses: 4 to 8 choices with coarse scores (so ties occur)."""
    n = F.col("n")
    ids = F.sequence(F.lit(0), n - 1)

    def scores(offset):
        return F.transform(
            ids, lambda i: F.floor(F.get(F.col("embedding"), i + offset).cast("double") * 20) / 10 - 2
        )

    return (
        table(spark, sf_dir, "embeddings")
        .withColumn("n", (4 + F.col("vec_id") % 5).cast("int"))
        .select(
            F.col("vec_id").alias("doc_id"),
            F.concat(F.lit("task:"), (F.col("label") % 3).cast("string")).alias("task"),
            "n",
            scores(F.lit(0)).alias("logprobs"),
            scores(n).alias("uncond"),
            F.transform(
                ids,
                lambda i: F.concat(
                    F.when(i % 2 == 0, " ").otherwise("x"),
                    F.repeat(F.lit("c"), ((i * 7 + F.col("vec_id")) % 11).cast("int")),
                ),
            ).alias("choices"),
            F.transform(ids, lambda i: (1 + (i * 3 + F.col("vec_id")) % 5).cast("int")).alias("token_counts"),
            F.array_sort(
                F.array_distinct(
                    F.array(
                        (F.col("label") % n).cast("int"), ((F.col("label") + F.col("vec_id")) % n).cast("int")
                    )
                )
            ).alias("golds"),
        )
    )


# --- several generations per document ---------------------------------------

view(
    "generations",
    """
    SELECT 'users:' || (user_id % 4) AS task, user_id AS doc_id, pos, answer,
           ['click', 'error', 'signup', 'purchase', 'view'][1 + user_id % 5] AS gold
    FROM (SELECT user_id, event_type AS answer,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
          FROM events)
    """,
)


def generations(spark, sf_dir):
    """All events of a user as sampled answers, numbered in time order."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    types = F.array(*[F.lit(x) for x in ("click", "error", "signup", "purchase", "view")])
    return (
        table(spark, sf_dir, "events")
        .select("user_id", "event_type", F.row_number().over(w).alias("rn"))
        .select(
            F.concat(F.lit("users:"), (F.col("user_id") % 4).cast("string")).alias("task"),
            F.col("user_id").alias("doc_id"),
            (F.col("rn") - 1).cast("long").alias("pos"),
            F.col("event_type").alias("answer"),
            F.get(types, (F.col("user_id") % 5).cast("int")).alias("gold"),
        )
    )


# --- short gold / prediction strings ----------------------------------------

view(
    "string_pairs",
    """
    SELECT p_partkey AS doc_id, 'kind:' || lower(p_type) AS task, p_name AS gold,
           CASE p_partkey % 4
             WHEN 0 THEN upper(p_name) || '.'
             WHEN 1 THEN p_name
             WHEN 2 THEN 'the ' || split_part(p_name, ' ', 2) || ' (' || p_size || '.0) ' || lower(p_type)
             ELSE ' ' || p_name || ' - ' || p_retailprice || ' ' END AS pred
    FROM part
    """,
)


def string_pairs(spark, sf_dir):
    """Part names as golds, perturbed names as predictions."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"),
        F.concat(F.lit("kind:"), F.lower("p_type")).alias("task"),
        name.alias("gold"),
        F.when(k == 0, F.concat(F.upper(name), F.lit(".")))
        .when(k == 1, name)
        .when(
            k == 2,
            F.concat(
                F.lit("the "), F.split_part(name, F.lit(" "), F.lit(2)), F.lit(" ("), size, F.lit(".0) "), F.lower("p_type")
            ),
        )
        .otherwise(F.concat(F.lit(" "), name, F.lit(" - "), F.col("p_retailprice").cast("string"), F.lit(" ")))
        .alias("pred"),
    )


# --- classification, perplexity, judge --------------------------------------

view(
    "class_labels",
    """
    SELECT doc_id, 'mod:' || (doc_id % 3) AS task, quality AS gold, 1 - toxic AS pred FROM labels
    """,
)


def class_labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.concat(F.lit("mod:"), (F.col("doc_id") % 3).cast("string")).alias("task"),
        F.col("quality").alias("gold"),
        (1 - F.col("toxic")).alias("pred"),
    )


view(
    "event_classes",
    """
    SELECT event_id AS doc_id, 'users:' || (user_id % 4) AS task, event_type AS gold,
           CASE WHEN event_id % 3 = 0 THEN event_type
                ELSE ['click', 'error', 'signup', 'purchase', 'view'][CAST(1 + floor(value) % 5 AS INT)] END AS pred
    FROM events
    """,
)


def event_classes(spark, sf_dir):
    """Five-class predictions, right for at least a third of the rows."""
    types = F.array(*[F.lit(x) for x in ("click", "error", "signup", "purchase", "view")])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"),
        F.concat(F.lit("users:"), (F.col("user_id") % 4).cast("string")).alias("task"),
        F.col("event_type").alias("gold"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
        .otherwise(F.get(types, (F.floor("value") % 5).cast("int")))
        .alias("pred"),
    )


view(
    "ppl_docs",
    """
    SELECT doc_id, lang AS task, text, -n_chars * (1 + doc_id % 7) / 10.0::DOUBLE AS logprob FROM documents
    """,
)


def ppl_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("task"),
        "text",
        (-F.col("n_chars") * (1 + F.col("doc_id") % 7) / 10.0).alias("logprob"),
    )


view(
    "confidences",
    """
    SELECT event_id AS doc_id, event_type AS task, value / 5 AS confidence,
           CASE WHEN event_id % 3 = 0 OR value > 60 THEN 1 ELSE 0 END AS correct
    FROM events
    """,
)


def confidences(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"),
        F.col("event_type").alias("task"),
        (F.col("value") / 5).alias("confidence"),
        ((F.col("event_id") % 3 == 0) | (F.col("value") > 60)).cast("int").alias("correct"),
    )


# --- long text pairs ---------------------------------------------------------

view(
    "text_pairs",
    """
    SELECT d.doc_id, d.lang AS task, d.text AS source, b.text AS summary
    FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id
    """,
)


def text_pairs(spark, sf_dir):
    """Documents as sources, benchmark passages as summaries."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    n = items.count()
    return docs.join(items.withColumnRenamed("text", "summary"), F.col("doc_id") % n == F.col("item_id")).select(
        "doc_id", F.col("lang").alias("task"), F.col("text").alias("source"), "summary"
    )
