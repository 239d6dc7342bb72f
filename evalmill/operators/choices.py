"""Choice metrics from one row per (document, choice).

All of these are algebraic aggregates: map-side partial results are one row per
document, so a document (or task) holding a third of the rows is combined
before the shuffle and no group is ever collected.
"""

from pyspark.sql import functions as F


def best_choice(choices, doc_keys, score, tie_keys, gold="is_gold"):
    """Per document: acc of the best choice, number of choices and of golds.

    The best choice is the highest score; ``tie_keys`` break ties upwards.
    """
    order = F.struct((-F.col(score)).alias("neg"), *tie_keys, F.col(gold).alias("hit"))
    return choices.groupBy(*doc_keys).agg(
        F.min(order)["hit"].cast("double").alias("acc"),
        F.count("*").alias("n"),
        F.count_if(F.col(gold)).alias("n_gold"),
    )


def probability_mass(choices, doc_keys, score, gold="is_gold"):
    """Per document: exp(score) of the best gold over the sum of exp(score)."""
    p = F.exp(F.col(score))
    docs = choices.groupBy(*doc_keys).agg(F.max(F.when(F.col(gold), p)).alias("best"), F.sum(p).alias("total"))
    share = F.when(F.col("total") != 0, F.coalesce("best", F.lit(0.0)) / F.col("total")).otherwise(F.lit(0.0))
    return docs.withColumn("prob", share)
