"""The quality classifier: held-out accuracy, prior, odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from evalmill.llm.common import is_held_out
from evalmill.llm.pu_quality import MEASURES, good_documents, quality_scores

from .helpers import no_documents, odd_documents

LABELS = "doc_id long, quality int, toxic int"


def web(spark, n=1500):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("lorem ipsum dolor sit amet consectetur elit sed eiusmod tempor".split()) + rng.choice(["", "", ","]) for _ in range(rng.randrange(20, 120))]
        good = rng.random() < 0.75
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [words[0]] * len(words)
        rows.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy_from_positives_only(spark):
    docs, labels = web(spark)
    rows = quality_scores(docs, labels).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == is_held_out(r.doc_id) and r.predicted == (r.score >= 0.5) for r in rows)
    assert len(out) > 100 and np.mean([r.predicted == r.quality for r in out]) > 0.95
    # negative labels and labels of the test fold change nothing
    again = labels.filter((F.col("quality") == 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    assert {(r.doc_id, r.score) for r in quality_scores(docs, again).collect()} == {(r.doc_id, r.score) for r in quality_scores(docs, labels).collect()}


def test_odd_rows(spark):
    df = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 1, 0), (6, 0, 0), (None, 1, 0), (10, None, 0), (99, 1, 0)], LABELS).withColumn("x", F.lit(1))
    rows = quality_scores(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    kept = good_documents(df, labels)
    assert kept.columns == df.columns and kept.filter("doc_id is null").count() == 2


def test_nothing_to_learn_from(spark):
    labels = spark.createDataFrame([], LABELS)
    assert quality_scores(no_documents(spark), labels).count() == 0
    assert {r.score for r in quality_scores(odd_documents(spark), labels).collect()} == {0.5}
    assert MEASURES > 20
