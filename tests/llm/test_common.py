"""Components, id filters and folds."""

import random
import zlib

import numpy as np

from evalmill.llm.common import components, held_out, id_filter, is_held_out, may_hold
from pyspark.sql import functions as F

from .helpers import components_of


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(7, 7), (2, 1), (1, 2)]
    edges += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    real = [e for e in edges if e[0] != e[1]]
    assert {r.id: r.component for r in got} == components_of({n for e in real for n in e}, real)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_id_filter_never_misses(spark):
    ids = spark.range(0, 30000, 7)
    marks = id_filter(ids)
    assert may_hold(marks, np.arange(0, 30000, 7)).all()
    assert may_hold(marks, np.arange(10**6, 2 * 10**6)).mean() < 0.01


def test_folds(spark):
    got = spark.range(300).select("id", held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 3 == 1) == is_held_out(r.id) for r in got)
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(held_out(F.col("id"))).first()[0] is False
