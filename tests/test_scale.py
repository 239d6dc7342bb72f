"""Skewed keys and ties: totals stay exact and plans keep their shape."""

import numpy as np
from pyspark.sql import functions as F

from evalmill.operators import corpora as co
from evalmill.operators import docs as dc
from evalmill.operators import fewshot as fs
from evalmill.operators import positions as ps
from evalmill.operators import stats
from evalmill.operators import textpairs as tp


def test_positions_with_a_hot_value(spark):
    df = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 37 % 1000) / 10).alias("k"))
    out = ps.global_positions(df, "k", "id", ranges=16).orderBy("position").collect()
    assert [r.position for r in out] == list(range(9000))
    assert [(r.k, r.id) for r in out] == sorted((r.k, r.id) for r in out)


def test_hot_value_is_spread(spark):
    df = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") / 10).alias("k"))
    sizes = ps.range_buckets(df, "k", "id", 16).groupBy("_b", "_t").count().agg(F.max("count")).first()[0]
    assert sizes < 9000 / 8


def test_running_sum(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("n"))
    out = ps.global_running_sum(df, "id", "id", "n", ranges=8).orderBy("id").collect()
    total = 0
    for r in out:
        total += r.n
        assert r.running == total


def test_hashed_positions_are_a_permutation(spark):
    out = ps.hashed_positions(spark.range(3000).withColumn("g", F.col("id") % 2), 1, "id", ["g"]).groupBy("g").agg(
        F.countDistinct("position").alias("n"), F.max("position").alias("m")
    )
    assert {(r.n, r.m) for r in out.collect()} == {(1500, 1499)}


def test_dedup_keeps_first_of_hot_copies(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("t"))
    out = dc.dedup_docs(df, "id", ["t"])
    assert out.count() == 2001 and out.filter("t = 'same'").first()["id"] == 0


def test_pack_returns_the_stream(spark):
    rows = [(i, [f"{i}_{j}" for j in range(i % 5)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    flat = [t for _, ts in rows for t in ts]
    stream = co.token_budget(docs, "id", "tokens", len(flat)).withColumn("split", F.lit("all"))
    blocks = co.pack_blocks(stream, "split", "start", "tokens", 7).orderBy("block").collect()
    assert [t for b in blocks for t in b.tokens] == flat[: len(flat) // 7 * 7]


def test_draws_are_distinct_and_in_range(spark):
    out = spark.range(200).select(fs.draw_positions(F.col("id"), F.lit(9).cast("long"), 4).alias("p")).collect()
    assert all(len(set(r.p)) == 4 and max(r.p) < 9 and min(r.p) >= 0 for r in out)
    assert len({tuple(r.p) for r in out}) > 50


def test_bootstrap_is_close_to_the_formula(spark):
    df = spark.range(2000).select("id", F.lit("t").alias("task"), (F.col("id") % 2).cast("double").alias("x"))
    reps = stats.bootstrap_replicates(df, ["task"], "id", {"s": F.col("x")}, 200)
    se = stats.bootstrap_stderr(reps, ["task"], F.col("s") / F.col("weight")).first()["distribution_se"]
    assert abs(se - 0.5 / 2000**0.5) < 0.002


def test_best_choice_has_one_exchange(spark):
    from evalmill.operators.choices import best_choice

    df = spark.range(1000).select((F.col("id") % 50).alias("doc_id"), F.rand(1).alias("s"), (F.col("id") % 3 == 0).alias("is_gold"), "id")
    plan = best_choice(df, ["doc_id"], "s", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_ngram_rows_are_not_shuffled(spark):
    from evalmill.functions import ngrams as ng
    from evalmill.operators.textpairs import ngram_overlap

    df = spark.range(10).select("id", F.array(F.lit("a"), F.lit("b")).alias("g"), F.array(F.lit("a")).alias("p"))
    sides = {"gold": {1: ng.ngrams(F.col("g"), 1)}, "pred": {1: ng.ngrams(F.col("p"), 1)}}
    plan = ngram_overlap(df, ["id"], sides)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rouge_partitions_once(spark):
    from evalmill.plans import load_all

    plan = load_all()[0]["rouge_n"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_positions_with_text_keys_and_nulls(spark):
    """Keys of any orderable type; null keys come first and are cut by the tie key."""
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("doc-"), F.md5(F.col("id").cast("string")))).alias("k"))
    out = ps.global_positions(df, "k", "id").orderBy("position").collect()
    assert [r.position for r in out] == list(range(3000))
    want = sorted(((r.k is not None, r.k or "", r.id) for r in out))
    assert [(r.k is not None, r.k or "", r.id) for r in out] == want
    sizes = ps.range_buckets(df, "k", "id").groupBy("_b", "_t").count().agg(F.max("count")).first()[0]
    assert sizes < 300


def test_documents_without_shots_stay(spark):
    docs, pool = spark.range(3).withColumnRenamed("id", "doc"), spark.range(1).withColumnRenamed("id", "pool")
    out = fs.attach(docs, fs.sample_per_doc(docs, pool, "doc", "pool", 1), "doc", "pool", 1, ["pool"])
    assert {r.doc: [s.pool for s in r.fewshot] for r in out.collect()} == {0: [], 1: [0], 2: [0]}


def test_buckets_are_a_search_over_the_bounds(spark):
    for bounds in ([], [3.0], [1.0, 2.0], [0.0, 2.0, 5.0], [float(k) for k in range(0, 40, 2)]):
        rows = [r[0] for r in spark.createDataFrame([(float(k) / 2,) for k in range(-4, 100)] + [(None,)], "v double").select(ps._bucket(F.col("v"), bounds)).collect()]
        want = [2 * sum(b < k / 2 for b in bounds) + (k / 2 in bounds) for k in range(-4, 100)] + [-1]
        assert rows == want


def test_embedding_match_in_blocks_is_brute_force(spark):
    """Pairs of many blocks, a token alone, null and zero vectors, one side empty."""
    rng = np.random.default_rng(3)
    rows = []
    for pair, sizes in (("big", (70, 45)), ("small", (2, 3)), ("one side", (4, 0)), (None, (1, 1))):
        for side, n in enumerate(sizes):
            rows += [(pair, side, f"t{k}", [float(x) for x in rng.normal(size=5)], float(rng.integers(1, 4))) for k in range(n)]
    rows += [("big", 0, "zero", [0.0] * 5, 2.0), ("big", 1, "null", None, 9.0)]
    df = spark.createDataFrame(rows, "pair string, side int, token string, vector array<double>, weight double")
    out = tp.greedy_embedding_match(df, "pair", "side", "token", "vector", "weight", block=8)
    assert out.columns == ["pair", "precision", "recall", "f1"]
    got = {r.pair: (r.precision, r.recall, r.f1) for r in out.collect()}
    assert len(got) == 4 and got["one side"] == (0.0, 0.0, 0.0)
    for pair in ("big", "small", None):
        side = [[(np.array(v), w) for p, s, _, v, w in rows if p == pair and s == n and v is not None] for n in (0, 1)]
        unit = lambda v: v / np.linalg.norm(v) if v.any() else v
        best = [[(max(unit(v) @ unit(u) for u, _ in side[1 - n]), w) for v, w in side[n]] for n in (0, 1)]
        recall, precision = (sum(s * w for s, w in b) / sum(w for _, w in b) for b in best)
        np.testing.assert_allclose(got[pair], (precision, recall, 2 * precision * recall / (precision + recall)), atol=1e-12)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
