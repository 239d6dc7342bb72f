"""The scoring job: names, options, shared columns, one pass."""

import pytest
from pyspark.sql import functions as F

from evalmill.operators import textpairs as tp
from evalmill.operators.extension import MetricSpec
from evalmill.operators.scoring import BUILT_IN, assigned, named, score

ROWS = [
    ("a", [-1.0, -2.0], [0], ["Yes"], ["yes"]), ("a", [-3.0, -1.0], [0], ["No"], ["No"]),
    ("b", [-1.0, -1.0], [1], ["x y"], ["y"]), ("b", None, None, ["x"], ["x"]), ("c", [-0.5, -4.0], [0], None, None),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "task string, logprobs array<double>, golds array<int>, gold_texts array<string>, pred_texts array<string>")


def got(df):
    return {(r.task, r.metric): (r.value, r.n) for r in df.collect()}


def test_values_and_counts(rows):
    have = got(score(rows, ["loglik_acc", "exact_match:norm=lower", "bow_f1", "recall:k=2"]))
    assert have["a", "loglik_acc"] == (0.5, 2) and have["b", "loglik_acc"] == (0.0, 1) and have["c", "loglik_acc"] == (1.0, 1)
    assert have["all", "loglik_acc"] == (0.5, 4)  # the mean of the tasks, the sum of the counts
    assert have["a", "exact_match:norm=lower"] == (1.0, 2) and ("c", "exact_match:norm=lower") not in have
    assert have["b", "bow_f1"] == (pytest.approx(5 / 6), 2) and have["all", "recall:k=2"] == (1.0, 4)


def test_metrics_by_task(rows):
    have = got(score(rows, {"a": ["loglik_acc"], "b": ["bow_f1"], "*": ["mrr"]}))
    assert {k for k in have if k[1] == "loglik_acc"} == {("a", "loglik_acc"), ("all", "loglik_acc")}
    assert {t for t, m in have if m == "bow_f1"} == {"b", "all"} and {t for t, m in have if m == "mrr"} == {"a", "b", "c", "all"}
    assert assigned({"*": ["x"], "a": ["x", "y"]}) == [("x", None), ("y", ["a"])]


def test_own_metric_beside_built_in_ones(rows):
    longest = MetricSpec("longest", lambda: F.length(F.get("pred_texts", F.lit(0))), corpus=F.max, higher_is_better=False)
    have = {(r.task, r.metric): (r.value, r.stderr, r.higher_is_better) for r in score(rows, [longest, "exact_match"]).collect()}
    assert have["a", "longest"] == (3.0, None, False) and have["a", "exact_match"] == (0.5, 0.5, True)


def test_mistakes_are_named(rows):
    for metrics, part in ((["accuracy"], "loglik_acc"), (["recall:n=2"], "recall:n=2"), (["mrr:norm=none"], "mrr:norm=none"), (["perplexity"], "token_counts")):
        with pytest.raises(ValueError, match=part):
            score(rows, metrics)


def test_every_name_plans(spark):
    for name in BUILT_IN:
        assert named(name).name == name


def test_one_scan_and_shared_columns(spark, tmp_path):
    """Samples are scanned and shuffled once; a normaliser is applied once for all its metrics."""
    path = str(tmp_path / "rows")
    spark.createDataFrame(ROWS, "task string, logprobs array<double>, golds array<int>, gold_texts array<string>, pred_texts array<string>").write.parquet(path)
    metrics = ["loglik_acc", "mrr", "mc_prob", "exact_match:norm=helm", "bow_f1:norm=helm", "exact_match:norm=helm&mode=prefix"]
    plan = score(spark.read.parquet(path), metrics)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning(task") == 1
    assert sorted(named("bow_f1:norm=helm").derived) == sorted(named("exact_match:norm=helm").derived) == ["_gold_texts_helm", "_pred_texts_helm"]
    logical = score(spark.read.parquet(path), metrics)._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("AS _gold_texts_helm") == 1


def test_rouge_t5_of_one_and_of_many_pairs(spark):
    """One pair gives its own scores; many the median of resampled means; lines count in the last score only."""
    rows = [
        (1, ["the cat sat"], ["The cat, sat!"]),
        (2, ["one two . three four"], ["three four . one two"]),
        (3, ["a b", "a b", "a b", "a b", "a b", "a b"], ["a b", "x", "a b", "x", "a b", "x"]),
        (4, ["a b", "unpaired"], ["b"]),
        (5, [""], ["a"]),
        (6, [], ["a"]),
        (7, None, ["a"]),
        (8, [None], ["a"]),
    ]
    df = spark.createDataFrame(rows, "id long, g array<string>, p array<string>")
    got = {r.id: (r.rouge1, r.rouge2, r.rougeL, r.rougeLsum) for r in tp.rouge_t5(df, F.col("id"), F.col("g"), F.col("p")).collect()}
    assert got[1] == (100.0, 100.0, 100.0, 100.0)
    assert got[2][0] == 100.0 and round(got[2][1], 6) == round(100 * 2 / 3, 6) and got[2][2] == 50.0 and got[2][3] == 100.0
    assert all(40 <= x <= 60 for x in got[3])
    assert [round(x, 6) for x in got[4]] == [round(200 / 3, 6), 0.0, round(200 / 3, 6), round(200 / 3, 6)]
    assert got[5] == got[8] == (0.0, 0.0, 0.0, 0.0) and got[6] == got[7] == (None, None, None, None)
