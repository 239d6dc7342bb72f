"""Steps whose cost must follow the input: exact against brute force, dealt out to all tasks."""

import hashlib
import os

import numpy as np
from pyspark.sql import functions as F

from evalmill.functions import checks as ck
from evalmill.functions import ngrams as ng
from evalmill.functions import prompts as pm
from evalmill.functions import sequences as sq
from evalmill.functions import text as tx
from evalmill.operators import corpora as co
from evalmill.operators import instructions as ins
from evalmill.operators import stats
from evalmill.operators import textpairs as tp
from evalmill.plans import checks, documents, io
from evalmill.sources import readers as rd


def brute_draws(identity, size, samples):
    out = []
    for r in range(samples):
        digests = [hashlib.md5(b":".join(x for x in (identity, b"%d" % r, b"%d" % (k // 4)) if x is not None)).hexdigest() for k in range(size)]
        out.append([int(h[8 * (k % 4) : 8 * (k % 4) + 8], 16) % size for k, h in enumerate(digests)])
    return out


def test_draws_are_those_of_md5():
    ids = [b"7", b"8", b"12345", None, b"", b"x" * 40, b"x" * 90, "ü→".encode()] * 3
    for size in (2, 3, 5):
        for identity, got in zip(ids, sq.draws(ids, [size] * len(ids), 120)):
            assert got.tolist() == brute_draws(identity, size, 120)


def test_bootstrap_mid_of_samples_dealt_to_all_tasks(spark):
    rows = [(str(i), [0.1 * (i % 7), 0.5, 0.3 + i], [1.0, 0.0, 0.25]) for i in range(40)] + [("one", [0.5], [0.25]), ("none", [], []), ("gap", None, None)]
    df = spark.createDataFrame(rows, "id string, a array<double>, b array<double>").coalesce(1)
    got = {r.id: r.m for r in df.select("id", tp.bootstrap_mid({"x": F.col("a"), "y": F.col("b")}, F.col("id"), 100).alias("m")).collect()}
    for i, a, b in rows[:40]:
        drawn = brute_draws(i.encode(), 3, 100)
        assert tuple(got[i]) == tuple(float(np.median([(v[p] + v[q] + v[s]) / 3 for p, q, s in drawn])) for v in (a, b))
    assert tuple(got["one"]) == (0.5, 0.25) and got["none"] is None and got["gap"] is None
    texts = spark.range(100, numPartitions=1).select("id", F.array(F.lit("a b")).alias("g"), F.array(F.lit("a c")).alias("p"))
    assert tp.rouge_t5(texts, F.col("id"), F.col("g"), F.col("p")).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_repeated_and_null_keys_add_up(spark):
    """Rows of one key are one pair; a null side leaves its row out; single rows are counted without a row for each gram."""
    rows = [(1, "a b a", "a a b"), (2, "x y", "y"), (2, "y y x y", "x y q"), (None, "k", "k l"), (None, "k", "m"), (3, None, "a"), (4, "", "z"), (5, "a", "b")]
    df = spark.createDataFrame(rows, "id long, g string, p string").select("id", *[F.filter(F.split(c, " "), lambda w: w != "").alias(c) for c in "gp"])
    spec = lambda c: [(F.col(c), " ", {1: 1, 2: 2})]
    out = tp.ngram_overlap(df, ["id"], {"gold": spec("g"), "pred": spec("p")})
    got = {(r.id, r.n): (r.match, r.n_gold, r.n_pred) for r in out.collect()}
    assert got == {
        (1, 1): (3, 3, 3), (1, 2): (1, 2, 2), (2, 1): (3, 6, 4), (2, 2): (1, 4, 2), (None, 1): (1, 2, 3), (None, 2): (0, 0, 1),
        (4, 1): (0, 0, 1), (5, 1): (0, 1, 1),
    }
    multi = tp.multi_gold_overlap(df.filter("id < 3"), ["id"], [F.col("g"), F.col("p")], F.col("p"), (1,))
    assert {(r.id, r.match, r.n_pred) for r in multi.collect()} == {(1, 3, 3), (2, 4, 4)}
    counted = tp.ngram_overlap(df, ["id"], {"gold": spec("g"), "pred": spec("p")})._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in counted and counted.count("Exchange hashpartitioning") == 1


def test_strip_takes_what_the_pattern_takes(spark):
    """Every character of (?U)\\s and no other is trimmed, by a trim and no longer by a pattern that scans the whole text."""
    chars = spark.range(0xFFFF).filter("id < 55296 OR id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    t = F.concat("c", F.lit("a"), "c", F.lit("b"), "c", "c")
    pairs = [(tx.strip(t), r"(?U)^\s+|\s+\z"), (tx.rstrip(t), r"(?U)\s+\z"), (tx.lstrip(t), r"(?U)^\s+")]
    assert chars.filter(~F.forall(F.array(*[new == F.regexp_replace(t, old, "") for new, old in pairs]), lambda ok: ok)).count() == 0
    assert "regexp_replace" not in str(tx.strip(F.col("c")))


def test_responses_are_dealt_to_all_tasks(spark):
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert checks.responses(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == tasks


def test_task_json_objects_share_files(spark, tmp_path):
    """Objects on lines of a few files are read split; a file that is one object is read whole."""
    (tmp_path / "a.json").write_text('{"t": [{"q": "x\\ny"}, {"q": null}],\n "u": []}\n')
    (tmp_path / "b.jsonl").write_text('{"t": [{"q": "x\\ny"}]}\n{"u": [{"q": "1"}, {"q": "2"}], "t": [{"q": "3"}]}\n')
    rows = lambda name, **how: sorted((r.task, r.row_ix, r.record["q"] or "") for r in rd.load_task_json(spark, f"{tmp_path}/{name}", **how).collect())
    assert rows("a.json") == [("t", 0, "x\ny"), ("t", 1, "")]
    assert rows("b.jsonl", lines=True) == [("t", 0, "3"), ("t", 0, "x\ny"), ("u", 0, "1"), ("u", 1, "2")]
    files = io.load_task_json(spark, "/root/testdata/sf0.001").inputFiles()
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_common_prefix_is_found_once_a_row(spark):
    """Every text against a plain version, nulls included; the query's plan holds the comparison once and deals its rows."""
    texts = [["the cat a", "the cat b"], ["same", "same"], ["a b", "a bc", "a"], ["", "x"], ["ü→ x", "ü→ y"], ["the  a", "the  ab c"], [" x", " y"], ["one two three"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, ["a b", None], [None, "a b"], None])], "id int, c array<string>")
    got = {r.id: (r.p.question, r.p.choices) for r in df.select("id", pm.without_common_prefix(F.col("c")).alias("p")).collect()}
    for i, t in enumerate(texts):
        cut = os.path.commonprefix(t)
        cut = cut[: cut.rindex(" ")] if " " in cut else ""
        assert got[i] == (cut, [x[len(cut) :] for x in t])
    assert [got[len(texts) + k] for k in range(3)] == [("", ["a b", None]), ("", [None, "a b"]), ("", None)]
    gap = {r.s: r.g for r in spark.createDataFrame([("a _b",), ("_b",), ("a",), ("a_b_c",), (None,)], "s string").select("s", pm.cloze(F.col("s"), F.array(F.lit("x"))).alias("g")).collect()}
    assert tuple(gap["a _b"]) == ("a ", ["x b"]) and [gap[k] for k in ("_b", "a", "a_b_c", None)] == [None] * 4
    out = documents.adapt_mcq_rows(spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("forall(") == 1
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bootstrap_draws_are_those_of_md5(spark):
    """Weights and sums by brute force: long, null and repeated identities, null keys and values, whole numbers; draws are made in numpy."""
    rows = [(f"{i}" if i % 5 else "ü→" * (i % 30), "a" if i % 3 else None, (i % 7) / 4, i) for i in range(90)]
    rows += [("1", "a", None, None), (None, "a", 2.0, 3), (None, "lost", 1.0, 1), ("7", "blank", None, None)]
    df = spark.createDataFrame(rows, "id string, k string, x double, n long")
    out = stats.bootstrap_replicates(df, ["k"], "id", {"x": F.col("x"), "n": F.col("n")}, 21)
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "int", "bigint", "double", "bigint"]
    got = {(r.k, r.replicate): (r.weight, r.x, r.n) for r in out.collect()}
    assert len(got) == 4 * 21 and got["lost", 3] == (None, None, None) and got["blank", 3][1:] == (None, None)
    for k in ("a", None):
        for r in range(21):
            want = [0, 0.0, 0]
            for i, key, x, n in rows:
                if key == k and i is not None:
                    u = int(hashlib.md5(f"{r // 8}:{i}".encode()).hexdigest()[4 * (r % 8) :][:4], 16)
                    w = sum(u >= s for s in stats.POISSON1_STEPS)
                    want = [want[0] + w, want[1] + w * (x or 0), want[2] + w * (n or 0)]
            assert got[k, r] == tuple(want)
    assert stats.bootstrap_replicates(df, [], "id", {"x": F.col("x")}, 9).count() == 9
    assert stats.bootstrap_replicates(df.limit(0), ["k"], "id", {"x": F.col("x")}, 9).count() == 0
    assert "Generate explode" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_sweep_grid_is_dealt_out(spark):
    """Kept layers by brute force, sizes below the cut and null ones included; no lambda walks over the layers."""
    sizes = [0, 1, 2, 3, 4, 9, None, -2]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id int, n int").coalesce(1)
    out = co.sweep_grid(df, "n", 3)
    want = [(i, s, [*range(s), *range(s + 3, n)]) for i, n in enumerate(sizes) if n is not None for s in range(n - 2)]
    assert sorted(map(tuple, out.collect())) == [(i, sizes[i], s, kept) for i, s, kept in want]
    wide = co.sweep_grid(df.withColumn("n", F.col("n").cast("long")), "n", 3)
    assert sorted((r.id, r.start, r.kept) for r in wide.collect()) == want and wide.schema["kept"].dataType.simpleString() == "array<bigint>"
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_responses_are_graded_once(spark):
    """Flags by hand, rows with null and unknown ids included; grading shuffles nothing and stands in the plan of a report once."""
    ids = ["punctuation:no_comma", "change_case:english_lowercase"]
    rows = [("a", "x, y\nz"), ("a", "x, y\nz"), ("b", "all small"), ("c", "Up, and"), ("d", " "), ("e", None), (None, "Top\nlow*er\nend, all")]
    none = F.create_map(F.lit("_"), F.lit(""))
    asked = F.array(*[F.struct(F.lit(i).cast("string").alias("instruction_id"), none.alias("kwargs")) for i in [*ids, "no:such", None]])
    df = spark.createDataFrame(rows, "r string, t string").withColumn("i", asked)
    out = ins.grade(df, "r", "t", "t", "i", ids)
    key = lambda x: str(x)
    want = [("a", 0, False, True), ("a", 1, True, True)] * 2 + [("b", 0, True, True), ("b", 1, True, True), ("c", 0, False, False), ("c", 1, False, False)]
    want += [(r, i, False, False) for r in "de" for i in (0, 1)] + [(None, 0, False, True), (None, 1, False, True)]
    want = [(r, p, ids[p], s, l) for r, p, s, l in want] + [(r, p, [None, "no:such"][p == 2], False, False) for r, _ in rows for p in (2, 3)]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    report = ins.report_by_type(out)
    assert report._jdf.queryExecution().optimizedPlan().toString().count("posexplode(") == 1
    seen = spark.createDataFrame([("f:a", True, True), ("f:b", False, True), ("all", True, True), (None, False, False)], "instruction_id string, strict boolean, loose boolean")
    got = sorted(map(tuple, ins.report_by_type(seen).collect()), key=key)
    want = [("f", "f:a", 1.0, 1.0, 1), ("f", "f:b", 0.0, 1.0, 1), ("f", "all", 0.5, 1.0, 2), ("all", "all", 1.0, 1.0, 1), ("all", "all", 1.0, 1.0, 1), (None, None, 0.0, 0.0, 1), (None, "all", 0.0, 0.0, 1)]
    assert got == sorted(want, key=key)


def test_cheap_forms_of_checks_are_exact(spark):
    """Sentences, words, trigrams and names by the plain rules, on texts made of marks that these treat apart."""
    bits = [*"...!?\"'”“ \n\t,*aBc1", "Mr. ", "Dr.", " Inc. He ", "Co. ", "Ph.D. ", "U.S.A. But ", "a.b.c.", " i. ", ".com", "1.2.3", '."', '?"', ".”", "<stop>", "<prd>", "\xa0", "\x1c", "\x85", "é", "😀", "日", "Emma", "Liam "]
    draw = lambda i: hashlib.md5(str(i).encode()).digest()
    texts = ["".join(bits[b % len(bits)] for b in draw(i)[: 1 + i % 16] + draw(-i)[: i % 16]) for i in range(3000)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    cut = F.concat(F.lit(" "), t, F.lit("  "))
    for pattern, new in ck.SENTENCE_RULES:
        cut = F.regexp_replace(cut, pattern, new)
    parts = F.transform(F.split(cut, "<stop>", -1), tx.strip)
    parts = F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    pairs = [
        (ck.sentences(t), parts),
        (ck.words(t), tx.words(t)),
        (ck.remove_punct(t), tx.remove_punct(t)),
        (F.array_sort(ck.char_trigrams(t)), F.array_sort(F.array_distinct(ng.char_ngrams(t, 3)))),
        (ck.person_names(t, ck.Args(F.create_map(F.lit("n"), F.lit("2"))), t), F.size(F.filter(ck.lits(ck.PERSON_NAMES), lambda n: F.contains(t, n))) >= 2),
    ]
    rows = df.select("t", *[F.struct(a.alias("new"), b.alias("plain")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).collect()
    assert [(r.t, i) for r in rows for i in range(len(pairs)) if r.t is not None and r[i + 1].new != r[i + 1].plain] == []
    assert not any(a in b for a in ck.PERSON_NAMES for b in ck.PERSON_NAMES if a != b)
    plain = "Just one. And two. " * 50
    assert spark.createDataFrame([(plain,)], "t string").filter(t.rlike(ck.UNUSUAL)).count() == 0


def test_neighbours_are_read_up_to_the_first_that_fail(one):
    """Facts behind neighbours that fail are not found: the last one here is an error."""
    fact = lambda x: F.when(x < 9, x).otherwise(F.raise_error(F.lit("read on")).cast("int"))
    grow = lambda *v: ck.neighbours_hold(F.array(*map(F.lit, v)), fact, "int", lambda a, b: b > a)
    assert one(grow(1, 2, 3), grow(2, 1, 9), grow(4), grow(1, 1), grow(1, 3, 3, 9)) == (True, False, True, False, False)
    assert one(ck.neighbours_hold(F.array().cast("array<int>"), fact, "int", lambda a, b: b > a)) is True
