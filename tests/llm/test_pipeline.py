"""The pipeline on a small table: each stage's decisions take effect."""

import hashlib
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed eiusmod tempor magna aliqua enim".split()) + str(rng.randrange(40)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))
    item = say(30)
    rows, labels = [], []
    for i in range(500):
        text = say(rng.randrange(30, 80)) + (f" mail w{i}@home.example now" if i % 7 == 1 else "")
        bad = i % 5 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text))
        labels.append((i, int(not bad), 0))
    rows += [(600, rows[1][1] + " x"), (601, rows[2][1]), (602, say(20) + " " + item + " " + say(20)), (603, say(30) + " mail me@home.example now")]
    write(spark, path, "documents", [(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, path, "labels", labels, "doc_id long, quality int, toxic int")
    write(spark, path, "benchmark", [(1, item)], "item_id long, text string")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, folder), name)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "tokens":
            assert docs.columns == columns
        if name == "personal_data":
            rows = docs.collect()
            assert any("[EMAIL]" in r.text for r in rows) and all("@" not in r.text and r.n_chars == len(r.text) for r in rows)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert all(kept[b] <= kept[a] for a, b in zip(names, names[1:], strict=False))
    good = {i for i in range(500) if i % 5}
    assert len(kept["quality"] & good) > 360 and not any(i % 5 == 0 for i in kept["quality"] if i < 500)
    near = {600: 1, 601: 2}
    gone = {i for i, first in near.items() if {i, first} <= kept["quality"]}
    assert kept["near_duplicates"] == kept["quality"] - gone
    assert kept["decontamination"] == kept["near_duplicates"] - {602}
    assert kept["personal_data"] == kept["decontamination"] == kept["tokens"]


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len(rows) > 360 and {tuple(sorted(r.asDict())) for r in rows} == {("decoded_sha256", "doc_id", "ids_sha256", "n_tokens")}
    assert all(r.n_tokens > 0 and r.ids_sha256 != hashlib.sha256(b"").hexdigest() for r in rows)
