"""Few-shot selection.

Random draws are hash order, so they are the same on every run and engine.
Nothing pairs every document with every pool row: a document draws positions
and joins the pool on the position.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalmill.operators.boards import top_per_task
from evalmill.operators.positions import hashed_positions


def _hash(seed, *cols):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def sequential(pool, index, num_fewshot, seed=0):
    """First rows of the pool, rotated by ``num_fewshot * seed``; one spare row."""
    size = pool.agg(F.count("*")).scalar()
    turned = pool.withColumn("rank", F.pmod(F.col(index) - num_fewshot * seed, size))
    return turned.orderBy("rank").limit(num_fewshot + 1)


def shuffled(pool, index, num_fewshot, seed=0):
    """Pool order for seed 0, hash order otherwise; one spare row."""
    key = F.col(index) if seed == 0 else _hash(seed, F.col(index))
    return pool.orderBy(key, index).limit(num_fewshot + 1)


def balanced(pool, index, cls, num_fewshot, seed=0):
    """One draw per class in turn, large classes first, without replacement; one spare row.

    Only ``num_fewshot + 1`` rows of a class can be drawn, so the rank filter
    keeps that many per class below the shuffle.
    """
    n = num_fewshot + 1
    sizes = pool.groupBy(cls).agg(F.count("*").alias("_size"))
    draws = top_per_task(pool.withColumn("_h", _hash(seed, F.col(index))), cls, ["_h", index], n)
    ranked = draws.join(sizes, cls)
    ranked = ranked.withColumn("_turn", F.row_number().over(W.partitionBy(cls).orderBy("_h", index)))
    order = ["_turn", F.desc("_size"), _hash(seed, F.col(cls)), cls]
    return ranked.orderBy(*order).limit(n).drop("_h", "_size")


def draw_positions(identity, size, n, seed=0):
    """``n`` distinct positions below ``size``, uniform, from the hash of the identity.

    For j = size-n .. size-1 a hash picks 0..j; a position already taken is
    replaced by j itself.
    """
    first = F.greatest(size - n, F.lit(0))
    steps = F.when(size > 0, F.sequence(first, size - 1)).otherwise(F.array().cast("array<bigint>"))

    def add(taken, j):
        h = F.conv(F.substring(_hash(seed, identity, j), 1, 8), 16, 10).cast("bigint")
        pick = h % (j + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, pick), j).otherwise(pick)))

    return F.aggregate(steps, F.array().cast("array<bigint>"), add)


def sample_per_doc(docs, pool, doc_id, pool_id, num_fewshot, unique_pool=False, seed=0):
    """Per document a sample of the pool: ``num_fewshot`` rows, one more when it may hold the document.

    Columns: the document id, ``rank`` and the pool columns.
    """
    n = num_fewshot if unique_pool else num_fewshot + 1
    numbered = hashed_positions(pool, seed, pool_id, out="_pos")
    size = pool.agg(F.count("*")).scalar()
    sized = docs.select(doc_id).withColumn("_size", size)
    drawn = draw_positions(F.col(doc_id), F.col("_size"), n, seed)
    wanted = sized.select(doc_id, F.posexplode(drawn).alias("rank", "_pos"))
    return wanted.join(numbered, "_pos").drop("_pos")


def attach(docs, samples, doc_id, pool_id, num_fewshot, fields):
    """Documents with an array of shots, the document itself left out; empty where none is left.

    A document has at most ``num_fewshot + 1`` sample rows.
    """
    shots = samples.filter(F.col(doc_id) != F.col(pool_id))
    grouped = shots.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("fewshot"))
    shots = docs.join(grouped, doc_id, "left").withColumn("fewshot", F.slice("fewshot", 1, num_fewshot))
    return shots.withColumn("fewshot", F.coalesce("fewshot", F.array().cast(shots.schema["fewshot"].dataType)))


def seeds(df, iterations):
    """One copy of every row per seed."""
    return df.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(max(iterations, 1) - 1))))


# Preference of few-shot split names.
SPLIT_ORDER = ("train", "dev", "valid")


def split_choice(splits, dataset, split, evaluated):
    """Best split per dataset that is not evaluated: train, dev, valid, then any other."""
    rank = F.lit(len(SPLIT_ORDER))
    for i in reversed(range(len(SPLIT_ORDER))):
        rank = F.when(F.contains(F.col(split), F.lit(SPLIT_ORDER[i])), i).otherwise(rank)
    free = splits.filter(~F.col(split).isin(list(evaluated)))
    return free.groupBy(dataset).agg(F.min(F.struct(rank.alias("r"), F.col(split).alias("s")))["s"].alias("fewshot_split"))


def fixed_prefix(rows, task, index, example, k):
    """First k rows of a task as one example text, put on every other row of the task."""
    first = top_per_task(rows, task, [index], k)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(index), example.alias("_text"))))
    prefix = first.groupBy(task).agg(F.array_join(F.transform(pairs, lambda p: p["_text"]), "").alias("prefix"))
    rest = rows.join(first.select(index), index, "left_anti")
    return rest.join(prefix, task)
