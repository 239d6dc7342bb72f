"""Text-pair metrics that need grouping: n-gram overlap, BLEU, chrF, NLI, embeddings.

Pairs are first hash-partitioned on their key. Counting n-grams and every
aggregate after it keep that partitioning (the keys contain it), so the raw
texts are shuffled once and the n-grams never are.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalmill.functions.arrays import array_sum, dbl, let
from evalmill.functions.ngrams import alnum_tokens, chars, chrf_words, runs
from evalmill.functions.pairs import f_measure
from evalmill.functions.sequences import gram_counts_udf, medians_udf, rouge_matches_udf
from evalmill.functions.text import norm_bigbench


def _specs(side):
    """A side as (units, separator, {label: size}): runs of ``size`` units, or ready-made grams by label."""
    return [(grams, "", {n: 1}) for n, grams in side.items()] if isinstance(side, dict) else side


def _counted(pairs, keys, golds, pred, by):
    """Per (keys, n): clipped matches, grams of the gold and of the prediction; counts are clipped by the best gold.

    The grams of a pair are counted inside its row. Only rows that share their keys become a row for each gram,
    which are added up over the rows of the keys. A null array of units leaves the whole row out.
    """
    golds, pred = [_specs(g) for g in golds], _specs(pred)
    whole = Window.partitionBy(*keys)
    sizes = [list(labels.values()) for _, _, labels in pred]
    counted = pairs.withColumn("_m", gram_counts_udf(sizes, [[side[k][0] for side in (pred, *golds)] for k in range(len(pred))]))
    rows = counted.repartition(*(by or keys)).withColumn("_rows", F.count(F.lit(1)).over(whole))
    single = F.col("_rows") == 1
    labels = [label for _, _, named in pred for label in named]

    def entry(n, gram, side, g, p, match):
        values = {"n": F.lit(n), "gram": gram, "side": F.lit(side), "g": g, "p": p, "match": match}
        kinds = {"gram": "string", "g": "long", "p": "long", "match": "long"}
        return F.struct(*[(v.cast(kinds[k]) if k in kinds else v).alias(k) for k, v in values.items()])

    null, one, zero = F.lit(None), F.lit(1), F.lit(0)
    tagged = lambda n, at, g, p: lambda x: entry(n, x, at, g, p, null)
    parts = []
    for at, side in enumerate((pred, *golds)):
        g, p = (zero, one) if at == 0 else (one, zero)
        for units, sep, named in side:
            for n, size in named.items():
                parts.append(F.transform(runs(units, size, sep), tagged(n, at, g, p)))
    told = lambda k, m: entry(labels[k], null, 0, F.get(m, F.lit(2)), F.get(m, F.lit(1)), F.get(m, F.lit(0)))
    whole_rows = F.filter(F.array(*[told(k, F.get("_m", F.lit(k))) for k in range(len(labels))]), lambda e: e["g"] + e["p"] > 0)
    entries = F.when(single, F.when(F.col("_m").isNotNull(), whole_rows)).otherwise(F.concat(*parts))
    grams = rows.select(*keys, F.inline(entries))
    sides = grams.groupBy(*keys, "n", "gram", "side").agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.max("match").alias("match"))
    clipped = sides.groupBy(*keys, "n", "gram").agg(F.max("g").alias("g"), F.max("p").alias("p"), F.max("match").alias("match"))
    return clipped.groupBy(*keys, "n").agg(
        F.sum(F.coalesce("match", F.least("g", "p"))).alias("match"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred")
    )


def ngram_overlap(pairs, keys, sides, by=None):
    """Per (keys, n): clipped matches and n-gram totals of both sides.

    ``sides`` maps gold and pred to {n: gram array Column} or to a list of (units, separator, {n: size}), the
    n-grams then being runs of units. ``by`` names the keys to partition on (all of them unless given); later
    groupings that contain them need no further exchange.
    """
    return _counted(pairs, keys, [sides["gold"]], sides["pred"], by)


def multi_gold_overlap(pairs, keys, gold_arrays, pred_tokens, orders=(1, 2, 3, 4)):
    """Like ``ngram_overlap`` with counts clipped by the best of several golds."""
    spec = lambda tokens: [(tokens, " ", {n: n for n in orders})]
    return _counted(pairs, keys, [spec(g) for g in gold_arrays], spec(pred_tokens), None).drop("n_gold")


def closest_length(gold_sizes, pred_size):
    """Gold length nearest to the prediction, the shorter one on a tie."""
    ranked = F.transform(gold_sizes, lambda g: F.struct(F.abs(g - pred_size).alias("d"), g.alias("n")))
    return F.array_min(ranked)["n"]


def brevity_penalty(ref_len, pred_len):
    return (
        F.when(pred_len == 0, dbl(0)).when(pred_len > ref_len, dbl(1)).otherwise(F.exp(1 - ref_len / pred_len))
    )


def bleu_single_order(pairs, keys, gold_arrays, pred_tokens, orders=(1, 2, 3, 4)):
    """Per pair: BLEU with all weight on one order, for every order.

    No shared unigram gives 0 whatever the order.
    """
    lengths = pairs.select(
        *keys,
        brevity_penalty(closest_length(F.array(*[F.size(g) for g in gold_arrays]), F.size(pred_tokens)), F.size(pred_tokens)).alias("bp"),
    )
    stats = multi_gold_overlap(pairs, keys, gold_arrays, pred_tokens, orders)
    wide = stats.groupBy(*keys).agg(
        *[F.max(F.when(F.col("n") == n, F.col("match") / F.greatest("n_pred", F.lit(1)))).alias(f"p{n}") for n in orders]
    )
    joined = lengths.join(wide, list(keys), "left")
    any_match = F.coalesce(F.col("p1"), F.lit(0.0)) > 0
    return joined.select(
        *keys,
        *[F.when(any_match, F.coalesce(F.col(f"p{n}"), F.lit(0.0)) * F.col("bp")).otherwise(dbl(0)).alias(f"bleu_{n}") for n in orders],
    )


def bootstrap_mid(scores, identity, samples=1000):
    """Median of the means of ``samples`` resamples of each of some score arrays of one length.

    ``scores`` maps names to array Columns, which are resampled together. Draws come from a
    hash of the identity and the resample, four of each md5. One score is its own median; none gives null.
    """
    rows = medians_udf(identity.cast("string"), F.array(*scores.values()), samples)
    named = lambda m: F.struct(*[F.get(m, F.lit(k)).alias(name) for k, name in enumerate(scores)])
    return let(rows, lambda m: F.when(m.isNotNull(), named(m)))


def rouge_t5(samples, identity, golds, preds, normalize=None, resamples=1000):
    """Per sample rouge1, rouge2, rougeL and rougeLsum, times 100.

    The gold and the prediction at the same place are a pair; what has no partner is left out.
    Texts are normalised, then read as lower-cased runs of letters and digits, for the last score
    line by line. Of several pairs the median of bootstrap means counts; without a pair, or with a
    null array, the scores are null, and a null text holds no words. Samples are dealt out first:
    a table of them has few input splits for the work that each row makes.
    """
    samples = samples.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    normalize = normalize or norm_bigbench
    n = F.when(golds.isNotNull() & preds.isNotNull(), F.least(F.size(golds), F.size(preds))).otherwise(0)
    lines = lambda text: F.transform(F.split(normalize(F.coalesce(text, F.lit(""))), "\n", -1), alnum_tokens)
    blank = F.array(F.array(F.array(F.lit(""))))  # Python workers don't survive an empty array of nested arrays
    tokens = lambda texts: F.when(n > 0, F.transform(F.slice(texts, F.lit(1), n), lines)).otherwise(blank)
    met = samples.withColumn("_m", rouge_matches_udf(tokens(golds), tokens(preds)))
    at = lambda m, k: F.get(m, F.lit(k))

    def f(k):
        less = 1 if k == 1 else 0  # a text has one bigram less than tokens
        return F.when(n > 0, F.transform("_m", lambda m: f_measure(at(m, k), at(m, 4) - less, at(m, 5) - less)))

    names = ("rouge1", "rouge2", "rougeL", "rougeLsum")
    scored = met.select("*", *[f(k).alias(f"_{name}") for k, name in enumerate(names)])
    mid = bootstrap_mid({name: F.col(f"_{name}") for name in names}, identity, resamples)
    out = scored.withColumn("_mid", mid).select(*samples.columns, *[(100 * F.col("_mid")[name]).alias(name) for name in names])
    return out


def corpus_bleu(pairs, keys, task, gold_tokens, pred_tokens, max_order=4):
    """BLEU x100 per task from summed clipped counts and lengths (exponential smoothing)."""
    orders = range(1, max_order + 1)
    spec = lambda tokens: [(tokens, " ", {n: n for n in orders})]
    stats = ngram_overlap(pairs, [task, *keys], {"gold": spec(gold_tokens), "pred": spec(pred_tokens)})
    sums = stats.groupBy(task).agg(
        *[F.sum(F.when(F.col("n") == n, F.col("match")).otherwise(0)).alias(f"m{n}") for n in orders],
        *[F.sum(F.when(F.col("n") == n, F.col("n_pred")).otherwise(0)).alias(f"t{n}") for n in orders],
        F.sum(F.when(F.col("n") == 1, F.col("n_gold")).otherwise(0)).alias("ref_len"),
    )
    logs, zeros = dbl(0), F.lit(0)
    for n in orders:
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        zeros = zeros + F.when(m == 0, 1).otherwise(0)
        logs = logs + F.when(m == 0, F.log(1 / (F.pow(dbl(2), zeros) * t))).otherwise(F.log(m / t)) / max_order
    usable = reduce(lambda a, b: a & b, [F.col(f"t{n}") > 0 for n in orders]) & (F.col("m1") > 0)
    score = F.when(usable, 100 * brevity_penalty(F.col("ref_len"), F.col("t1")) * F.exp(logs)).otherwise(dbl(0))
    return sums.select(task, score.alias("bleu"), *[f"m{n}" for n in orders], *[f"t{n}" for n in orders], "ref_len")


def corpus_chrf(pairs, keys, task, gold, pred, char_order=6, word_order=0, beta=2):
    """chrF x100 per task: mean precision and recall over the orders both sides have."""
    squeezed = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    # a table of short texts has few input splits for the work that each row makes
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sides = {}
    for side, col in (("gold", gold), ("pred", pred)):
        characters = F.coalesce(chars(squeezed(col)), F.array().cast("array<string>"))
        sides[side] = [(characters, "", {n: n for n in range(1, char_order + 1)})]
        if word_order:
            sides[side].append((chrf_words(col), " ", {100 + n: n for n in range(1, word_order + 1)}))
    stats = ngram_overlap(pairs, [task, *keys], sides)
    sums = stats.groupBy(task, "n").agg(
        F.sum("match").alias("match"), F.sum("n_gold").alias("n_gold"), F.sum("n_pred").alias("n_pred")
    )
    both = sums.filter("n_gold > 0 AND n_pred > 0")
    means = both.groupBy(task).agg(
        F.avg(F.col("match") / F.col("n_pred")).alias("p"), F.avg(F.col("match") / F.col("n_gold")).alias("r")
    )
    f = beta * beta
    p, r = F.col("p"), F.col("r")
    return means.select(task, F.when(p + r > 0, 100 * (1 + f) * p * r / (f * p + r)).otherwise(dbl(0)).alias("chrf"))


def _block_best(batches):
    """Best cosine of every token of two blocks with the other block."""
    for batch in batches:
        parts = []
        for key, ref, hyp in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            sides = [side.values for side in (ref, hyp)]
            ids, weights = ([s.field(k) for s in sides] for k in ("token", "weight"))
            rows = [s.field("vector") for s in sides]
            x, y = (np.asarray(r.flatten(), dtype=float).reshape(len(r), -1) for r in rows)
            s = x @ y.T
            for side, best in ((0, s.max(axis=1)), (1, s.max(axis=0))):
                n = len(best)
                parts.append([pa.array([key] * n, pa.string()), pa.array([side] * n, pa.int32()), ids[side], weights[side], pa.array(best)])
        columns = [pa.concat_arrays(c) for c in zip(*parts)] if parts else []
        if columns:
            yield pa.RecordBatch.from_arrays(columns, names=["_pair", "_side", "_token", "_weight", "_s"])


def greedy_embedding_match(vectors, pair, side, token, vector, weight, block=256):
    """Weighted precision, recall and F of best-cosine token matching per pair.

    ``side`` is 0 for the reference and 1 for the prediction; ``token`` names a vector within
    its pair and side. Tokens are dealt by hash to blocks of about ``block`` vectors of unit
    length. Every block of a pair's reference meets every block of its prediction once, in one
    join, as one matrix product that gives both sides' best cosines; blocks are merged by
    maximum. So a pair of any size is spread over tasks, and one of two short texts is one row.

    A null vector is no token. A vector without length has a cosine of 0 with all others. A pair
    without tokens on one side has the scores 0.
    """
    key = F.to_json(F.struct(F.col(pair).alias("k")))
    length = F.sqrt(array_sum(F.transform(vector, lambda x: dbl(x) * dbl(x))))
    unit = let(length, lambda n: F.transform(vector, lambda x: F.when(n > 0, dbl(x) / n).otherwise(dbl(0))))
    named = vectors.select(
        key.alias("_pair"), F.col(side).cast("int").alias("_side"), F.col(token).alias("_token"), dbl(F.col(weight)).alias("_weight"), unit.alias("_vector")
    ).filter("_vector IS NOT NULL")
    blocks = lambda n: F.ceil(F.count_if(F.col("_side") == n) / block)
    sizes = named.groupBy("_pair").agg(blocks(0).alias("_n0"), blocks(1).alias("_n1")).filter("_n0 > 0 AND _n1 > 0")
    cut = named.join(sizes, "_pair")

    def dealt(n):
        """Blocks of side ``n``, one row for each block of the other side."""
        own, other = f"_n{n}", f"_n{1 - n}"
        tokens = F.collect_list(F.struct(F.col("_token").alias("token"), F.col("_weight").alias("weight"), F.col("_vector").alias("vector")))
        held = cut.filter(F.col("_side") == n).groupBy("_pair", F.pmod(F.xxhash64("_token"), own).alias(f"_b{n}"), other).agg(tokens.alias(f"_t{n}"))
        return held.withColumn(f"_b{1 - n}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop(other)

    met = dealt(0).join(dealt(1), ["_pair", "_b0", "_b1"]).select("_pair", "_t0", "_t1")
    kind = dict(named.dtypes)["_token"]
    best = met.mapInArrow(_block_best, f"_pair string, _side int, _token {kind}, _weight double, _s double")
    tokens = best.groupBy("_pair", "_side", "_token").agg(F.max("_s").alias("_s"), F.first("_weight").alias("_weight"))
    mean = lambda n: F.sum(F.when(F.col("_side") == n, F.col("_s") * F.col("_weight"))) / F.sum(F.when(F.col("_side") == n, F.col("_weight")))
    matched = tokens.groupBy("_pair").agg(mean(1).alias("precision"), mean(0).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    every = vectors.select(pair).distinct().withColumn("_pair", key)
    out = every.join(matched, "_pair", "left").select(pair, F.coalesce(p, dbl(0)).alias("precision"), F.coalesce(r, dbl(0)).alias("recall"))
    return out.withColumn("f1", F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(dbl(0)))


def faithfulness(nli, doc, gen, ent, con, settings):
    """Per document: inner aggregate over source chunks, ent minus con, outer over summary chunks.

    ``settings`` maps an output name to its (inner, outer) aggregates; all of
    them come from the same two aggregates.
    """
    agg = {"max": F.max, "mean": F.avg, "min": F.min}
    chunks = nli.groupBy(doc, gen).agg(*[(agg[i](ent) - agg[i](con)).alias(n) for n, (i, _) in settings.items()])
    return chunks.groupBy(doc).agg(*[agg[o](n).alias(n) for n, (_, o) in settings.items()])


def nli_pairs(docs, source_chunks, summary_chunks, max_source=None):
    """One row per (source chunk, summary chunk) of a document.

    ``max_source`` keeps the first chunks of the source only; by default all are kept.
    """
    if max_source is not None:
        source_chunks = F.slice(source_chunks, 1, max_source)
    return (
        docs.withColumn("_src", source_chunks)
        .withColumn("_gen", summary_chunks)
        .select("*", F.posexplode("_src").alias("src_ix", "premise"))
        .select("*", F.posexplode("_gen").alias("gen_ix", "hypothesis"))
        .drop("_src", "_gen")
    )
