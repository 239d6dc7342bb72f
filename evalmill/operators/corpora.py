"""Calibration sets, token budgets, splits and block packing."""

from functools import reduce

from pyspark.sql import functions as F

from evalmill.functions.arrays import span
from evalmill.operators.boards import top_per_task
from evalmill.operators.ordering import shuffle_select
from evalmill.operators.positions import global_running_sum


def union_sets(frames):
    """Concatenate sets with possibly different columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def calibration_mix(sources, identity, n, seed=42):
    """n / k rows of each of k sources under one ``question`` column, then shuffled.

    ``sources`` is a list of (frame, text column).
    """
    share = n // len(sources)
    parts = [df.select(identity, F.col(text).alias("question")).orderBy(identity).limit(share) for df, text in sources]
    return shuffle_select(union_sets(parts), identity, share * len(sources), seed)


def chat_calibration(turns, conv, turn, role, text, n_conversations, max_tokens, seed=42):
    """First n conversations in hash order as chat text cut to ``max_tokens`` words.

    A turn adds at least its role tag (a null role or text is empty), so only the first ``max_tokens`` turns
    of a conversation can matter; later ones are dropped below the shuffle and
    the collected list stays bounded.
    """
    ids = turns.groupBy(conv).agg(F.count("*").alias("_n"))
    chosen = ids.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(conv).cast("string"))), conv).limit(n_conversations)
    kept = top_per_task(turns.join(chosen.select(conv), conv), conv, [turn], max_tokens)
    parts = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.concat(F.lit("<"), F.coalesce(F.col(role), F.lit("")), F.lit("> "), F.coalesce(F.col(text), F.lit(""))).alias("x"))))
    joined = kept.groupBy(conv).agg(F.array_join(F.transform(parts, lambda p: p["x"]), " ").alias("_text"))
    tokens = F.slice(F.split("_text", r"\s+", -1), 1, max_tokens)
    return joined.select(conv, tokens.alias("tokens"))


def token_budget(docs, identity, tokens, budget):
    """Documents in id order until exactly ``budget`` tokens, the last one cut.

    The running sum runs over (id, length) only; token arrays join the chosen
    ids afterwards.
    """
    lengths = docs.select(identity, F.size(tokens).cast("long").alias("_n"))
    placed = global_running_sum(lengths, identity, identity, "_n", out="_end").withColumn("start", F.col("_end") - F.col("_n"))
    chosen = placed.filter((F.col("start") < budget) & (F.col("_n") > 0)).select(
        identity, "start", F.least(F.col("_n"), budget - F.col("start")).cast("int").alias("_take")
    )
    joined = docs.join(chosen, identity)
    return joined.withColumn(tokens, F.slice(tokens, 1, F.col("_take"))).drop("_take")


def train_val_by_tokens(stream, identity, tokens, total, share=0.9):
    """Cut the token stream at floor(share * total); positions restart in the validation part."""
    cut = int(share * total)
    n = F.size(tokens)
    left = F.greatest(F.least(F.lit(cut) - F.col("start"), n.cast("long")), F.lit(0)).cast("int")
    pieces = F.array(
        F.struct(F.lit("train").alias("split"), F.col("start").alias("start"), F.slice(tokens, 1, left).alias(tokens)),
        F.struct(
            F.lit("val").alias("split"),
            (F.greatest(F.col("start"), F.lit(cut)) - cut).alias("start"),
            F.slice(tokens, left + 1, n).alias(tokens),
        ),
    )
    return stream.select(identity, F.inline(F.filter(pieces, lambda p: F.size(p[tokens]) > 0)))


def pack_blocks(stream, split, start, tokens, length):
    """Fixed-length blocks across document borders; the remainder of a split is dropped.

    A document is cut into one piece per block it touches, so what is shuffled
    is pieces, not tokens, and a block collects at most ``length`` of them.
    """
    n = F.size(tokens)
    first, last = F.floor(F.col(start) / length), F.floor((F.col(start) + n - 1) / length)
    pieces = stream.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("block") * length - F.col(start), F.lit(0))
    hi = F.least((F.col("block") + 1) * length - F.col(start), n.cast("long"))
    pieces = pieces.select(
        split, "block", (F.col(start) + lo).alias("_at"), F.slice(tokens, (lo + 1).cast("int"), (hi - lo).cast("int")).alias("_piece")
    )
    blocks = pieces.groupBy(split, "block").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_p"))
    whole = blocks.select(split, "block", F.flatten(F.transform("_p", lambda p: p["_piece"])).alias(tokens))
    return whole.filter(F.size(tokens) == length)


def hash_split(df, identity, share=0.995, seed=42):
    """``train`` for a hash below the share, ``test`` otherwise."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(identity).cast("string"))), 1, 4), 16, 10).cast("int")
    return df.withColumn("split", F.when(u < int(share * 65536), "train").otherwise("test"))


def sweep_grid(configs, n_layers, drop):
    """One row per contiguous start, with the kept layer indices.

    A configuration becomes many rows, so they are dealt to as many tasks as a shuffle has.
    """
    n, start = F.col(n_layers), F.col("start")
    starts = F.when(n >= drop, F.sequence(F.lit(0), n - drop)).otherwise(F.array().cast("array<int>"))
    tasks = int(configs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = configs.repartition(tasks).withColumn("start", F.explode(starts))
    return grid.withColumn("kept", F.concat(span(F.lit(0), start), span(start + drop, n)))


def superset_members(requested, available, name):
    """Children ``name:subset`` of a requested name when it has more than one, else the name itself."""
    parent = F.split_part(F.col(name), F.lit(":"), F.lit(1))
    children = available.select(F.col(name).alias("member"), parent.alias(name)).filter(F.contains("member", F.lit(":")))
    counts = children.groupBy(name).agg(F.count("*").alias("_n")).filter("_n > 1")
    kids = children.join(counts.select(name), name, "left_semi")
    return requested.join(kids, name, "left").withColumn("member", F.coalesce("member", name))


def language_pairs(rows, lang):
    """All ordered pairs of the distinct languages, built inside one row of names."""
    names = rows.select(lang).distinct().agg(F.array_sort(F.collect_set(lang)).alias("_l"))
    pairs = names.select("_l", F.explode("_l").alias("source")).select("source", F.explode("_l").alias("target"))
    return pairs.filter("source <> target")
