"""Grading and reports of instruction-following responses."""

from pyspark.sql import functions as F

from evalmill.functions import checks as ck


def grade(docs, identity, text, prompt, instructions, ids=None):
    """One row per (response, instruction): strict and loose flags.

    ``instructions`` is an array of (instruction_id, kwargs map) structs. A response becomes a
    row for each instruction; there the one check that its id names reads the distinct variants
    of the text, the raw one first, up to the first that follows. A check stands in the plan
    once, so the plan grows with the number of checks only, and flags need no shuffle. ``ids``
    names the checks that occur, if they are known; an id that is not among them fails.
    """
    once = docs.select(F.col(identity).alias("_id"), F.col(text).alias("_t"), F.col(prompt).alias("_p"), F.col(instructions).alias("_list"), ck.variants(F.col(text)).alias("_v"))
    texts = F.concat(F.array("_t"), F.filter("_v", lambda v: v != F.col("_t")))
    rows = once.select("_id", "_p", texts.alias("_texts"), F.posexplode("_list").alias("position", "_i"))
    name, args = F.col("_i.instruction_id"), ck.Args(F.col("_i.kwargs"))

    def step(acc, x):
        ok = ck.strict(name, x, args, F.col("_p"), ids)
        return F.when(acc["hit"] >= 0, acc).otherwise(F.struct((acc["n"] + 1).alias("n"), F.when(ok, acc["n"]).otherwise(-1).alias("hit")))

    hit = F.aggregate("_texts", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("hit")), step, lambda acc: acc["hit"])
    flags = rows.select(F.col("_id").alias(identity), "position", name.alias("instruction_id"), hit.alias("_hit"))
    return flags.select(identity, "position", "instruction_id", (F.col("_hit") == 0).alias("strict"), (F.col("_hit") >= 0).alias("loose"))


def per_prompt(graded, identity):
    """All-followed flags and counts per response."""
    return graded.groupBy(identity).agg(
        F.bool_and("strict").cast("int").alias("prompt_strict"),
        F.bool_and("loose").cast("int").alias("prompt_loose"),
        F.count_if(F.col("strict")).alias("strict_n"),
        F.count_if(F.col("loose")).alias("loose_n"),
    )


def report(graded, identity):
    """Prompt accuracy (mean over responses) and instruction accuracy (flat mean)."""
    per = graded.groupBy(identity).agg(
        F.bool_and("strict").cast("double").alias("ps"),
        F.bool_and("loose").cast("double").alias("pl"),
        F.count_if(F.col("strict")).alias("s"),
        F.count_if(F.col("loose")).alias("l"),
        F.count("*").alias("n"),
    )
    return per.agg(
        F.avg("ps").alias("prompt_strict"),
        F.avg("pl").alias("prompt_loose"),
        (F.sum("s") / F.sum("n")).alias("inst_strict"),
        (F.sum("l") / F.sum("n")).alias("inst_loose"),
    )


def report_by_type(graded):
    """Accuracy per instruction family and per full id."""
    family = F.split_part("instruction_id", F.lit(":"), F.lit(1))
    rows = graded.select(family.alias("family"), "instruction_id", F.col("strict").cast("int").alias("s"), F.col("loose").cast("int").alias("l"))
    full = rows.groupBy("family", "instruction_id").agg(F.sum("s").alias("s"), F.sum("l").alias("l"), F.count("*").alias("n"))
    # sums of an id are also a part of its family's, so that responses are graded once
    parts = full.withColumn("whole", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("instruction_id", F.when(F.col("whole"), "all").otherwise(F.col("instruction_id")))
    both = parts.groupBy("family", "instruction_id", "whole").agg(*[F.sum(c).alias(c) for c in ("s", "l", "n")])
    return both.select("family", "instruction_id", (F.col("s") / F.col("n")).alias("strict"), (F.col("l") / F.col("n")).alias("loose"), "n")
