"""Sample metrics over choice log-probabilities (arrays in, one number out).

Every function takes and returns Columns. ``gold_index`` is always an array.
A row is one document with its response, so arrays are bounded by the number
of choices of that one document and nothing is shuffled.
"""

from pyspark.sql import functions as F

from evalmill.functions.arrays import argmax, array_sum, at, dbl, indices, pick


def norm_char(logprobs, choices, ignore_first_space=False):
    """Log-probability per character of the choice text; null for a text without characters."""

    def per_char(lp, text):
        n = F.length(text)
        if ignore_first_space:
            n = F.when(text.startswith(" "), n - 1).otherwise(n)
        return F.try_divide(lp, n)

    return F.zip_with(logprobs, choices, per_char)


def norm_token(logprobs, token_counts):
    """Log-probability per output token; null for a choice without tokens."""
    return F.zip_with(logprobs, token_counts, lambda lp, n: F.try_divide(lp, n))


def norm_pmi(logprobs, unconditioned):
    """Conditioned minus unconditioned log-probability."""
    return F.zip_with(logprobs, unconditioned, lambda a, b: a - b)


def split_pmi(logprobs, n):
    """First n scores minus the second n of an array of 2n scores."""
    return norm_pmi(F.slice(logprobs, 1, n), F.slice(logprobs, n + 1, n))


def loglik_acc(scores, gold_index):
    """1 when the first best score belongs to a gold."""
    return F.array_contains(gold_index, argmax(scores)).cast("int")


def mc_prob(scores, gold_index):
    """Probability mass of the best gold among the choices; 0 on zero mass."""
    probs = F.transform(scores, F.exp)
    total = array_sum(probs)
    return F.when(total != 0, F.array_max(pick(probs, gold_index)) / total).otherwise(dbl(0))


def gold_prob(scores):
    """Largest probability over the scored choices."""
    return F.array_max(F.transform(scores, F.exp))


def recall_at_k(scores, gold_index, k):
    """Any gold among the k best; ties keep the low index at k=1, the high one above."""
    if k == 1:
        return loglik_acc(scores, gold_index)
    ranked = F.reverse(F.array_sort(F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.alias("i")))))
    top = F.transform(F.slice(ranked, 1, k), lambda x: x["i"])
    return F.arrays_overlap(top, gold_index).cast("int")


def mrr(scores, gold_index):
    """1 / (1 + rank of the best gold); equal scores share the first rank."""
    best_gold = F.array_max(pick(scores, gold_index))
    return dbl(1) / (1 + F.size(F.filter(scores, lambda x: x > best_gold)))


def acc_gold_greedy(flags):
    """1 when any choice was the greedy continuation."""
    return F.exists(flags, lambda f: f).cast("int")


def two_part_truth(logprobs, gold_index, n_first):
    """(mc1, mc2) when the first ``n_first`` choices form the single-answer block.

    The true block of the second part is the unbroken run of gold positions
    that starts at the second gold.
    """
    mc1 = (argmax(F.slice(logprobs, 1, n_first)) == 0).cast("int")
    rest = F.slice(gold_index, 2, F.size(gold_index))
    first = at(rest, F.lit(0))
    run = F.size(F.filter(F.transform(rest, lambda g, i: F.struct((g - i).alias("d"))), lambda x: x["d"] == first))
    n_true = first + run - n_first
    probs = F.transform(F.slice(logprobs, n_first + 1, F.size(logprobs)), F.exp)
    return mc1, array_sum(F.slice(probs, 1, n_true)) / array_sum(probs)


def true_false_scores(true_lp, false_lp, best_ix):
    """Struct of max, diff, mc1, mc2, mc3 from true and false answer scores."""
    top_true, top_false = F.array_max(true_lp), F.array_max(false_lp)
    mass_true = array_sum(F.transform(true_lp, F.exp))
    mass_false = array_sum(F.transform(false_lp, F.exp))
    above = F.size(F.filter(true_lp, lambda x: x > top_false))
    return F.struct(
        top_true.alias("max"),
        (top_true - top_false).alias("diff"),
        (at(true_lp, best_ix) > top_false).cast("double").alias("mc1"),
        (mass_true / (mass_true + mass_false)).alias("mc2"),
        (above / F.size(true_lp)).alias("mc3"),
    )


def answer_logprob_sum(token_logprobs, prompt_tokens, prefix_tokens=3):
    """Sum of the token scores after the prompt and the answer prefix."""
    start = prompt_tokens + prefix_tokens
    return array_sum(F.slice(token_logprobs, start + 1, F.size(token_logprobs)))


def choice_label(logits, remap):
    """Argmax over option logits, mapped to the task's label by ``remap``."""
    return at(remap, argmax(logits))


def corpus_input(scores, gold_index, single_token=False):
    """Struct (golds, pred) for corpus metrics."""
    golds = F.slice(gold_index, 1, 1) if single_token else gold_index
    return F.struct(golds.alias("golds"), argmax(scores).alias("pred"))


def word_units(text):
    r"""Number of parts of a split on ``\s+``, empty edges included."""
    return F.size(F.split(text, r"(?U)\s+", -1))


def byte_units(text):
    """UTF-8 length."""
    return F.octet_length(text)


def random_baseline(gold_index, choices):
    """Chance level: golds per choice; null without choices."""
    return F.try_divide(F.size(gold_index), F.size(choices))


def gold_mask(n, gold_index):
    """Array of n flags, 1 at gold positions."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains(gold_index, i).cast("int"))


__all__ = [name for name in dir() if not name.startswith("_") and name not in ("F", "indices")]
