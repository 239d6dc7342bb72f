"""Sample metrics of predictions against golds (Column -> Column).

``golds`` and ``preds`` are arrays of strings; a score is the best over all
gold x prediction pairs of the row.
"""

from pyspark.sql import functions as F

from evalmill.functions.arrays import array_sum, dbl
from evalmill.functions.sequences import assignment_udf
from evalmill.functions.text import number_repr, remove_punct, squeeze, strip, words


def _identity(x):
    return x


def best_pair(golds, preds, score):
    """Maximum of ``score(gold, pred)`` over all pairs."""
    return F.array_max(F.flatten(F.transform(golds, lambda g: F.transform(preds, lambda p: score(g, p)))))


def exact_match(golds, preds, mode="full", strip_strings=False, norm_gold=_identity, norm_pred=_identity):
    """Full, prefix or suffix match; an empty prediction scores 0."""
    side = strip if strip_strings else _identity

    def one(gold, pred):
        g, p = norm_gold(side(gold)), norm_pred(side(pred))
        hit = {"full": p == g, "prefix": p.startswith(g), "suffix": p.endswith(g)}[mode]
        return F.when(pred == "", 0).otherwise(hit.cast("int"))

    return best_pair(golds, preds, one)


def set_f1(gold_set, pred_set):
    """F-measure of two sets of tokens, 0 when either is empty or they are disjoint."""
    both = F.size(F.array_intersect(gold_set, pred_set))
    total = F.size(gold_set) + F.size(pred_set)
    return F.when((F.size(gold_set) == 0) | (F.size(pred_set) == 0), dbl(0)).otherwise(2 * both / total)


def bow_f1(golds, preds, norm_gold=_identity, norm_pred=_identity):
    """F1 over sets of whitespace tokens."""
    return best_pair(
        golds,
        preds,
        lambda g, p: set_f1(F.array_distinct(words(norm_gold(g))), F.array_distinct(words(norm_pred(p)))),
    )


# --- span answers -----------------------------------------------------------------

NUMBER = r"^\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e\+?[0-9]{1,2})?\z"


def _double_text(token):
    """A number as Python prints the double."""
    value = token.try_cast("double")
    whole = F.concat(value.cast("bigint").cast("string"), F.lit(".0"))
    long_form = F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"0+\z", "")
    text = F.when(value == F.floor(value), whole).when((value >= 1e7) | (value < 1e-3), long_form)
    return text.otherwise(value.cast("string"))


def norm_span(text):
    """Lower, drop punctuation except inside numbers, articles, unify numbers."""

    def clean(token):
        low = F.lower(token)
        bare = remove_punct(low)
        out = F.when(low.rlike(NUMBER), _double_text(low)).otherwise(number_repr(bare))
        return squeeze(F.regexp_replace(out, r"(?U)\b(a|an|the)\b", " "))

    tokens = F.transform(F.split(text, " |-", -1), clean)
    return F.array_join(F.filter(tokens, lambda t: t != ""), " ")


def _bag_f1(gold, pred):
    """F1 of two token sets, 0 when the gold has numbers and the prediction none of them."""
    numbers = F.filter(gold, lambda t: t.rlike(NUMBER))
    agree = (F.size(numbers) == 0) | F.arrays_overlap(numbers, pred)
    both = F.size(F.array_intersect(gold, pred))
    n_gold, n_pred = F.size(gold), F.size(pred)
    f1 = (
        F.when((n_gold == 0) & (n_pred == 0), dbl(1))
        .when(n_gold == 0, dbl(0))
        .when(n_pred == 0, dbl(0))
        .otherwise(2 * both / (n_gold + n_pred))
    )
    return F.when(agree, f1).otherwise(dbl(0))


def span_match(gold_spans, pred_spans):
    """(em, score matrix) of one gold answer against the predicted spans."""
    gold = F.transform(gold_spans, norm_span)
    pred = F.transform(pred_spans, norm_span)
    em = (
        (F.size(F.array_except(gold, pred)) == 0) & (F.size(F.array_except(pred, gold)) == 0)
    ).cast("double")
    bags = lambda spans: F.transform(spans, lambda s: F.array_distinct(words(s)))
    matrix = F.transform(bags(gold), lambda g: F.transform(bags(pred), lambda p: _bag_f1(g, p)))
    return em, matrix


def aligned_f1(matrix):
    """Mean F1 of the best one-to-one alignment, to two digits; 0 without a span on a side.

    With one span on a side the best cell is the answer; only larger matrices
    go through the assignment UDF.
    """
    n_rows, n_cols = F.size(matrix), F.size(F.get(matrix, F.lit(0)))
    single = (n_rows == 1) | (n_cols == 1)
    best_cell = F.array_max(F.flatten(matrix))
    total = F.when(single, best_cell).otherwise(assignment_udf(matrix))
    return F.coalesce(F.bround(total / F.greatest(n_rows, n_cols), 2), dbl(0))


def f_measure(match, n_gold, n_pred):
    """F1 from a match count and the two totals, 0 without a match."""
    return F.when(match > 0, 2.0 * match / (n_gold + n_pred)).otherwise(dbl(0))


def cosine(a, b):
    """Cosine of two vectors."""
    dot = lambda x, y: array_sum(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
