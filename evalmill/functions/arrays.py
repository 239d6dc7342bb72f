"""Small array kernels shared by the scoring functions."""

from pyspark.sql import functions as F


def dbl(value):
    """A DOUBLE literal or cast (bare decimals would be typed DECIMAL in SQL)."""
    return F.lit(float(value)) if isinstance(value, (int, float)) else value.cast("double")


def r6(col):
    """Rounded report value; sums of doubles may differ in the last bits."""
    return F.round(col, 6)


def argmax(scores):
    """Zero-based position of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def array_sum(values):
    """Sum of an array of doubles, 0.0 when empty."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def span(lo, hi):
    """lo, lo+1, ..., hi - 1; empty when lo >= hi (``sequence`` would descend)."""
    return F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))


def indices(values):
    """0 .. size-1."""
    return span(F.lit(0), F.size(values))


def at(values, ix):
    """Zero-based element, NULL when out of range."""
    return F.get(values, ix)


def pick(values, positions):
    """Elements of ``values`` at zero-based ``positions``."""
    return F.transform(positions, lambda i: F.get(values, i))


def mean_of(values):
    """Mean of an array of doubles; NULL when empty."""
    return F.when(F.size(values) > 0, array_sum(values) / F.size(values))


def let(col, body):
    """``body`` applied to ``col`` as a bound variable.

    A Column used several times is copied into every use, so nested helpers
    grow exponentially; a lambda variable is shared instead.
    """
    return F.get(F.transform(F.array(col), body), F.lit(0))
