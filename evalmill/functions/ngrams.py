"""Tokens, n-grams and token-level distances (Column -> Column)."""

from pyspark.sql import functions as F

from evalmill.functions.arrays import let
from evalmill.functions.text import PUNCT_CLASS, words


def _grams(units, n, sep):
    """Joined runs of n units; the unit array is bound once, each gram costs n lookups."""

    def build(u):
        ids = F.when(F.size(u) >= n, F.sequence(F.lit(0), F.size(u) - n)).otherwise(F.array().cast("array<int>"))
        parts = lambda i: [F.get(u, i + k) for k in range(n)]
        return F.transform(ids, lambda i: F.concat_ws(sep, *parts(i)))

    return let(units, build)


def ngrams(tokens, n):
    """Space-joined n-grams of a token array, empty when it is shorter than n."""
    return runs(tokens, n, " ")


def runs(units, n, sep):
    """Runs of n units, joined."""
    return units if n == 1 else _grams(units, n, sep)


def chars(text):
    """Characters of a text."""
    return F.filter(F.split(text, "", -1), lambda c: c != "")


def char_ngrams(text, n):
    """Character n-grams of a text (over its character array: a substring scans from the start)."""
    return _grams(chars(text), n, "")


def alnum_tokens(text):
    """Lower-cased runs of ``[a-z0-9]``."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))


def chrf_words(text):
    """Whitespace words with one leading or trailing punctuation mark set apart."""

    def apart(w):
        last, first = F.right(w, F.lit(1)), F.left(w, F.lit(1))
        n = F.length(w)
        return (
            F.when(n == 1, F.array(w))
            .when(last.rlike(PUNCT_CLASS), F.array(F.left(w, n - 1), last))
            .when(first.rlike(PUNCT_CLASS), F.array(first, F.right(w, n - 1)))
            .otherwise(F.array(w))
        )

    return F.flatten(F.transform(words(text), apart))


def repeated(values):
    """Distinct values that occur more than once (sort, then compare neighbours)."""

    def found(s):
        hits = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a == b, a))  # the last has no neighbour
        return F.array_distinct(F.filter(hits, lambda h: h.isNotNull()))

    return let(F.array_sort(values), found)


def token_distance(a, b):
    """Edit distance over tokens.

    Every token becomes one character: the distinct tokens of ``a`` get their
    own, every token of ``b`` unknown to ``a`` the same spare one (it can match
    nothing either way). The built-in character distance then does the work in
    the JVM. Pass the shorter side as ``a``.
    """

    def distance(vocabulary):
        def letter(token):
            code = F.array_position(vocabulary, token) + 0x100
            code = F.when(code >= 0xD800, code + 0x2800).otherwise(code)
            return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

        encoded = lambda tokens: F.array_join(F.transform(tokens, letter), "")
        return F.levenshtein(encoded(a), encoded(b))

    return let(F.array_distinct(a), distance)


def common_prefix(a, b):
    """Number of leading tokens two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first == 0, n).otherwise(first - 1).cast("int")
