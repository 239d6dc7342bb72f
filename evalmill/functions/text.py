r"""String normalisers, post-processors and parsers (Column -> Column).

Patterns use ``(?U)`` where a class must be Unicode aware (``\s``, ``\w``,
``\b``). All of them are literals, so each compiles once per task.
"""

import re

from pyspark.sql import functions as F

# ASCII punctuation.
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# The same set as a regex character class.
PUNCT_CLASS = "[" + re.escape(PUNCT) + "]"

# Articles by language.
ARTICLES = {
    "en": r"\b(a|an|the)\b",
    "es": r"\b(el|la|los|las|un|una|unos|unas)\b",
    "pt": r"\b(o|a|os|as|um|uma|uns|umas)\b",
    "it": r"\b(il|lo|la|i|gli|le|un|uno|una)\b",
    "fr": r"\b(le|la|les|l'|un|une|des)\b",
    "de": r"\b(der|die|das|den|dem|des|ein|eine|einer|eines|einem|einen)\b",
    "fi": r"\b(se|yksi|yks)\b",
    "el": r"\b(ὁ|οἱ|τοῦ|τῶν|τόν|τούς|ὦ|ἡ|αἱ|τῆς|τῶν|τήν|τάς|τό|τά|τοῦ|τῶν|τό|τά)\b",
    "no": r"\b(en|ei|et|den|det|de)\b",
    "sv": r"\b(en|ett|den|det|de)\b",
    "tr": r"\b(bir)\b",
    "nl": r"\b(de|het|een)\b",
    "hu": r"\b(a|az|egy)\b",
    "ca": r"\b(el|la|els|les|un|una|uns|unes)\b",
    "he": r"\b(ה)\b",
    "gl": r"\b(o|a|os|as|un|unha|uns|unhas)\b",
}


def lit(value):
    return F.lit(value) if isinstance(value, (str, int, float)) else value


def replace(text, old, new=""):
    """Literal replacement of every occurrence."""
    return F.replace(text, F.lit(old), F.lit(new))


# The characters of (?U)\\s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text):
    """Trim Unicode whitespace on both sides."""
    return F.trim(text, F.lit(WHITE))


def rstrip(text):
    return F.rtrim(text, F.lit(WHITE))


def lstrip(text):
    return F.ltrim(text, F.lit(WHITE))


def strip_chars(text, chars=PUNCT + " "):
    """Trim any of ``chars`` on both sides."""
    return F.trim(text, F.lit(chars))


def remove_punct(text):
    """Drop ASCII punctuation."""
    return F.translate(text, PUNCT, "")


def words(text):
    """Whitespace tokens, no empty ones."""
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def word_count(text):
    r"""Number of ``\w+`` runs."""
    return F.regexp_count(text, F.lit(r"(?U)\w+"))


def squeeze(text):
    """Whitespace runs to one blank, trimmed."""
    return F.array_join(words(text), " ")


# --- post-processing ----------------------------------------------------------


def remove_reasoning_tags(text, tag_pairs):
    """Delete every start..end span, one tag pair after the other.

    The first span goes first, and the text is read again from its start: a tag that a deletion
    forms counts too. Each deletion takes at least one last character of the end tag away,
    which bounds the number of steps.
    """
    for start, end in tag_pairs:
        steps = F.length(text) - F.length(F.replace(text, F.lit(end[-1]), F.lit("")))
        first = f"(?s)\\A(.*?){_quote(start)}.*?{_quote(end)}"
        cut = lambda t, _, s=start, f=first: F.when(F.contains(t, F.lit(s)), F.regexp_replace(t, f, "$1")).otherwise(t)
        text = F.when(F.contains(text, F.lit(start)), F.aggregate(F.sequence(F.lit(0), steps), text, _two(cut))).otherwise(text)
    return text


def _two(step):
    """A step of two arguments, as higher-order functions ask for."""
    return lambda t, i: step(t, i)


def _quote(text):
    return re.escape(text)


# --- normalisers ----------------------------------------------------------------


def number_repr(token):
    """A digit token as a double prints it (``7`` to ``7.0``); other tokens unchanged."""
    value = token.try_cast("double")
    big = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\.0E", "E"), "E", "e+")
    plain = F.concat(value.cast("bigint").cast("string"), F.lit(".0"))
    shown = F.when(value >= 1e16, big).otherwise(plain)
    return F.when(token.rlike(r"^[0-9]+(?:e[0-9]{1,2})?\z"), shown).otherwise(token)


def norm_helm(text):
    """Lower, drop punctuation and articles, unify numbers, split on blank or dash."""

    def clean(token):
        token = number_repr(remove_punct(F.lower(token)))
        return squeeze(F.regexp_replace(token, r"(?U)\b(a|an|the)\b", " "))

    tokens = F.transform(F.split(text, " |-", -1), clean)
    return F.array_join(F.filter(tokens, lambda t: t != ""), " ")


def norm_triviaqa(text):
    return remove_punct(F.lower(text))


def norm_bigbench(text):
    return replace(text, " . ", ".\n")


def strip_braces(text, trim=False):
    """Drop one leading and one trailing brace."""
    text = strip(text) if trim else text
    return F.regexp_replace(F.regexp_replace(text, r"^\{", ""), r"\}\z", "")


def norm_gsm8k(text):
    """Number after ``####`` without thousands commas, else ``[invalid]``."""
    number = F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1)
    return F.when(number == "", "[invalid]").otherwise(replace(number, ","))


def remove_articles(text, lang):
    """Drop articles; ``lang`` is a code or a Column of codes."""
    if isinstance(lang, str):
        return F.regexp_replace(text, "(?U)" + ARTICLES[lang], " ") if lang in ARTICLES else text
    out = None
    for code, pattern in ARTICLES.items():
        value = F.regexp_replace(text, "(?U)" + pattern, " ")
        out = F.when(lang == code, value) if out is None else out.when(lang == code, value)
    return out.otherwise(text)


def remove_punct_unicode(text):
    """Drop every Unicode punctuation character and ASCII punctuation."""
    return F.regexp_replace(text, r"[\p{P}$+<=>^`|~]", "")


def norm_multilingual(text, lang, lower=True):
    """Articles, punctuation, case, then whitespace tokens joined again."""
    out = remove_punct_unicode(remove_articles(text, lang))
    return squeeze(F.lower(out) if lower else out)


# --- LaTeX strings ----------------------------------------------------------------


def matched_braces(text):
    """Length of the prefix of ``text`` up to the brace that closes its first open one, 0 if none."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(acc, ch):
        depth = acc["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        closes = (ch == "}") & (depth == 0) & (acc["end"] == 0)
        i = acc["i"] + 1
        return F.struct(i.alias("i"), depth.alias("depth"), F.when(closes, i).otherwise(acc["end"]).alias("end"))

    return F.aggregate(F.split(text, "", -1), start, step, lambda acc: acc["end"])


def last_boxed(text):
    """Content of the last boxed environment, empty when there is none."""
    tail = F.substring_index(text, "\\boxed", -1)
    n = matched_braces(tail)
    body = F.when(tail.startswith("{"), F.substr(tail, F.lit(2), n - 2)).when(
        tail.startswith(" "), F.substr(tail, F.lit(2), n - 1)
    )
    return F.when(F.contains(text, F.lit("\\boxed")) & (n > 0), F.coalesce(body, F.lit(""))).otherwise("")


# Literal rewrites before and after the unit is cut.
MATH_REWRITES = [
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""),
    ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
]
MATH_REWRITES_AFTER_UNITS = [("\\%", ""), (" .", " 0."), ("{.", "{0.")]


def norm_math(text):
    """Answer in the last boxed environment in one canonical LaTeX spelling."""
    out = last_boxed(text)
    for old, new in MATH_REWRITES:
        out = replace(out, old, new)
    out = F.when(F.contains(out, F.lit("\\text{ ")), rstrip(F.substring_index(out, "\\text{ ", 1))).otherwise(out)
    for old, new in MATH_REWRITES_AFTER_UNITS:
        out = replace(out, old, new)
    out = F.regexp_replace(out, r"^\.", "0.")
    out = F.regexp_replace(out, r"(?s)^[^=]{0,2}=([^=]*)\z", "$1")
    out = F.regexp_replace(out, r"\\sqrt([^{])", r"\\sqrt{$1}")
    out = replace(out, " ")
    short_fraction = out.rlike(r"(?s)\\frac(?!\{).?(?=\\frac|\z)")
    braced = F.regexp_replace(out, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    braced = F.regexp_replace(braced, r"\\frac([^{])\{", r"\\frac{$1}{")
    out = F.when(short_fraction, out).otherwise(braced)
    out = F.when(out == "0.5", "\\frac{1}{2}").otherwise(out)
    return F.regexp_replace(out, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)\z", r"\\frac{$1}{$2}")


# --- parsers ------------------------------------------------------------------------


def code_block(text):
    """Lines between the last two fence lines."""
    lines = F.split(text, "\n", -1)
    fences = F.filter(
        F.transform(lines, lambda line, i: F.when(F.contains(line, F.lit("```")), i)), lambda i: i.isNotNull()
    )
    n = F.size(fences)
    first, last = F.get(fences, n - 2), F.get(fences, n - 1)
    body = F.array_join(F.slice(lines, first + 2, last - first - 1), "\n")
    return F.when(n >= 2, body).otherwise("")


def verdict_score(text):
    """Digit inside a score tag, 0 when absent."""
    return F.coalesce(F.regexp_extract(text, r"<score>\s(\d)\s</score>", 1).try_cast("int"), F.lit(0))


def verdict_binary(text):
    """0 or 1 in double brackets, 0 when absent."""
    return F.coalesce(F.regexp_extract(text, r"\[\[([01])\]\]", 1).try_cast("int"), F.lit(0))


def verdict_decimal(text):
    """One-decimal number in double brackets, 0 when absent."""
    return F.coalesce(F.regexp_extract(text, r"\[\[(\d.\d)\]\]", 1).try_cast("double"), F.lit(0.0))


def verdict_letter(text):
    """1 for A, 0 for anything else."""
    return F.when(text == "A", 1.0).otherwise(0.0)


def label_json(text, labels, field="classification"):
    """Label in a JSON answer, ``unknown`` when malformed or not one of ``labels``."""
    value = F.lower(strip(F.from_json(text, f"`{field}` STRING")[field]))
    return F.when(value.isin(list(labels)), value).otherwise("unknown")


def loose_variants(text):
    """The answer, without first, last and both outer lines, each with and without asterisks."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines)

    def joined(start, length):
        return strip(F.array_join(F.slice(lines, start, F.greatest(length, F.lit(0))), "\n"))

    first, last, both = joined(F.lit(2), n - 1), joined(F.lit(1), n - 1), joined(F.lit(2), n - 2)
    plain = [text, first, last, both]
    return F.array(*plain, *[replace(v, "*") for v in plain])


def flatten_struct(col, dtype, sep="/", prefix=None):
    """Nested value to an array of (key path, value) structs, driven by its schema."""
    from pyspark.sql import types as T

    path = F.lit("") if prefix is None else prefix
    joined = (lambda name: F.lit(name)) if prefix is None else (lambda name: F.concat(path, F.lit(sep + name)))
    if isinstance(dtype, T.StructType):
        parts = [flatten_struct(col[f.name], f.dataType, sep, joined(f.name)) for f in sorted(dtype, key=lambda f: f.name)]
        return F.concat(*parts)
    if isinstance(dtype, T.ArrayType):
        return F.flatten(
            F.transform(
                col,
                lambda x, i: flatten_struct(x, dtype.elementType, sep, F.concat(path, F.lit(sep), i.cast("string"))),
            )
        )
    value = col.cast("string")
    if isinstance(dtype, T.StringType):
        value = F.translate(value, "|\n", "__")
    return F.array(F.struct(path.alias("key"), value.alias("value")))


def task_file_name(task):
    """Name usable in a file path: non-word characters to underscores."""
    return F.regexp_replace(task, r"(?U)\W", "_")


def task_display_name(task):
    """Pipe separators to colons."""
    return replace(task, "|", ":")


def tracker_name(task):
    """Colons to slashes."""
    return replace(task, ":", "/")


def split_plain_sentences(text, min_chars=10):
    """Regex sentences longer than ``min_chars``."""
    cut = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001", -1)
    return F.filter(cut, lambda s: F.length(s) > min_chars)


def split_chunks(text, granularity, min_chars=10):
    """Document, paragraph, sentence, overlapping pairs of sentences, or mixed."""
    if granularity == "document":
        return F.array(text)
    if granularity == "paragraph":
        by_blank = F.split(text, "\n\n", -1)
        parts = F.when(F.contains(text, F.lit("\n\n")), by_blank).otherwise(F.split(text, "\n", -1))
        return F.filter(F.transform(parts, strip), lambda p: F.length(p) > min_chars)
    sentences = split_plain_sentences(text, min_chars)
    if granularity == "sentence":
        return sentences
    if granularity == "2sents":
        nxt = F.concat(F.slice(sentences, 2, F.size(sentences)), F.array(F.lit(None).cast("string")))
        nxt = F.slice(nxt, 1, F.size(sentences))
        return F.zip_with(sentences, nxt, lambda a, b: F.concat_ws(" ", a, b))
    if granularity == "mixed":
        return F.concat(sentences, split_chunks(text, "paragraph", min_chars))
    raise ValueError(granularity)


def lists_to_rows(lists):
    """Named arrays of equal length to an array of structs; unequal lengths raise."""
    names = list(lists)
    sizes = [F.size(lists[n]) for n in names]
    same = sizes[0].isNotNull()
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    zipped = F.arrays_zip(*[lists[n].alias(n) for n in names])
    return F.when(same, zipped).otherwise(F.raise_error(F.lit("lists have unequal lengths")))
