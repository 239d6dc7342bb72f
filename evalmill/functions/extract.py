r"""Answer extraction from free text: numbers, expressions, option letters, LaTeX.

The places where an answer may stand are tried in turn. Of the matches of a place the one that
ends last wins (the earlier start on a tie); the first place with a value decides. Places are
templates, filled in from a table of languages; a text is read with the words of its own language.
"""

import re
import string

from pyspark.sql import functions as F

from evalmill.functions.expressions import expression_value
from evalmill.functions.text import last_boxed, strip

# The word for "answer".
ANSWER_WORDS = {
    "ar": "إجابة", "be": "адказ", "bg": "отговор", "bn": "উত্তর", "ca": "resposta", "cs": "odpověď", "da": "svar", "de": "antwort",
    "el": "απάντηση", "en": "answer", "es": "respuesta", "et": "vastus", "eu": "erantzuna", "fi": "vastaus", "fr": "réponse", "gl": "resposta",
    "gu": "જવાબ", "hi": "उत्तर", "hr": "odgovor", "hu": "válasz", "id": "jawaban", "it": "risposta", "ja": "回答", "mk": "одговор",
    "nl": "antwoord", "no": "svar", "pa": "ਜਵਾਬ", "pl": "odpowiedź", "pt": "resposta", "ro": "răspuns", "ru": "ответ", "sk": "odpoveď",
    "sr": "одговор", "sv": "svar", "sw": "jibu", "ta": "பதில்", "te": "జవాబు", "th": "คำตอบ", "tl": "sagot", "tr": "cevap",
    "uk": "відповідь", "ur": "جواب", "uz": "javob", "vi": "trả lời", "zh": "答案",
}
# Full stop, comma, colon and the space between sentences, where they are not ". , :" and a blank.
MARKS = {
    "ar": (".", "،", ":", " "), "bn": ("।", ",", ":", " "), "gu": ("।", ",", ":", " "), "hi": ("।", ",", ":", " "), "ja": ("。", "、", "：", ""),
    "pa": ("।", ",", ":", " "), "ta": ("।", ",", ":", " "), "ur": ("۔", "،", ":", " "), "zh": ("。", "，", "：", ""),
}
# Numbers, percent signs, currencies and expressions.
NUMBER = r"-?\d{1,3}(?:[ ,]\d{3})+(?:\.\d+)?|-?\d+[.,]\d+|\.\d+|-?\d+"
PERCENT = r"\s*(?:%|[Pp]ercent|\s*[Pp]ercentage|\s*[Pp]ct)"
CURRENCY = "[$€£¥₹₽₪₩₫฿₡₢₣₤₥₦₧₨₭₮₯₰₱₲₳₴₵₶₷₸₺₻₼₾₿]"
EXPRESSION = r"-?\(?-?\d[\d.\s+\-*×/^()÷]*[+\-*×/^()÷][\d.\s+\-*×/^()÷]+\)?"
# Places of a number ({v}: the value with what stands around it), best first; "en" marks English phrases.
NUMBER_PLACES = (
    ("en", r"(?i:final answer is):?\s*{v}\.?\s?I hope"),
    ("en", r"(?i:final answer.{0,100}?)\s+is:?{v}"),
    ("", r"(?i:{answer})\s?{colon}(?:.{0,100}=\s*|.{0,50}?){v}(?!\s*=)"),
    ("", r"(?i:{answer})(?:.{0,100}=\s*|.{0,50}?){v}(?!\s*=)"),
    ("", "{v}"),
)
# Places of a letter ({ix}: the letter, maybe in brackets; {end}: what follows it), best first.
LETTER_PLACES = (
    ("en", r"(?i:final answer is):?\s*{ix}\.?\s?I hope"),
    ("en", r"(?i:final answer.{0,100}?)\s+is:?\s*{ix}"),
    ("", r"(?i:{answer})\s?{colon}.{0,50}?(?:^|{space})(?:\*\*)?{ix}{end}"),
    ("", r"(?i:{answer}).{0,50}?(?:^|{space})(?:\*\*)?{ix}{end}"),
    ("", r"^(?:\*\*)?{ix}{end}"),
    ("", r"\n(?:\*\*)?{ix}{end}"),
    ("", r"(?:^|{space})(?:\*\*)?{ix}{end}"),
    ("", "{ix}"),
)
LANGUAGES = tuple(ANSWER_WORDS)


def filled(places, lang, **values):
    """The patterns of a language: its word and marks, and ``values``, put into the templates."""
    if lang not in ANSWER_WORDS:
        raise ValueError(f"no answer word for language {lang!r}; known: {', '.join(LANGUAGES)}")
    stop, comma, colon, space = MARKS.get(lang, (".", ",", ":", " "))
    either = lambda mark, ascii: mark if mark == ascii else f"[{mark}{ascii}]"
    words = {"answer": re.escape(ANSWER_WORDS[lang]), "colon": either(colon, ":"), "space": space}
    words["end"] = rf"(?:\*\*)?(?:{either(re.escape(stop), re.escape('.'))}|{either(comma, ',')}|\s?{words['colon']}|{space}|$)"
    for name, value in {**values, **words}.items():
        places = [(only, p.replace("{" + name + "}", value)) for only, p in places]
    return [p for only, p in places if only in ("", lang)]


def number_patterns(lang):
    """Patterns of a number; group 1 is an expression, else group 2 a number and group 3 its percent sign."""
    space = MARKS.get(lang, (".", ",", ":", " "))[3]
    before = rf"(?:^|\s|{space}|=)(?:\*\*)?" if space else r"(?:\*\*)?"
    value = rf"(?:{before}({EXPRESSION})(?:{{end}}|\s|\)|\$)|{before}{CURRENCY}?({NUMBER})({PERCENT})?)"
    return filled([(only, p.replace("{v}", value)) for only, p in NUMBER_PLACES], lang)


def letter_patterns(n_choices, lang):
    """Patterns of an option letter, group 1, maybe in brackets."""
    letters = "|".join(rf"{c}|\({c}\)" for c in string.ascii_uppercase[:n_choices])
    return filled(LETTER_PLACES, lang, ix=f"({letters})")


def last_group(text, pattern, group):
    """Capture of the rightmost match, NULL when the pattern does not match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.get(found, F.size(found) - 1)


def number_value(raw, percent):
    """Double value of a captured number: separators, comma decimals, percent."""
    thousands = raw.rlike(r"^-?\d{1,3}(?:[ ,]\d{3})+(?:\.\d+)?\z")
    clean = F.when(thousands, F.regexp_replace(raw, "[ ,]", "")).otherwise(F.translate(raw, ",", "."))
    value = clean.try_cast("double")
    return F.when(F.coalesce(percent, F.lit("")) != "", value / 100).otherwise(value)


def _by_language(extract, lang, languages):
    """``extract`` of a language given by name, or by a Column; a row is read with its own language only."""
    if isinstance(lang, str):
        return extract(lang)
    out = F
    for code in languages or LANGUAGES:
        out = out.when(lang == code, extract(code))
    return out


def extract_number(text, lang="en", languages=None):
    """Value of the best number or expression in the text, NULL when there is none.

    ``lang`` is a language code, or a Column of them; ``languages`` names those that occur.
    """

    def extract(code):
        values = []
        for pattern in number_patterns(code):
            expression = last_group(text, pattern, 1)
            number = number_value(last_group(text, pattern, 2), last_group(text, pattern, 3))
            values.append(F.when(F.coalesce(expression, F.lit("")) != "", expression_value(expression)).otherwise(number))
        plain = rf"(?:^|\s|=)(?:\*\*)?{CURRENCY}?({NUMBER})({PERCENT})?"
        return F.coalesce(*values, number_value(last_group(text, plain, 1), last_group(text, plain, 2)))

    return _by_language(extract, lang, languages)


def extract_choice_letter(text, n_choices, lang="en", languages=None):
    """Best option letter in the text, NULL when there is none; ``lang`` as for numbers."""

    def extract(code):
        return F.translate(F.coalesce(*[last_group(text, p, 1) for p in letter_patterns(n_choices, code)]), "()", "")

    return _by_language(extract, lang, languages)


# Forms of a math environment, with their marks of one or two characters.
MATH_ENVIRONMENTS = (
    r"(?<!\\)\$\$(?:[^$]|\$(?!\$))+?(?<!\\)\$\$",
    r"(?<!\\)\\\[(?:[^\\]|\\(?!\]))+?(?<!\\)\\\]",
    r"(?<!\\|\d)\$(?:\\[$]|[^\n$])+?(?<!\\)\$",
    r"(?<!\\)\\\((?:[^\\\n]|\\(?!\)))+?(?<!\\)\\\)",
)


def extract_latex_string(text):
    """Last boxed content, else the math environment that ends last, else a fraction; NULL when there is none."""
    boxed = F.nullif(last_boxed(text), F.lit(""))
    whole = last_group(text, "(?s)(" + "|".join(MATH_ENVIRONMENTS) + ")", 1)
    wide = ~whole.startswith("$") | whole.startswith("$$")
    mark = F.when(wide, 2).otherwise(1)
    inside = F.substr(whole, mark + 1, F.length(whole) - 2 * mark)
    fraction = last_group(text, r"(-?\\frac\{-?\d+(?:[.,]\d+)?\}\{-?\d+(?:[.,]\d+)?\})", 1)
    return F.coalesce(boxed, inside, fraction)


def with_fallback(values, raw=None):
    """First non-null of the extractions in priority order, then the raw string."""
    return F.coalesce(*values, *([raw] if raw is not None else []))


def numeric_equal(a, b, precision=6):
    """Text answers equal: as numbers rounded to ``precision``, percent aware, else as trimmed text."""

    def value(x):
        plain = strip(x)
        is_number = plain.rlike(r"^-?(?:\d{1,3}(?:[ ,]\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?|\.\d+)\s*%?\z")
        digits = F.regexp_replace(plain, r"\s*%\z", "")
        return F.when(is_number, number_value(digits, F.when(plain.endswith("%"), "%")))

    va, vb = value(a), value(b)
    as_text = (strip(a) == strip(b)) & (strip(a) != "")
    return F.when(va.isNotNull() & vb.isNotNull(), F.bround(va, precision) == F.bround(vb, precision)).otherwise(as_text)
