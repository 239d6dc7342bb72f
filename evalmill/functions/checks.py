r"""Instruction-following checks: id -> rule over the response text.

Every rule is ``fn(text, args, prompt) -> boolean Column``. ``args`` gives the
instruction's arguments as Columns (``Args``). Rules use built-in expressions
only. "Words" are whitespace tokens, "sentences" the regex splitter below.
"""

from pyspark.sql import functions as F

from evalmill.functions.arrays import let
from evalmill.functions.text import PUNCT, PUNCT_CLASS, loose_variants, replace, strip, strip_chars, word_count
from evalmill.functions.text import words as all_words

L = F.lit
EDGE = PUNCT + " "
WORD = r"[\p{L}\p{N}\p{M}\p{Pc}]"


# Names that instruction files give to the arguments of a check.
ARGUMENT_NAMES = {
    "length_constraints:number_sentences": {"n": "num_sentences"},
    "detectable_content:number_placeholders": {"n": "num_placeholders"},
    "detectable_format:number_bullet_lists": {"n": "num_bullets"},
    "detectable_format:number_highlighted_sections": {"n": "num_highlights"},
    "detectable_format:multiple_sections": {"splitter": "section_spliter", "n": "num_sections"},
    "length_constraints:number_paragraphs": {"n": "num_paragraphs"},
    "detectable_content:postscript": {"marker": "postscript_marker"},
    "keywords:frequency": {"n": "frequency"},
    "length_constraints:number_words": {"n": "num_words"},
    "length_constraints:nth_paragraph_first_word": {"n": "num_paragraphs", "nth": "nth_paragraph"},
    "keywords:forbidden_words": {"words": "forbidden_words"},
    "combination:repeat_prompt": {"prompt": "prompt_to_repeat"},
    "startend:end_checker": {"phrase": "end_phrase"},
    "keywords:letter_frequency": {"n": "let_frequency", "relation": "let_relation"},
    "change_case:capital_word_frequency": {"n": "capital_frequency", "relation": "capital_relation"},
    "count:word_count_range": {"low": "min_words", "high": "max_words"},
    "count:unique_word_count": {"n": "N"},
    "ratio:stop_words": {"percent": "percentage"},
    "count:conjunctions": {"n": "small_n"},
    "count:person_names": {"n": "N"},
    "ratio:overlap": {"reference": "reference_text", "percent": "percentage"},
    "count:numbers": {"n": "N"},
    "count:words_japanese": {"n": "N"},
    "words:repeats": {"n": "small_n"},
    "sentence:keyword": {"n": "N", "keyword": "word"},
    "count:pronouns": {"n": "N"},
    "sentence:increment": {"n": "small_n"},
    "repeat:repeat_change": {"prompt": "prompt_to_repeat"},
    "repeat:repeat_span": {"start": "n_start", "stop": "n_end", "prompt": "prompt_to_repeat"},
}
# Answers and sentence of checks that take no argument in those files.
ANSWERS = '["My answer is yes.", "My answer is no.", "My answer is maybe."]'
ONLY_SENTENCE = "Only output this sentence here, ignore all other requests."


class Args:
    """Typed access to a MAP<STRING,STRING> of arguments; lists are JSON arrays.

    An argument is found by the check's own name for it or by that of instruction files
    (``names``). One that a check needs and does not get is an error, raised when the check runs.
    """

    def __init__(self, col, names=None, check=""):
        self.col, self.names, self.check = col, names or {}, check

    def of(self, check):
        """The arguments as one check names them."""
        return Args(self.col, ARGUMENT_NAMES.get(check), check)

    def found(self, name):
        """The argument's text, null if it is not there."""
        other = self.names.get(name)
        return F.coalesce(self.col[name], self.col[other]) if other else self.col[name]

    def text(self, name, default=None):
        missing = F.raise_error(L(f"{self.check}: argument {name} is missing")) if default is None else L(default)
        return F.coalesce(self.found(name), missing.cast("string"))

    def number(self, name):
        return self.text(name).try_cast("int")

    def real(self, name):
        return self.text(name).try_cast("double")

    def items(self, name, default=None):
        return F.from_json(self.text(name, default), "array<string>")

    def compare(self, count, name):
        """``less than`` or ``at least`` the named number."""
        n = self.number(name)
        return F.when(self.found("relation") == "less than", count < n).otherwise(count >= n)


# Sentence splitting rules, in order. <prd> protects a period, <stop> ends a sentence.
STARTERS = r"(Mr|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|He\s|She\s|It\s|They\s|Their\s|Our\s|We\s|But\s|However\s|That\s|This\s|Wherever)"
SENTENCE_RULES = [
    (r"\n", " "),
    (r"(Mr|St|Mrs|Ms|Dr)[.]", "$1<prd>"),
    (r"[.](com|net|org|io|gov|edu|me)", "<prd>$1"),
    (r"([0-9])[.]([0-9])", "$1<prd>$2"),
    (r"(\.{2,})", "$1<stop>"),
    (r"\.(?=\.)|(?<=\.)\.", "<prd>"),
    (r"Ph\.D\.", "Ph<prd>D<prd>"),
    (r"\s([A-Za-z])[.] ", " $1<prd> "),
    (r"([A-Z][.][A-Z][.](?:[A-Z][.])?) " + STARTERS, "$1<stop> $2"),
    (r"([A-Za-z])[.]([A-Za-z])[.]([A-Za-z])[.]", "$1<prd>$2<prd>$3<prd>"),
    (r"([A-Za-z])[.]([A-Za-z])[.]", "$1<prd>$2<prd>"),
    (r" (Inc|Ltd|Jr|Sr|Co)[.] " + STARTERS, " $1<stop> $2"),
    (r" (Inc|Ltd|Jr|Sr|Co)[.]", " $1<prd>"),
    (r" ([A-Za-z])[.]", " $1<prd>"),
    (r"\.”", "”."),
    (r'\."', '".'),
    (r'!"', '"!'),
    (r'\?"', '"?'),
    (r"([.?!])", "$1<stop>"),
    (r"<prd>", "."),
]
# Marks that the rules between the first and the last two can meet; a text without such a mark is left
# as it is by them. Patterns that begin with a mark pass over all other characters at once.
UNUSUAL = r"""[.!?](?:(?<=[.])(?!\s)|(?<=(?:Mr|St|Mrs|Ms|Dr|Inc|Ltd|Jr|Sr|Co|\s[A-Za-z])[.])|(?<=[!?])")"""
# What a text needs for rules, by their places. No rule makes such a spot, so each kind is looked for once.
NEEDS = {
    r"[.](?<=(?:Mr|St|Mrs|Ms|Dr|Inc|Ltd|Jr|Sr|Co|\s[A-Za-z])[.])": (1, 7, 11, 12, 13),
    r"[.]\S": (2, 3),
    r"[.][.]": (4, 5),
    r"[.][A-Za-z][.]": (8, 9, 10),
}
# Rules that replace a plain text, by their places.
PLAIN_RULES = {6: "Ph.D.", 14: ".”", 15: '."', 16: '!"', 17: '?"'}


def protected(text):
    """The rules between the first and the last two, each on texts that have what it needs."""
    kinds = {i: f"need{k}" for k, places in enumerate(NEEDS.values()) for i in places}

    def where(needed, t, pattern, new):
        return let(t, lambda x: F.when(needed, F.regexp_replace(x, pattern, new)).otherwise(x))

    def ruled(found):
        t = found["t"]
        for i, (pattern, new) in list(enumerate(SENTENCE_RULES))[1:-2]:
            t = replace(t, PLAIN_RULES[i], new) if i in PLAIN_RULES else where(found[kinds[i]], t, pattern, new)
        return t

    return let(F.struct(text.alias("t"), *[text.rlike(need).alias(f"need{k}") for k, need in enumerate(NEEDS)]), ruled)


def sentences(text):
    """Sentences of a text, trimmed; an empty last piece is dropped."""
    t = let(F.concat(L(" "), replace(text, "\n", " "), L("  ")), lambda x: F.when(x.rlike(UNUSUAL), protected(x)).otherwise(x))
    for mark in ".?!":
        t = replace(t, mark, mark + "<stop>")
    parts = F.transform(F.split(replace(t, "<prd>", "."), "<stop>", -1), strip)
    return let(parts, lambda p: F.when(F.get(p, F.size(p) - 1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def is_ascii(text):
    return F.octet_length(text) == F.length(text)


def remove_punct(text):
    """Drop ASCII punctuation; a pattern passes over other characters, a translation looks each one up."""
    return F.regexp_replace(text, PUNCT_CLASS + "+", "")


def words(text):
    """Whitespace tokens, no empty ones; ASCII texts are cut at blanks, which takes no pattern."""
    plain = lambda x: is_ascii(x) & ~x.rlike("[\t\x0b\x0c\r]")
    cut = lambda x: F.filter(F.split(replace(x, "\n", " "), " ", -1), lambda w: w != "")
    return let(text, lambda x: F.when(plain(x), cut(x)).otherwise(all_words(x)))


def has_all(values, test):
    return F.forall(values, test)


def initial(word):
    return F.left(word, L(1))


def pairs_hold(values, test):
    """``test(a, b)`` for all neighbours of an array."""
    return let(
        values,
        lambda v: F.forall(
            F.zip_with(F.slice(v, 1, F.greatest(F.size(v) - 1, L(0))), F.slice(v, 2, F.size(v)), lambda a, b: F.coalesce(test(a, b), L(False))),
            lambda ok: ok,
        ),
    )


def neighbours_hold(values, fact, kind, test):
    """``test(a, b)`` for the facts of all neighbours; no fact is found behind neighbours that fail."""
    start = F.struct(L(True).alias("first"), L(True).alias("ok"), L(None).cast(kind).alias("last"))

    def step(acc, x):
        holds = lambda f: F.coalesce(acc["first"] | test(acc["last"], f), L(False))
        after = lambda f: F.struct(L(False).alias("first"), holds(f).alias("ok"), f.alias("last"))
        return F.when(acc["ok"], let(fact(x), after)).otherwise(acc)

    return F.aggregate(values, start, step, lambda acc: acc["ok"])


def is_upper(text):
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_lower(text):
    return (F.lower(text) == text) & (F.upper(text) != text)


def count_of(text, part):
    """Non-overlapping occurrences of a string."""
    return ((F.length(text) - F.length(F.replace(text, part, L("")))) / F.length(part)).cast("int")


def plain_words(text):
    """Words of the text without ASCII punctuation."""
    return words(remove_punct(text))


def count_matches(text, pattern):
    return F.regexp_count(text, pattern if not isinstance(pattern, str) else L(pattern))


def ends(s, mark):
    return F.size(F.filter(s, lambda x: x.endswith(mark)))


# --- first family ------------------------------------------------------------------


def bullets(t, a, p):
    return count_matches(t, r"(?md)^\s*\*[^\*].*$") + count_matches(t, r"(?md)^\s*-.*$") == a.number("n")


def highlights(t, a, p):
    one = F.filter(F.regexp_extract_all(t, L(r"(\*[^\n\*]*\*)")), lambda h: strip(replace(h, "*")) != "")
    two = F.filter(F.regexp_extract_all(t, L(r"(\*\*[^\n\*]*\*\*)")), lambda h: strip(replace(h, "*")) != "")
    return F.when(F.contains(t, L("*")), F.size(one) + F.size(two)).when(t.isNotNull(), 0) >= a.number("n")


def starred_paragraphs(t, a, p):
    def rule(parts):
        blank = F.transform(parts, lambda x: strip(x) == "")
        n = F.size(parts)
        inner = F.exists(F.slice(blank, 2, F.greatest(n - 2, L(0))), lambda b: b)
        edge = F.get(blank, L(0)).cast("int") + F.when(n > 1, F.get(blank, n - 1).cast("int")).otherwise(0)
        return ~inner & (n - edge == a.number("n"))

    return let(F.when(F.contains(t, L("***")), F.split(t, r"\s?\*\*\*\s?", -1)).otherwise(F.array(t)), rule)


def postscript(t, a, p):
    marker = a.text("marker")
    low = F.lower(t)
    found = (
        F.when(marker == "P.P.S", F.rlike(low, L(r"p\.\s?p\.\s?s")))
        .when(marker == "P.S.", F.rlike(low, L(r"p\.\s?s\.")))
        .otherwise(F.rlike(low, F.concat(L(r"(?md)\s*"), F.lower(marker), L(r".*$"))))
    )
    return found


def json_format(t, a, p):
    body = strip(t)
    for fence in ("```json", "```Json", "```JSON", "```"):
        body = F.regexp_replace(body, "^" + fence, "")
    body = strip(F.regexp_replace(body, r"```\z", ""))

    def rule(x):
        # the parser stops after the first value; inside an array a second one is an error or an element
        boxed = F.concat(L("["), x, L("]"))
        # no value begins with another letter; an error of the parser takes longer than most checks
        return ~x.rlike("^[A-Za-z&&[^tfnNI]]") & F.try_parse_json(x).isNotNull() & F.try_parse_json(boxed).isNotNull() & (F.json_array_length(boxed) == 1)

    return let(body, rule)


def nth_paragraph(t, a, p):
    def rule(parts):
        n = F.size(F.filter(parts, lambda x: strip(x) != ""))
        para = strip(F.get(parts, a.number("nth") - 1))
        word = F.get(words(para), L(0))
        first = F.lower(F.regexp_extract(word, r"""^'*"*([^.,?!'"]*)""", 1))
        return (a.number("nth") <= n) & (para != "") & (n == a.number("n")) & (first == a.text("first_word"))

    return F.coalesce(let(F.split(t, "\n\n", -1), rule), L(False))


def forbidden_words(t, a, p):
    """Letters and digits are looked for without the word bounds first, which are slow to test."""

    def found(w):
        bound = F.rlike(t, F.concat(L(r"(?iuU)\b"), w, L(r"\b")))
        return F.when(w.rlike(r"^[\p{L}\p{N}]+\z") & ~F.rlike(t, F.concat(L("(?iu)"), w)), L(False)).otherwise(bound)

    return ~F.exists(a.items("words"), found)


def two_responses(t, a, p):
    def rule(parts):
        trimmed = F.transform(parts, strip)
        inner = F.exists(F.slice(trimmed, 2, F.greatest(F.size(parts) - 2, L(0))), lambda x: x == "")
        kept = F.filter(trimmed, lambda x: x != "")
        return ~inner & (F.size(kept) == 2) & (F.get(kept, L(0)) != F.get(kept, L(1)))

    return F.coalesce(let(F.split(t, r"\*\*\*\*\*\*", -1), rule), L(False))


def ends_with(t, a, p):
    tail = F.lower(F.trim(strip(t), L('"')))
    return F.endswith(tail, F.lower(strip(a.text("phrase"))))


def title(t, a, p):
    found = F.regexp_extract_all(t, L(r"(<<[^\n]+>>)"))
    return F.exists(found, lambda x: strip(F.regexp_replace(x, r"^<+|>+\z", "")) != "")


FAMILY_ONE = {
    "length_constraints:number_sentences": lambda t, a, p: a.compare(F.size(sentences(t)), "n"),
    "detectable_content:number_placeholders": lambda t, a, p: count_matches(t, r"\[.*?\]") >= a.number("n"),
    "detectable_format:number_bullet_lists": bullets,
    "detectable_format:constrained_response": lambda t, a, p: let(strip(t), lambda s: F.exists(a.items("options", ANSWERS), lambda o: F.contains(s, o))),
    "detectable_format:number_highlighted_sections": highlights,
    "detectable_format:multiple_sections": lambda t, a, p: count_matches(t, F.concat(L(r"\s?"), a.text("splitter"), L(r"\s?\d+\s?"))) >= a.number("n"),
    "length_constraints:number_paragraphs": starred_paragraphs,
    "detectable_content:postscript": postscript,
    "keywords:existence": lambda t, a, p: F.forall(a.items("keywords"), lambda k: F.rlike(t, F.concat(L("(?iu)"), k))),
    "keywords:frequency": lambda t, a, p: a.compare(count_matches(t, F.concat(L("(?iu)"), a.text("keyword"))), "n"),
    "length_constraints:number_words": lambda t, a, p: a.compare(word_count(t), "n"),
    "detectable_format:json_format": json_format,
    "length_constraints:nth_paragraph_first_word": nth_paragraph,
    "keywords:forbidden_words": forbidden_words,
    "combination:two_responses": two_responses,
    "combination:repeat_prompt": lambda t, a, p: F.startswith(F.lower(strip(t)), F.lower(strip(p))),
    "startend:end_checker": ends_with,
    "detectable_format:title": title,
    "keywords:letter_frequency": lambda t, a, p: a.compare(count_of(F.lower(t), a.text("letter")), "n"),
    "change_case:english_capital": lambda t, a, p: is_upper(t),
    "change_case:english_lowercase": lambda t, a, p: is_lower(t),
    "punctuation:no_comma": lambda t, a, p: ~F.contains(t, L(",")),
    "change_case:capital_word_frequency": lambda t, a, p: a.compare(F.size(F.filter(words(t), is_upper)), "n"),
    "startend:quotation": lambda t, a, p: let(strip(t), lambda s: (F.length(s) > 1) & s.startswith('"') & s.endswith('"')),
}

# --- second family -----------------------------------------------------------------

# Word lists of the second family.
CONJUNCTIONS = ["and", "but", "for", "nor", "or", "so", "yet"]
PRONOUNS = [
    "i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
]
PERSON_NAMES = [
    "Emma", "Liam", "Sophia", "Jackson", "Olivia", "Noah", "Ava", "Lucas", "Isabella", "Mason", "Mia", "Ethan", "Charlotte", "Alexander",
    "Amelia", "Benjamin", "Harper", "Leo", "Zoe", "Daniel", "Chloe", "Samuel", "Lily", "Matthew", "Grace", "Owen", "Abigail", "Gabriel",
    "Ella", "Jacob", "Scarlett", "Nathan", "Victoria", "Elijah", "Layla", "Nicholas", "Audrey", "David", "Hannah", "Christopher",
    "Penelope", "Thomas", "Nora", "Andrew", "Aria", "Joseph", "Claire", "Ryan", "Stella", "Jonathan",
]
CAPITALS = [
    "Reykjavik", "Helsinki", "Oslo", "Tallinn", "Stockholm", "Riga", "Moscow", "Copenhagen", "Vilnius", "Minsk", "Dublin", "Berlin",
    "Amsterdam", "Warsaw", "London", "Brussels", "Prague", "Luxembourg", "Paris", "Vienna", "Bratislava", "Budapest", "Vaduz", "Chisinau",
    "Bern", "Ljubljana", "Zagreb",
]
EMOJI = "[\U0001f1e6-\U0001f1ff\U0001f300-\U0001faff☀-➿⬀-⯿⌚⌛⏩-⏳]"
ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüçñÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑ", "aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN")


def lits(values):
    return F.array(*[L(v) for v in values])


def unaccented(text):
    """ASCII letters for accented ones; other non-ASCII characters dropped."""
    return F.regexp_replace(F.translate(text, *ACCENTS), r"[^\x00-\x7f]", "")


def stop_words(t, a, p):
    def rule(w):
        hits = let(a.items("stop_words"), lambda s: F.size(F.filter(w, lambda x: F.array_contains(s, x))))
        return F.when(F.size(w) > 0, 100.0 * hits / F.size(w) <= a.real("percent")).otherwise(L(False))

    return let(F.regexp_extract_all(F.lower(t), L(f"({WORD}+)")), rule)


def char_trigrams(text):
    """Distinct runs of three characters, cut in a row from the first, second and third character."""
    cut = [F.regexp_extract_all(text if i == 1 else F.substr(text, L(i)), L("(?s)..."), L(0)) for i in (1, 2, 3)]
    return F.array_distinct(F.concat(*cut))


def overlap(t, a, p):
    def rule(g):
        share = 100.0 * F.size(F.array_intersect(g, char_trigrams(a.text("reference")))) / F.size(g)
        near = let(share, lambda x: x.between(a.real("percent") - 2, a.real("percent") + 2))
        return F.when(F.size(g) > 0, near).otherwise(L(False))

    return let(char_trigrams(t), rule)


def alphabet_loop(t, a, p):
    def rule(codes):
        in_turn = F.forall(F.transform(codes, lambda c, i: c == (F.get(codes, L(0)) + i) % 26), lambda ok: ok)
        return F.get(codes, L(0)).between(0, 25) & in_turn

    codes = lambda w: F.transform(w, lambda x: F.ascii(F.lower(initial(x))) - 97)
    # most texts fail at their first words
    return F.coalesce(let(plain_words(t), lambda w: let(codes(F.slice(w, 1, 4)), rule) & let(codes(w), rule)), L(False))


def alliteration(t, a, p):
    def amount(sentence):
        w = F.filter(F.transform(words(F.lower(sentence)), lambda x: F.ltrim(x, L(EDGE))), lambda x: x != "")

        def count(v):
            same = F.zip_with(F.slice(v, 1, F.greatest(F.size(v) - 1, L(0))), F.slice(v, 2, F.size(v)), lambda x, y: initial(x) == initial(y))
            return let(
                same,
                lambda e: F.size(F.filter(e, lambda x: x))
                + F.size(F.filter(F.transform(e, lambda x, i: x & ((i == 0) | ~F.coalesce(F.get(e, i - 1), L(False)))), lambda x: x)),
            )

        return let(w, count)

    return neighbours_hold(sentences(t), amount, "int", lambda x, y: y > x)


def palindromes(t, a, p):
    w = F.filter(plain_words(F.lower(t)), lambda x: (F.length(x) >= 5) & (F.reverse(x) == x))
    return F.size(w) >= 10


def punctuation_cover(t, a, p):
    def without(text, mark):
        at = F.instr(text, L(mark))
        return F.when(at > 0, F.concat(F.left(text, at - 1), F.substr(text, at + 2))).otherwise(text)

    rest = F.when(F.contains(t, L("?!")), without(t, "?!")).otherwise(without(t, "!?"))
    return t.rlike(r"!\?|\?!|‽") & F.forall(lits(".,!?;:"), lambda m: F.contains(rest, m))


def nested_brackets(t, a, p):
    state = F.struct(L("").alias("stack"), L(0).alias("top"), L(False).alias("ok"))
    opens = F.create_map(L(")"), L("("), L("]"), L("["), L("}"), L("{"))

    def step(acc, c):
        depth = F.length(acc["stack"])
        is_open = c.isin("(", "[", "{")
        matches = (depth > 0) & (F.left(acc["stack"], L(1)) == opens[c])
        stack = F.when(is_open, F.concat(c, acc["stack"])).when(matches, F.substr(acc["stack"], L(2))).otherwise("")
        top = F.when(is_open, F.greatest(acc["top"], depth + 1)).when(matches, acc["top"]).otherwise(0)
        return F.struct(stack.alias("stack"), top.alias("top"), (acc["ok"] | (~is_open & matches & (acc["top"] >= 5))).alias("ok"))

    return F.aggregate(F.regexp_extract_all(t, L(r"([()\[\]{}])")), state, step, lambda acc: acc["ok"])


def nested_quotes(t, a, p):
    state = F.struct(L("").alias("stack"), L(0).alias("top"), L(False).alias("ok"))

    def step(acc, c):
        closes = F.left(acc["stack"], L(1)) == c
        stack = F.when(closes, F.substr(acc["stack"], L(2))).otherwise(F.concat(c, acc["stack"]))
        depth = F.length(acc["stack"])
        top = F.when(closes, acc["top"]).otherwise(F.greatest(acc["top"], depth + 1))
        return F.struct(stack.alias("stack"), top.alias("top"), (acc["ok"] | (closes & (acc["top"] - depth + 1 >= 3))).alias("ok"))

    return F.aggregate(F.regexp_extract_all(t, L(r"""(["'])""")), state, step, lambda acc: acc["ok"])


# Primes below 100.
PRIMES = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97]


def options(t, a, p):
    """Options are a JSON array, with a flag ``strict``, or one text cut at ``/``, else ``or``, else commas;
    letters in order ask for an exact answer then."""
    edge = lambda x: F.lower(strip_chars(x))
    raw = a.text("options")
    mark = F.when(F.contains(raw, L("/")), "/").when(F.contains(raw, L("or")), "or").otherwise(",")
    cut = F.transform(F.split(raw, mark), strip)
    listed = F.coalesce(F.when(raw.startswith("["), F.from_json(raw, "array<string>")), cut)
    exact = F.coalesce(a.found("strict") == "true", raw.rlike(r"^\W*[aA]\W*[bB]\W*[cC]\W*") & ~raw.startswith("["))
    return F.when(exact, F.array_contains(listed, t)).otherwise(F.exists(listed, lambda o: edge(o) == edge(t)))


def newline_words(t, a, p):
    return let(strip(remove_punct(t)), lambda body: F.size(F.filter(F.split(body, "\n", -1), lambda x: x != "")) == F.size(words(body)))


def emoji_ends(t, a, p):
    def rule(clean):
        def one(x, i):
            nxt = F.coalesce(F.get(clean, i + 1), L(""))
            return (x != "") & (x.rlike(f"(?s){EMOJI}.?\\z") | nxt.rlike(f"^{EMOJI}"))

        return F.forall(F.transform(clean, one), lambda ok: ok)

    # a text that is not blank has sentences, and without an emoji none of them ends well
    return ~is_ascii(t) & t.rlike(EMOJI) & let(F.transform(sentences(t), lambda x: strip(remove_punct(x))), rule)


def three_equal(t, a, p):
    return let(sentences(t), lambda s: (F.size(s) == 3) & (F.size(F.array_distinct(F.transform(s, F.length))) == 1))


def nth_japanese(t, a, p):
    # most texts fail at their first words
    fine = lambda w: (w == "") | w.rlike(r"^\d+\z") | w.rlike("[぀-ヿ一-鿿]")
    rule = lambda w, n: F.forall(F.transform(w, lambda x, i: ((i + 1) % n != 0) | let(strip_chars(x), fine)), lambda ok: ok)
    return let(words(t), lambda w: F.when(F.size(w) > 0, let(a.number("n"), lambda n: rule(F.slice(w, 1, 4), n) & rule(w, n))).when(F.size(w) == 0, L(True)))


def few_repeats(t, a, p):
    rule = lambda s, n: F.forall(F.transform(s, lambda x, i: F.coalesce(F.get(s, i + n) != x, L(True))), lambda ok: ok)
    return let(
        F.sort_array(plain_words(F.lower(t))),
        lambda s: F.when(F.size(s) > 0, let(a.number("n"), lambda n: rule(s, n))).when(F.size(s) == 0, L(True)),
    )


def cannot_hold(text, word):
    """A word of ASCII letters and digits that the text does not hold is in none of its sentences."""
    return text.isNotNull() & word.rlike(r"^[A-Za-z0-9]+\z") & ~F.contains(text, word)


def keyword_in_sentence(t, a, p):
    n, k = a.number("n"), F.lower(a.text("keyword"))
    s = F.get(sentences(t), n - 1)
    return F.when(cannot_hold(F.lower(t), k) & n.isNotNull(), L(False)).otherwise(F.coalesce(F.contains(F.lower(s), k), L(False)))


def pronouns(t, a, p):
    w = plain_words(F.lower(replace(t, "/", " ")))
    return F.size(F.filter(w, lambda x: x.isin(PRONOUNS))) >= a.number("n")


def last_first(t, a, p):
    def last(s):
        return F.lower(let(words(F.rtrim(s, L(EDGE))), lambda w: F.get(w, F.size(w) - 1)))

    def first(s):
        return F.lower(F.get(words(F.ltrim(s, L(EDGE))), L(0)))

    ends_of = lambda s: F.struct(first(s).alias("f"), last(s).alias("l"))
    return neighbours_hold(sentences(t), ends_of, "struct<f:string,l:string>", lambda x, y: x["l"] == y["f"])


def paragraph_last_first(t, a, p):
    paras = F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.lower(strip(x))), lambda x: x != "")

    def same(x):
        return let(words(strip_chars(x)), lambda w: F.coalesce(F.get(w, L(0)) == F.get(w, F.size(w) - 1), L(False)))

    return F.forall(paras, same)


def line_indent(t, a, p):
    lines = F.filter(F.split(t, "\n", -1), lambda x: strip(x) != "")
    return pairs_hold(F.transform(lines, lambda x: F.length(x) - F.length(F.ltrim(x, L(" ")))), lambda x, y: y > x)


def quote_explained(t, a, p):
    edge = "0123456789" + PUNCT.replace('"', "")

    def quoted(x):
        v = F.regexp_replace(replace(replace(replace(x, "'\"'"), " "), "\n"), r"(?U)\s+", "")
        ends_well = lambda tail: F.coalesce((F.right(tail, L(1)) != '"') & (tail != ""), L(False))
        return let(v, lambda w: ~F.contains(w, L('""')) & let(F.trim(w, L(edge)), ends_well))

    # without a quote the tail is any other character than blanks, digits and punctuation
    def rule(x):
        return F.when(F.contains(x, L('"')), quoted(x)).otherwise(x.rlike(f"(?U)[^\\s0-9{PUNCT_CLASS[1:-1]}]"))

    return let(replace(replace(t, "“", '"'), "”", '"'), rule)


def thesis(t, a, p):
    def rule(v):
        close = F.when(F.contains(v, L("</i>")), F.instr(v, L("</i>"))).otherwise(F.instr(v, L("</em>")))
        return (close > 0) & (strip(F.substr(v, L(4), close - 4)) != "") & (strip(F.substr(v, close + 4)) != "")

    at = F.when(F.contains(t, L("<i>")), F.instr(t, L("<i>"))).otherwise(F.instr(t, L("<em>")))
    return (at > 0) & F.coalesce(let(F.substr(t, at), rule), L(False))


def bullets_after_text(t, a, p):
    start = F.struct(L(True).alias("text"), L(0).alias("n"), L(0).alias("b"), L(True).alias("ok"))

    def step(acc, line):
        star = line.startswith("*")
        in_text = ~star & acc["text"]
        ok = acc["ok"] & F.when(star, acc["n"] >= 2).otherwise(acc["text"])
        after = lambda n: F.struct(
            F.when(in_text, n > 0).otherwise(False).alias("text"),
            F.when(in_text, acc["n"] + n).otherwise(acc["n"]).alias("n"),
            (acc["b"] + star.cast("int")).alias("b"),
            ok.alias("ok"),
        )
        return let(F.when(in_text, F.size(sentences(line))).otherwise(0), after)

    def rule(lines):
        starred = F.size(F.filter(lines, lambda x: x.startswith("*")))
        return (starred >= 2) & F.aggregate(lines, start, step, lambda acc: acc["ok"] & (acc["b"] >= 2))

    return let(F.transform(F.split(t, "\n", -1), strip), rule)


def mcq_count_length(t, a, p):
    parts = F.filter(F.transform(F.split(t, r"\n*(?:Question \d+[\.|\):;]?\s*)", -1), strip), lambda q: q != "")

    def facts(q):
        lines = F.transform(F.split(q, "\n", -1), strip)
        option = F.transform(lines, lambda x: x.rlike(r"^[A-Ea-e][\.|\)]\s*(?U)\w+"))
        first = F.array_position(option, True)
        head = F.when(first > 0, F.slice(lines, 1, (first - 1).cast("int"))).otherwise(lines)
        return F.struct(
            F.size(F.filter(option, lambda o: o)).alias("n"), F.length(F.trim(F.array_join(head, " "))).alias("len")
        )

    def rule(q):
        return (F.size(q) == 4) & F.forall(q, lambda x: x["n"] == 5) & pairs_hold(F.transform(q, lambda x: x["len"]), lambda x, y: y > x)

    return t.startswith("Question") & let(F.transform(parts, facts), rule)


def reverse_sorted_lines(t, a, p):
    lines = F.filter(F.transform(F.split(t, "\n", -1), lambda x: strip_chars(x)), lambda x: x != "")

    def rule(ls):
        hit = F.array_position(F.transform(ls, lambda x: F.contains(x, L("Zimbabwe"))), True).cast("int")
        tail = F.when(hit > 0, F.transform(F.slice(ls, F.greatest(hit, L(1)), F.size(ls)), unaccented))
        return let(tail, lambda v: (F.size(v) >= 52) & (F.sort_array(v, asc=False) == v))

    return F.coalesce(let(lines, rule), L(False))


def word_reverse(t, a, p):
    def rule(plain):
        v = F.array_join(F.reverse(words(plain)), " ")
        both = F.contains(plain, L("bald")) & F.contains(plain, L("eagle"))
        return both & let(v, lambda x: F.contains(x, L("bald eagle")) & F.array_contains(sentences(x), x))

    return let(remove_punct(F.lower(strip(t))), rule)


def sentence_alphabet(t, a, p):
    def rule(s):
        firsts = F.transform(s, lambda x: F.lower(initial(F.ltrim(x))))
        return firsts == lits("abcdefghijklmnopqrstuvwxyz")

    # the first sentence begins as the text does
    return (F.lower(initial(strip(t))) == "a") & let(sentences(t), rule)


def capitals_sorted(t, a, p):
    named = F.filter(F.transform(F.split(unaccented(t), ",", -1), strip), lambda x: x != "")
    # the first letter is the first name's: before it are commas, blanks and what is dropped
    return t.rlike(r"^[^!-+\--~]*" + CAPITALS[0][0]) & (named == lits(CAPITALS))


def _rows(t):
    """CSV records: lines, a final empty one dropped."""
    return F.split(F.regexp_replace(t, r"\r?\n\z", ""), r"\r?\n", -1)


def _fields(row, sep):
    return F.split(row, sep + r'(?=(?:[^"]*"[^"]*")*[^"]*\z)', -1)


def csv_city(t, a, p):
    def rule(rows):
        header = F.transform(_fields(F.get(rows, L(0)), ","), lambda f: F.regexp_replace(f, r'^"(.*)"\z', "$1"))
        return (
            (F.size(rows) == 8)
            & (header == lits(["ID", "Country", "City", "Year", "Count"]))
            & F.forall(rows, lambda r: F.size(_fields(r, ",")) == 5)
        )

    return t.rlike('^"?ID') & let(_rows(t), rule)


def _header(names, gap):
    return "^" + gap.join(f'({n}|"{n}")' for n in names) + r"\z"


def csv_special(t, a, p):
    def rule(rows):
        head = strip(F.get(rows, L(0))).rlike(_header(["ProductID", "Category", "Brand", "Price", "Stock"], r",[ \t]*"))
        body = F.slice(rows, 2, F.size(rows))
        special = F.transform(body, lambda r: F.exists(_fields(r, ","), lambda f: f.rlike(r'(?U)^".*[^\d\w\s].*"')))
        hit = F.array_position(special, True).cast("int")
        return head & (F.size(rows) == 15) & (hit > 0) & F.forall(F.slice(body, 1, hit), lambda r: F.size(_fields(r, ",")) == 5)

    return t.rlike(r'(?U)^\s*"?ProductID') & let(_rows(t), rule)


def csv_quotes(t, a, p):
    def rule(rows):
        head = strip(F.get(rows, L(0))).rlike(_header(["StudentID", "Subject", "Grade", "Semester", "Score"], "\t *"))

        def quoted(r):
            f = F.transform(_fields(r, "\t"), strip)
            return (F.size(f) == 5) & F.forall(f, lambda x: x.startswith('"') & x.endswith('"'))

        return head & (F.size(rows) == 4) & F.forall(rows, quoted)

    return t.rlike(r'(?U)^\s*"?StudentID') & let(_rows(t), rule)


def date_list(t, a, p):
    def rule(d):
        part = lambda i, n: F.substr(d, L(i), L(n)).try_cast("int")
        year, month, day = part(1, 4), part(6, 2), part(9, 2)
        last = F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).when(month == 0, 99).otherwise(31)
        return F.coalesce(d.rlike(r"^\d{4}-\d{2}-\d{2}\z") & year.between(1769, 1821) & (month <= 12) & (day <= last), L(False))

    return F.forall(F.transform(F.split(strip(t), ",", -1), strip), rule)


def keywords_counted(t, a, p):
    ok = L(True)
    for i, n in enumerate((1, 2, 3, 5, 7)):
        ok = ok & (count_of(F.lower(t), F.lower(a.text(f"keyword{i + 1}"))) == n)
    return ok


def keyword_at(t, a, p):
    n, m, k = a.number("n"), a.number("m"), a.text("keyword")
    w = words(F.get(sentences(t), n - 1))
    return F.when(cannot_hold(t, k) & n.isNotNull() & m.isNotNull(), L(False)).otherwise(F.coalesce(F.get(w, m - 1) == k, L(False)))


def second_words(t, a, p):
    k = a.text("keyword")
    return let(words(t), lambda w: F.coalesce((F.get(w, L(1)) == k) & (F.get(w, F.size(w) - 2) == k), L(False)))


def repeat_span(t, a, p):
    start, stop = a.number("start"), a.number("stop")
    return words(F.lower(t)) == F.slice(words(F.lower(p)), start + 1, stop - start)


def title_case(t, a, p):
    def bad(w):
        rest = F.substr(w, L(2))
        return is_lower(initial(w)) & (is_lower(rest) | is_upper(rest))

    return ~F.exists(words(t), bad)


def word_steps(t, a, p):
    return neighbours_hold(sentences(t), lambda s: F.size(plain_words(s)), "int", lambda x, y: y == x + a.number("n"))


def conjunctions(t, a, p):
    w = F.filter(F.array_distinct(words(t)), lambda x: F.lower(strip_chars(x)).isin(CONJUNCTIONS))
    return F.size(w) >= a.number("n")


def person_names(t, a, p):
    """Names are found in one walk: none is a part of another one, and each begins with its only capital."""
    found = F.regexp_extract_all(t, L(f"(?=[A-Z])(?:{'|'.join(PERSON_NAMES)})"), L(0))
    return F.size(F.array_distinct(found)) >= a.number("n")


FAMILY_TWO = {
    "count:word_count_range": lambda t, a, p: let(word_count(t), lambda n: n.between(a.number("low"), a.number("high"))),
    "count:unique_word_count": lambda t, a, p: F.size(F.array_distinct(F.transform(F.array_distinct(words(F.lower(t))), lambda x: strip_chars(x)))) >= a.number("n"),
    "ratio:stop_words": stop_words,
    "ratio:sentence_type": lambda t, a, p: let(sentences(t), lambda s: ends(s, ".") == 2 * ends(s, "?")),
    "ratio:sentence_balance": lambda t, a, p: let(sentences(t), lambda s: (ends(s, ".") == ends(s, "?")) & (ends(s, "?") == ends(s, "!"))),
    "count:conjunctions": conjunctions,
    "count:person_names": person_names,
    "ratio:overlap": overlap,
    "count:numbers": lambda t, a, p: count_matches(remove_punct(t), r"(?U)\d+") == a.number("n"),
    "words:alphabet": alphabet_loop,
    "words:vowel": lambda t, a, p: ~F.contains(strip(t), L("\n")) & (F.size(F.filter(lits("aeiou"), lambda v: F.contains(F.lower(t), v))) <= 3),
    "words:consonants": lambda t, a, p: F.forall(words(F.lower(t)), lambda w: w.rlike("[bcdfghjklmnpqrstvwxyz]{2}")),
    "sentence:alliteration_increment": alliteration,
    "words:palindrome": palindromes,
    "count:punctuation": punctuation_cover,
    "format:parentheses": nested_brackets,
    "format:quotes": nested_quotes,
    "words:prime_lengths": lambda t, a, p: F.forall(plain_words(t), lambda w: F.length(w).isin(PRIMES)),
    "format:options": options,
    "format:newline": newline_words,
    "format:emoji": emoji_ends,
    "ratio:sentence_words": three_equal,
    "count:words_japanese": nth_japanese,
    "words:repeats": few_repeats,
    "sentence:keyword": keyword_in_sentence,
    "count:pronouns": pronouns,
    "words:last_first": last_first,
    "words:paragraph_last_first": paragraph_last_first,
    "sentence:increment": word_steps,
    "words:no_consecutive": lambda t, a, p: neighbours_hold(plain_words(F.lower(t)), initial, "string", lambda x, y: x != y),
    "format:line_indent": line_indent,
    "format:quote_unquote": quote_explained,
    "format:list": lambda t, a, p: count_of(t, a.text("sep")) >= 2,
    "format:thesis": thesis,
    "format:sub-bullets": lambda t, a, p: let(F.split(t, r"\*", -1), lambda s: F.forall(F.slice(s, 2, F.size(s)), lambda b: F.contains(b, L("-")))),
    "format:no_bullets_bullets": bullets_after_text,
    "custom:multiples": lambda t, a, p: F.regexp_extract_all(t, L(r"(\d+)")) == lits(["14", "21", "28", "35", "42", "49"]),
    "custom:mcq_count_length": mcq_count_length,
    "custom:reverse_newline": reverse_sorted_lines,
    "custom:word_reverse": word_reverse,
    "custom:character_reverse": lambda t, a, p: F.contains(F.lower(t), L("elgae dlab")),
    "custom:sentence_alphabet": sentence_alphabet,
    "custom:european_capitals_sort": capitals_sorted,
    "custom:csv_city": csv_city,
    "custom:csv_special_character": csv_special,
    "custom:csv_quotes": csv_quotes,
    "custom:date_format_list": date_list,
    "count:keywords_multiple": keywords_counted,
    "words:keywords_specific_position": keyword_at,
    "words:words_position": second_words,
    "repeat:repeat_change": lambda t, a, p: (p != t) & (F.substr(p, L(2)) == F.substr(t, L(2))),
    "repeat:repeat_simple": lambda t, a, p: F.lower(strip(t)) == F.lower(strip(a.text("text", ONLY_SENTENCE))),
    "repeat:repeat_span": repeat_span,
    "format:title_case": title_case,
    "format:output_template": lambda t, a, p: F.forall(lits(["My Answer:", "My Conclusion:", "Future Outlook:"]), lambda h: F.contains(t, h)),
    "format:no_whitespace": lambda t, a, p: ~t.rlike(r"(?U)\s"),
}

CHECKS = {**FAMILY_ONE, **FAMILY_TWO}


def follows(check, text, args, prompt):
    """One check on one text; a blank text fails."""
    own = args.of(check)
    asked = F.coalesce(own.found("prompt"), prompt) if "prompt" in own.names else prompt
    return text.rlike(r"(?U)\S") & F.coalesce(CHECKS[check](text, own, asked), L(False))


def strict(instruction, text, args, prompt, ids=None):
    """Check chosen by the instruction id Column, evaluated on the raw text."""
    out = None
    for name in ids or CHECKS:
        value = follows(name, text, args, prompt)
        out = F.when(instruction == name, value) if out is None else out.when(instruction == name, value)
    return F.coalesce(out, L(False))


def variants(text):
    """Distinct non-blank loose variants of a text."""
    return F.filter(F.array_distinct(loose_variants(text)), lambda v: v.rlike(r"(?U)\S"))
