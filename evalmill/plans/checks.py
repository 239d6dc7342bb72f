"""Instruction checks: one query per check, and the strict / loose reports.

Responses are all documents plus short texts built from every part, shaped so
that each check has followers and offenders.
"""

import json

from pyspark.sql import functions as F

from evalmill.functions import checks as ck
from evalmill.functions.arrays import r6
from evalmill.functions.text import PUNCT
from evalmill.operators import instructions as ins
from evalmill.plans import fixtures as fx
from evalmill.plans.registry import query, view

CITY = "ID,Country,City,Year,Count\n" + "\n".join(f"{i},X,{{name}},19{i}0,{{size}}" for i in range(1, 8))
SPECIAL = "ProductID,Category,Brand,Price,Stock\n" + "\n".join(f'{i},c,"b & {{name}}",1,2' for i in range(1, 15))
QUOTED = "\n".join("\t".join(f'"{x}"' for x in row) for row in (["StudentID", "Subject", "Grade", "Semester", "Score"], *[["1", "m", "A", "2", "{size}"]] * 3))
ALPHABET = " ".join(f"{chr(65 + i)}x ran." for i in range(26))
MCQ = "\n".join(f"Question {i}: {'why ' * i}{{name}}\nA. a\nB. b\nC. c\nD. d\nE. e" for i in range(1, 5))
COUNTRIES = "\n".join(["Zimbabwe"] + [f"Land {c}{d}" for c in "ZYXWVU" for d in "987654321"])
# Fixture texts; {name} and {size} are filled from the part.
TEXTS = [
    "{name} one. {name} two? {name} three!", "[{name}] and [{size}] here, [x]", "* {name}\n* second\n- third {size}", "My answer is yes.",
    "*{name}* and **{size}** bold *x*", "Section 1 {name} Section 2 {size}", "{name} *** second {size} *** third", "Text about {name}.\nP.S. also {size}",
    '{"size": {size}, "name": "{name}"}', "```json\n[1, {size}]\n```", "First {name} line.\n\nSecond, {size} line.", "{name} a******{name} b",
    "Tell me about {name}. It is {size}.", "All done with {name}. Thanks a lot!", "<<{name}>> body {size}", "ALL CAPS HERE {size}", "all small here {size}",
    '"{name} quoted"', "Apple bear cat dog", "level radar civic rotor kayak refer madam tenet stats solos {size}", "What?! Yes, no; ok: done. Hi! Who? {name}",
    "((([[{x}]]))) {size}", "\"a 'b \"c\" d' e\" {name}", "to be or not {name}", "word\nother\n{size}", "Hello {name} 😀. Bye {size} 🎉", "abc def. ghi jkl. mno pqr.",
    "one 日本 two 語 three", "the the the {name} the the", "I told him that she and they saw it, {name}.", "Go to the end. End is far. Far away.", "red {name} red",
    "One two. One two three. One two three four.", "a\n b\n  c {name}", 'He said "{name}" which means so. ', "-> {name} -> {size}", "<i>{name}</i> follows {size}",
    "* {name} - sub * other - sub", "First one. Second {name}.\n* a\n* b", "14, 21, 28, 35, 42, 49", "eagle bald the is it", "it is the elgae dlab {size}",
    ", ".join(ck.CAPITALS), CITY, SPECIAL, QUOTED, "1800-05-02, 1805-12-02", "1900-01-{size}, 1800-02-30",
    "alpha " + "beta " * 2 + "gamma " * 3 + "delta " * 5 + "omega " * 7 + "{name}", "x key y {size} key z", "Xell me about {name}", "Only output THIS sentence",
    "about {name}", "Title Case {size} Only", "My Answer: {name} My Conclusion: x Future Outlook: y", "no_space_{size}", ALPHABET, MCQ, COUNTRIES,
    "Emma and Liam met Noah, or so {name} but not", "Wow! Really? Yes. {name} {size}",
]


def sql_text(s):
    return "'" + s.replace("'", "''") + "'"


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
Q = sql_text(PUNCT)
EDGE = sql_text(PUNCT + " ")


def split_sql(text):
    """SQL: a text with <stop> behind each sentence."""
    out = f"' ' || {text} || '  '"
    for pattern, new in ck.SENTENCE_RULES:
        if "(?=" in pattern:
            out = rf"regexp_replace(regexp_replace({out}, '\.\.', '<prd><prd>', 'g'), '<prd>\.(<stop>)', '<prd><prd>\1', 'g')"
        else:
            out = f"regexp_replace({out}, {sql_text(pattern)}, {sql_text(new.replace('$', chr(92)))}, 'g')"
    return out


view(
    "raw_resp",
    f"""
    SELECT 'd' || doc_id AS rid, doc_id AS k, text AS t, 'Tell me about ' || lang AS p FROM documents
    UNION ALL SELECT 'p' || p_partkey, p_partkey, replace(replace([{", ".join(sql_text(x) for x in TEXTS)}][1 + p_partkey % {len(TEXTS)}], '{{name}}', p_name), '{{size}}', CAST(p_size AS VARCHAR)), 'Tell me about ' || p_name FROM part
    """,
)

def resp_sql(source):
    """The texts of a table with their words and sentences."""
    return f"""
    SELECT *, {WORDS.format('t')} AS w, {WORDS.format(f"translate(t, {Q}, '')")} AS nw, {WORDS.format(f"translate(lower(t), {Q}, '')")} AS lw,
           {STRIP.format('t')} AS tr, translate(t, {Q}, '') AS nt,
           CASE WHEN s0[len(s0)] = '' THEN s0[1:len(s0) - 1] ELSE s0 END AS s
    FROM (SELECT *, list_transform(string_split({split_sql('t')}, '<stop>'), lambda x: {STRIP.format('x')}) AS s0 FROM {source})
    """


def lists_sql(source):
    """The same with per-sentence and per-line lists, for rules over neighbours."""
    return f"""
    SELECT *, list_transform(s, lambda x: len({WORDS.format(f"translate(x, {Q}, '')")})) AS sw,
           list_transform(lw, lambda x: left(x, 1)) AS ini,
           list_transform(s, lambda x: lower({WORDS.format(f'ltrim(x, {EDGE})')}[1])) AS firsts,
           list_transform(s, lambda x: lower({WORDS.format(f'rtrim(x, {EDGE})')}[-1])) AS lasts,
           list_transform(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> ''), lambda x: length(x) - length(ltrim(x, ' '))) AS ind,
           list_transform(s, lambda x: {STRIP.format(f"translate(x, {Q}, '')")}) AS cl,
           list_transform(s, lambda y: list_transform(list_filter(list_transform({WORDS.format('lower(y)').replace('lambda x: x', 'lambda z: z')}, lambda v: ltrim(v, {EDGE})), lambda v: v <> ''), lambda v: left(v, 1))) AS si,
           list_transform(list_transform(string_split(t, chr(10)), lambda x: {STRIP.format('x')}), lambda x: {{'x': x, 'p': list_transform(string_split({split_sql('x')}, '<stop>'), lambda y: {STRIP.format('y')})}}) AS ln
    FROM {source}
    """


view("resp", resp_sql("raw_resp"))
view("resp_lists", lists_sql("resp"))


def responses(spark, sf_dir):
    """(rid, k, t, p): id, number, text and prompt of every response."""
    fill = F.replace(F.replace(F.get(ck.lits(TEXTS), (F.col("p_partkey") % len(TEXTS)).cast("int")), F.lit("{name}"), F.col("p_name")), F.lit("{size}"), F.col("p_size").cast("string"))
    ask = lambda c: F.concat(F.lit("Tell me about "), F.col(c))
    docs = fx.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("rid"), F.col("doc_id").alias("k"), F.col("text").alias("t"), ask("lang").alias("p"))
    parts = fx.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("rid"), F.col("p_partkey").alias("k"), fill.alias("t"), ask("p_name").alias("p"))
    # Small files hold much work a row: more tasks than files, and more than cores, as texts differ in length.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return docs.unionByName(parts).repartition(tasks, "rid", "t")


def n_matches(pattern, col="t"):
    return f"len(regexp_extract_all({col}, {sql_text(pattern)}))"


def adjacent(values, test):
    """SQL: test over neighbours a, b of a list."""
    body = test.replace("{a}", f"({values})[i]").replace("{b}", f"({values})[i + 1]")
    return f"len(list_filter(range(1, len({values})), lambda i: NOT coalesce({body}, false))) = 0"


def every(values, test):
    return f"len(list_filter({values}, lambda v: NOT coalesce({test}, false))) = 0"


def some(values, test):
    return f"len(list_filter({values}, lambda v: {test})) > 0"


def occurrences(text, part):
    return f"((length({text}) - length(replace({text}, {part}, ''))) / length({part}))"


def sql_list(values):
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


WORD_RE = r"[\pL\pN\pM\p{Pc}]+"
UPPER = "upper(v) = v AND lower(v) <> v"
STOPS = ["the", "a", "and", "of", "to", "is", "it"]
GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"
REF = "and the of to on en le la"
CSV_FIELDS = "string_split({}, ',')"
PARA = f"list_filter(list_transform(string_split(t, chr(10)), lambda x: lower({STRIP.format('x')})), lambda x: x <> '')"
E = ck.EMOJI
STARS = "list_transform(string_split_regex(t, '\\s?\\*\\*\\*\\s?'), lambda x: trim(x))"
SIX = f"list_transform(string_split(t, '******'), lambda x: {STRIP.format('x')})"
PARAS2 = "string_split(t, chr(10) || chr(10))"
JSON_BODY = r"trim(regexp_replace(regexp_replace(tr, '^```(json|Json|JSON)?', ''), '```$', ''))"


def folded(items, start, step):
    """SQL: a fold of a list of structs; ``start`` and ``step`` give the fields, from a (so far) and x (the next)."""
    return f"list_reduce(list_prepend({start}, {items}), lambda a, x: {step})"


EMPTY_STACK = "{'st': '', 'top': 0::BIGINT, 'ok': false, 'c': ''}"
BRACKETS = folded(
    r"list_transform(regexp_extract_all(t, '[()\[\]{}]'), lambda c: {'st': '', 'top': 0::BIGINT, 'ok': false, 'c': c})",
    EMPTY_STACK,
    """CASE WHEN x.c IN ('(', '[', '{') THEN {'st': x.c || a.st, 'top': greatest(a.top, length(a.st) + 1), 'ok': a.ok, 'c': ''}
            WHEN a.st <> '' AND left(a.st, 1) = translate(x.c, ')]}', '([{') THEN {'st': substr(a.st, 2), 'top': a.top, 'ok': a.ok OR a.top >= 5, 'c': ''}
            ELSE {'st': '', 'top': 0::BIGINT, 'ok': a.ok, 'c': ''} END""",
)
QUOTES = folded(
    """list_transform(regexp_extract_all(t, '["'']'), lambda c: {'st': '', 'top': 0::BIGINT, 'ok': false, 'c': c})""",
    EMPTY_STACK,
    """CASE WHEN left(a.st, 1) = x.c THEN {'st': substr(a.st, 2), 'top': a.top, 'ok': a.ok OR a.top - length(a.st) + 1 >= 3, 'c': ''}
            ELSE {'st': x.c || a.st, 'top': greatest(a.top, length(a.st) + 1), 'ok': a.ok, 'c': ''} END""",
)
BULLETS = folded(
    "list_transform(ln, lambda l: {'txt': true, 'n': (len(l.p) - (CASE WHEN l.p[len(l.p)] = '' THEN 1 ELSE 0 END))::BIGINT, 'b': 0::BIGINT, 'ok': true, 'star': starts_with(l.x, '*')})",
    "{'txt': true, 'n': 0::BIGINT, 'b': 0::BIGINT, 'ok': true, 'star': false}",
    """{'txt': NOT x.star AND a.txt AND x.n > 0, 'n': a.n + CASE WHEN NOT x.star AND a.txt THEN x.n ELSE 0 END, 'b': a.b + x.star::BIGINT,
        'ok': a.ok AND CASE WHEN x.star THEN a.n >= 2 ELSE a.txt END, 'star': false}""",
)
UNQUOTED = r"""regexp_replace(replace(translate(t, '“”', '""'), '''"''', ''), '\s+', '', 'g')"""
TAIL = f"trim({UNQUOTED}, {sql_text('0123456789' + PUNCT.replace(chr(34), ''))})"
NO_QUOTE = f"""NOT contains({UNQUOTED}, '""') AND right({TAIL}, 1) <> '"' AND {TAIL} <> ''"""
SAME = "len(list_filter(range(1, len(q)), lambda i: q[i] = q[i + 1]{}))"
STEPS = f"list_transform(si, lambda q: {SAME.format('')} + {SAME.format(' AND (i = 1 OR q[i - 1] <> q[i])')})"
PARTS = rf"list_filter(list_transform(string_split_regex(t, '\n*(?:Question \d+[\.|\):;]?\s*)'), lambda q: {STRIP.format('q')}), lambda q: q <> '')"
LINES = f"list_transform(string_split({{}}, chr(10)), lambda l: {STRIP.format('l')})"
OPTION = r"regexp_matches(l, '^[A-Ea-e][\.|\)]\s*\w+')"
OPTIONS = f"list_transform({{}}, lambda l: {OPTION})"
MCQ_HEADS = f"""list_transform({PARTS}, lambda q: length(trim(array_to_string(
    CASE WHEN list_contains({OPTIONS.format(LINES.format('q'))}, true) THEN {LINES.format('q')}[1:list_position({OPTIONS.format(LINES.format('q'))}, true) - 1] ELSE {LINES.format('q')} END, ' '))))"""
MCQ_FIVE = every(PARTS, f"len(list_filter({LINES.format('v')}, lambda l: {OPTION})) = 5")
ENTRIES = f"list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(l, {EDGE})), lambda l: l <> '')"
ASCII_LINE = rf"regexp_replace(translate(l, {sql_text(ck.ACCENTS[0])}, {sql_text(ck.ACCENTS[1])}), '[^\x00-\x7f]', '', 'g')"
AFRICA = f"list_transform({ENTRIES}[list_position(list_transform({ENTRIES}, lambda l: contains(l, 'Zimbabwe')), true):], lambda l: {ASCII_LINE})"

# id, arguments, SQL of the rule
SUITE = [
    ("length_constraints:number_sentences", {"relation": "at least", "n": 3}, "len(s) >= 3"),
    ("detectable_content:number_placeholders", {"n": 2}, f"{n_matches(chr(92) + '[.*?' + chr(92) + ']')} >= 2"),
    ("detectable_format:number_bullet_lists", {"n": 3}, rf"{n_matches(r'(?m)^\s*\*[^\*].*$')} + {n_matches(r'(?m)^\s*-.*$')} = 3"),
    ("detectable_format:constrained_response", {"options": ["My answer is yes.", "My answer is no.", "My answer is maybe."]}, "contains(t, 'My answer is yes.') OR contains(t, 'My answer is no.') OR contains(t, 'My answer is maybe.')"),
    ("detectable_format:number_highlighted_sections", {"n": 2}, r"len(list_filter(regexp_extract_all(t, '\*[^\n\*]*\*'), lambda h: trim(replace(h, '*', '')) <> '')) + len(list_filter(regexp_extract_all(t, '\*\*[^\n\*]*\*\*'), lambda h: trim(replace(h, '*', '')) <> '')) >= 2"),
    ("detectable_format:multiple_sections", {"splitter": "Section", "n": 2}, rf"{n_matches(chr(92) + 's?Section' + chr(92) + 's?' + chr(92) + 'd+' + chr(92) + 's?')} >= 2"),
    ("length_constraints:number_paragraphs", {"n": 3}, f"len(list_filter({STARS}, lambda x: x <> '')) = 3 AND len({STARS}) = 3"),
    ("detectable_content:postscript", {"marker": "P.S."}, r"regexp_matches(lower(t), 'p\.\s?s\.')"),
    ("keywords:existence", {"keywords": ["the", "OF"]}, "contains(lower(t), 'the') AND contains(lower(t), 'of')"),
    ("keywords:frequency", {"keyword": "the", "relation": "at least", "n": 3}, f"{occurrences('lower(t)', sql_text('the'))} >= 3"),
    ("length_constraints:number_words", {"relation": "less than", "n": 50}, f"{n_matches(WORD_RE)} < 50"),
    ("detectable_format:json_format", {}, f"json_valid({JSON_BODY}) AND {JSON_BODY} <> ''"),
    ("length_constraints:nth_paragraph_first_word", {"n": 2, "nth": 2, "first_word": "second"}, f"""len(list_filter({PARAS2}, lambda x: trim(x) <> '')) = 2 AND lower(regexp_extract(trim({PARAS2}[2]), '^''*"*([^.,?!''"\\s]*)', 1)) = 'second'"""),
    ("keywords:forbidden_words", {"words": ["bolt", "gear"]}, f"NOT list_has_any(regexp_extract_all(lower(t), {sql_text(WORD_RE)}), ['bolt', 'gear'])"),
    ("combination:two_responses", {}, f"len({SIX}) = 2 AND len(list_filter({SIX}, lambda x: x = '')) = 0 AND {SIX}[1] <> {SIX}[2]"),
    ("combination:repeat_prompt", {}, "starts_with(lower(tr), lower(p))"),
    ("startend:end_checker", {"phrase": "Thanks a lot!"}, "ends_with(lower(trim(tr, '\"')), 'thanks a lot!')"),
    ("detectable_format:title", {}, f"{some(f'regexp_extract_all(t, {sql_text("<<[^" + chr(10) + "]+>>")})', "trim(regexp_replace(v, '^<+|>+$', '', 'g')) <> ''")}"),
    ("keywords:letter_frequency", {"letter": "e", "relation": "less than", "n": 4}, f"{occurrences('lower(t)', sql_text('e'))} < 4"),
    ("change_case:english_capital", {}, "upper(t) = t AND lower(t) <> t"),
    ("change_case:english_lowercase", {}, "lower(t) = t AND upper(t) <> t"),
    ("punctuation:no_comma", {}, "NOT contains(t, ',')"),
    ("change_case:capital_word_frequency", {"relation": "at least", "n": 2}, f"len(list_filter(w, lambda v: {UPPER})) >= 2"),
    ("startend:quotation", {}, "length(tr) > 1 AND left(tr, 1) = '\"' AND right(tr, 1) = '\"'"),
    ("count:word_count_range", {"low": 5, "high": 60}, f"{n_matches(WORD_RE)} BETWEEN 5 AND 60"),
    ("count:unique_word_count", {"n": 40}, f"len(list_distinct(list_transform({WORDS.format('lower(t)')}, lambda x: trim(x, {EDGE})))) >= 40"),
    ("ratio:stop_words", {"percent": 20, "stop_words": STOPS}, f"CASE WHEN {n_matches(WORD_RE)} > 0 THEN 100.0::DOUBLE * len(list_filter(regexp_extract_all(lower(t), {sql_text(WORD_RE)}), lambda v: list_contains({sql_list(STOPS)}, v))) / {n_matches(WORD_RE, 'lower(t)')} <= 20 END"),
    ("ratio:sentence_type", {}, "len(list_filter(s, lambda v: ends_with(v, '.'))) = 2 * len(list_filter(s, lambda v: ends_with(v, '?')))"),
    ("ratio:sentence_balance", {}, "len(list_filter(s, lambda v: ends_with(v, '.'))) = len(list_filter(s, lambda v: ends_with(v, '?'))) AND len(list_filter(s, lambda v: ends_with(v, '?'))) = len(list_filter(s, lambda v: ends_with(v, '!')))"),
    ("count:conjunctions", {"n": 3}, f"len(list_distinct(list_filter(w, lambda v: list_contains({sql_list(ck.CONJUNCTIONS)}, lower(trim(v, {EDGE})))))) >= 3"),
    ("count:person_names", {"n": 3}, f"len(list_filter({sql_list(ck.PERSON_NAMES)}, lambda v: contains(t, v))) >= 3"),
    ("ratio:overlap", {"percent": 5, "reference": REF}, f"CASE WHEN length(t) >= 3 THEN 100.0::DOUBLE * len(list_intersect({GRAMS.format('t')}, {GRAMS.format(sql_text(REF))})) / len({GRAMS.format('t')}) BETWEEN 3 AND 7 END"),
    ("count:numbers", {"n": 1}, f"{n_matches(chr(92) + 'd+', 'nt')} = 1"),
    ("words:alphabet", {}, "regexp_matches(lower(left(nw[1], 1)), '[a-z]') AND len(list_filter(range(1, len(nw) + 1), lambda i: ascii(lower(left(nw[i], 1))) - 97 <> (ascii(lower(left(nw[1], 1))) - 98 + i) % 26)) = 0"),
    ("words:vowel", {}, "NOT contains(tr, chr(10)) AND len(list_filter(['a', 'e', 'i', 'o', 'u'], lambda v: contains(lower(t), v))) <= 3"),
    ("words:consonants", {}, every("w", "regexp_matches(lower(v), '[bcdfghjklmnpqrstvwxyz]{2}')")),
    ("sentence:alliteration_increment", {}, adjacent(STEPS, "{b} > {a}")),
    ("words:palindrome", {}, "len(list_filter(lw, lambda v: length(v) >= 5 AND reverse(v) = v)) >= 10"),
    ("count:punctuation", {}, r"regexp_matches(t, '\?!|!\?|‽') AND len(list_filter(['.', ',', '!', '?', ';', ':'], lambda v: contains(CASE WHEN contains(t, '?!') THEN regexp_replace(t, '\?!', '') ELSE regexp_replace(t, '!\?', '') END, v))) = 6"),
    ("format:parentheses", {}, f"({BRACKETS}).ok"),
    ("format:quotes", {}, f"({QUOTES}).ok"),
    ("words:prime_lengths", {}, every("nw", f"list_contains({ck.PRIMES}, length(v))")),
    ("format:options", {"strict": "false", "options": ["my answer is yes", "B"]}, f"list_contains(['my answer is yes', 'b'], lower(trim(t, {EDGE})))"),
    ("format:newline", {}, f"len(list_filter(string_split({STRIP.format('nt')}, chr(10)), lambda x: x <> '')) = len(nw)"),
    ("format:emoji", {}, f"len(list_filter(range(1, len(s) + 1), lambda i: cl[i] = '' OR NOT (regexp_matches(cl[i], '(?s){E}.?$') OR coalesce(regexp_matches(cl[i + 1], '^{E}'), false)))) = 0"),
    ("ratio:sentence_words", {}, "len(s) = 3 AND length(s[1]) = length(s[2]) AND length(s[2]) = length(s[3])"),
    ("count:words_japanese", {"n": 2}, f"len(list_filter(range(1, len(w) + 1), lambda i: i % 2 = 0 AND NOT (trim(w[i], {EDGE}) = '' OR regexp_full_match(trim(w[i], {EDGE}), '[0-9]+') OR regexp_matches(w[i], '[぀-ヿ一-鿿]')))) = 0"),
    ("words:repeats", {"n": 3}, "coalesce(list_max(map_values(list_histogram(lw))), 0) <= 3"),
    ("sentence:keyword", {"n": 2, "keyword": "The"}, "contains(lower(s[2]), 'the')"),
    ("count:pronouns", {"n": 2}, f"len(list_filter({WORDS.format(f"translate(lower(replace(t, '/', ' ')), {Q}, '')")}, lambda v: list_contains({sql_list(ck.PRONOUNS)}, v))) >= 2"),
    ("words:last_first", {}, "len(list_filter(range(1, len(s)), lambda i: coalesce(lasts[i] <> firsts[i + 1], true))) = 0"),
    ("words:paragraph_last_first", {}, every(PARA, f"{WORDS.format(f'trim(v, {EDGE})')}[1] = {WORDS.format(f'trim(v, {EDGE})')}[-1]")),
    ("sentence:increment", {"n": 1}, adjacent("sw", "{b} = {a} + 1")),
    ("words:no_consecutive", {}, adjacent("ini", "{a} <> {b}")),
    ("format:line_indent", {}, adjacent("ind", "{b} > {a}")),
    ("format:quote_unquote", {}, NO_QUOTE),
    ("format:list", {"sep": "->"}, f"{occurrences('t', sql_text('->'))} >= 2"),
    ("format:thesis", {}, r"regexp_matches(t, '(?s)^.*?<i>\s*[^\s<].*?</i>\s*\S')"),
    ("format:sub-bullets", {}, every("string_split(t, '*')[2:]", "contains(v, '-')")),
    ("format:no_bullets_bullets", {}, f"({BULLETS}).ok AND ({BULLETS}).b >= 2"),
    ("custom:multiples", {}, r"regexp_extract_all(t, '\d+') = ['14', '21', '28', '35', '42', '49']"),
    ("custom:mcq_count_length", {}, f"starts_with(t, 'Question') AND len({PARTS}) = 4 AND {MCQ_FIVE} AND {adjacent(MCQ_HEADS, '{b} > {a}')}"),
    ("custom:reverse_newline", {}, f"len({AFRICA}) >= 52 AND list_reverse_sort({AFRICA}) = {AFRICA}"),
    ("custom:word_reverse", {}, "contains(array_to_string(list_reverse(lw), ' '), 'bald eagle')"),
    ("custom:character_reverse", {}, "contains(lower(t), 'elgae dlab')"),
    ("custom:sentence_alphabet", {}, "array_to_string(list_transform(s, lambda x: lower(left(ltrim(x), 1))), '') = 'abcdefghijklmnopqrstuvwxyz'"),
    ("custom:european_capitals_sort", {}, f"list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') = {sql_list(ck.CAPITALS)}"),
    ("custom:csv_city", {}, "starts_with(t, 'ID,Country,City,Year,Count' || chr(10)) AND len(string_split(t, chr(10))) = 8 AND " + every("string_split(t, chr(10))", "len(string_split(v, ',')) = 5")),
    ("custom:csv_special_character", {}, "starts_with(t, 'ProductID,Category,Brand,Price,Stock' || chr(10)) AND len(string_split(t, chr(10))) = 15 AND contains(t, '\"b & ')"),
    ("custom:csv_quotes", {}, "starts_with(t, '\"StudentID\"' || chr(9)) AND len(string_split(t, chr(10))) = 4 AND len(string_split(t, chr(9))) = 17"),
    ("custom:date_format_list", {}, every("string_split(tr, ',')", r"regexp_full_match(trim(v), '\d{4}-\d{2}-\d{2}') AND TRY_CAST(left(trim(v), 4) AS INT) BETWEEN 1769 AND 1821 AND TRY_CAST(trim(v) AS DATE) IS NOT NULL")),
    ("count:keywords_multiple", {f"keyword{i + 1}": k for i, k in enumerate(["alpha", "beta", "gamma", "delta", "omega"])}, " AND ".join(f"{occurrences('lower(t)', sql_text(k))} = {n}" for k, n in zip(["alpha", "beta", "gamma", "delta", "omega"], (1, 2, 3, 5, 7)))),
    ("words:keywords_specific_position", {"n": 2, "m": 2, "keyword": "is"}, f"{WORDS.format('s[2]')}[2] = 'is'"),
    ("words:words_position", {"keyword": "key"}, "w[2] = 'key' AND w[len(w) - 1] = 'key'"),
    ("repeat:repeat_change", {}, "p <> t AND substr(p, 2) = substr(t, 2)"),
    ("repeat:repeat_simple", {"text": "only output this sentence "}, "lower(tr) = 'only output this sentence'"),
    ("repeat:repeat_span", {"start": 2, "stop": 5}, f"{WORDS.format('lower(t)')} = {WORDS.format('lower(p)')}[3:5]"),
    ("format:title_case", {}, "NOT " + some("w", "left(v, 1) = lower(left(v, 1)) AND left(v, 1) <> upper(left(v, 1)) AND upper(substr(v, 2)) <> lower(substr(v, 2)) AND (lower(substr(v, 2)) = substr(v, 2) OR upper(substr(v, 2)) = substr(v, 2))")),
    ("format:output_template", {}, "contains(t, 'My Answer:') AND contains(t, 'My Conclusion:') AND contains(t, 'Future Outlook:')"),
    ("format:no_whitespace", {}, r"NOT regexp_matches(t, '\s')"),
]


def args_column(args):
    pairs = [(k, json.dumps(v) if isinstance(v, list) else str(v)) for k, v in args.items()]
    if not pairs:
        return F.create_map(F.lit(""), F.lit(""))
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def query_name(instruction):
    return "check_" + instruction.replace(":", "_").replace("-", "_")


def _register(instruction, args, rule):
    def run(spark, sf_dir):
        ok = ck.follows(instruction, F.col("t"), ck.Args(args_column(args)), F.col("p"))
        return responses(spark, sf_dir).select("rid", ok.alias("followed"))

    sql = f"SELECT rid, tr <> '' AND coalesce({rule}, false) AS followed FROM resp_lists"
    run.__name__ = query_name(instruction)
    run.__doc__ = f"Instruction check {instruction} over all responses."
    query(query_name(instruction), sql)(run)


for _instruction, _args, _rule in SUITE:
    _register(_instruction, _args, _rule)


# --- reports ----------------------------------------------------------------------

# Every response gets GIVEN instructions of the suite, from its number; over the table all of them occur.
GIVEN, STEP, SHIFT = 6, 7, 13
view(
    "variant_raw",
    f"""
    WITH v AS (SELECT rid, k, p, t, string_split(t, chr(10)) AS r FROM raw_resp),
    x AS (SELECT rid, k, p, t, {STRIP.format("array_to_string(r[2:], chr(10))")} AS f, {STRIP.format("array_to_string(r[:len(r) - 1], chr(10))")} AS l,
                 {STRIP.format("array_to_string(CASE WHEN len(r) > 2 THEN r[2:len(r) - 1] ELSE [] END, chr(10))")} AS b FROM v),
    y AS (SELECT rid, k, p, t, list_concat([t, f, l, b], list_transform([t, f, l, b], lambda z: replace(z, '*', ''))) AS vs FROM x)
    SELECT rid, k, p, true AS raw, t FROM y UNION ALL SELECT rid, k, p, false, unnest(list_distinct(list_filter(vs, lambda z: z <> t))) FROM y
    """,
)
view("variant_resp", resp_sql("variant_raw"))
view("variant_lists", lists_sql("variant_resp"))
view(
    "graded",
    f"""
    SELECT rid, instruction_id, bool_or(raw AND followed) AS strict, bool_or(followed) AS loose
    FROM (SELECT rid, raw, instruction_id, tr <> '' AND coalesce(CASE instruction_id {" ".join(f"WHEN '{n}' THEN ({r})" for n, _, r in SUITE)} END, false) AS followed
          FROM (SELECT *, ({sql_list([n for n, _, _ in SUITE])})[1 + (k * {STEP} + j * {SHIFT}) % {len(SUITE)}] AS instruction_id FROM variant_lists, range({GIVEN}) AS given(j)))
    GROUP BY rid, instruction_id
    """,
)


def graded(spark, sf_dir):
    """One row per (response, instruction) with its strict and loose flags."""
    suite = F.array(*[F.struct(F.lit(n).alias("instruction_id"), args_column({"_": "", **a}).alias("kwargs")) for n, a, _ in SUITE])
    given = F.transform(F.array(*[F.lit(j) for j in range(GIVEN)]), lambda j: F.get(suite, ((F.col("k") * STEP + j * SHIFT) % len(SUITE)).cast("int")))
    return ins.grade(responses(spark, sf_dir).withColumn("instructions", given), "rid", "t", "p", "instructions")


@query(
    "if_strict_loose",
    """
    SELECT rid, CAST(bool_and(strict) AS INT) AS prompt_strict, CAST(bool_and(loose) AS INT) AS prompt_loose,
           count(*) FILTER (strict) AS strict_n, count(*) FILTER (loose) AS loose_n FROM graded GROUP BY rid
    """,
)
def if_strict_loose(spark, sf_dir):
    return ins.per_prompt(graded(spark, sf_dir), "rid")


@query(
    "if_report",
    """
    WITH p AS (SELECT rid, bool_or(strict) AS ps, bool_or(loose) AS pl, count(*) FILTER (strict) AS s, count(*) FILTER (loose) AS l, count(*) AS n FROM graded GROUP BY rid)
    SELECT round(avg((s = n)::INT), 6) AS prompt_strict, round(avg((l = n)::INT), 6) AS prompt_loose, round(sum(s)::DOUBLE / sum(n), 6) AS inst_strict, round(sum(l)::DOUBLE / sum(n), 6) AS inst_loose FROM p
    """,
)
def if_report(spark, sf_dir):
    out = ins.report(graded(spark, sf_dir), "rid")
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query(
    "if_report_by_type",
    """
    SELECT split_part(instruction_id, ':', 1) AS family, coalesce(instruction_id, 'all') AS instruction_id, round(avg(strict::INT), 6) AS strict, round(avg(loose::INT), 6) AS loose, count(*) AS n
    FROM graded GROUP BY GROUPING SETS ((split_part(instruction_id, ':', 1)), (split_part(instruction_id, ':', 1), instruction_id))
    """,
)
def if_report_by_type(spark, sf_dir):
    out = ins.report_by_type(graded(spark, sf_dir))
    return out.select("family", "instruction_id", r6(F.col("strict")).alias("strict"), r6(F.col("loose")).alias("loose"), "n")
