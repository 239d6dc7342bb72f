"""Prompt and choice builders (Column -> Column).

Language words come from a struct Column ``lit`` (see ``literals``); every
template returns a struct (query, choices, instruction, unconditioned_query).
"""

from pyspark.sql import functions as F

from evalmill.functions.arrays import let, pick
from evalmill.functions.text import replace, rstrip, strip

# Words and marks by language. Further languages are passed in
# as a mapping of the same shape.
LITERALS = {
    "en": {"question_word": "question", "answer": "answer", "confirmation_word": "right", "yes": "yes", "no": "no", "also": "also", "cause_word": "because", "effect_word": "therefore", "or_word": "or", "true": "true", "false": "false", "neither": "neither"},
    "fr": {"question_word": "question", "answer": "réponse", "confirmation_word": "n'est-ce pas", "yes": "oui", "no": "non", "also": "de plus", "cause_word": "parce que", "effect_word": "donc", "or_word": "ou", "true": "vrai", "false": "faux", "neither": "aucun des deux"},
    "de": {"question_word": "frage", "answer": "antwort", "confirmation_word": "richtig", "yes": "ja", "no": "nein", "also": "auch", "cause_word": "weil", "effect_word": "deshalb", "or_word": "oder", "true": "wahr", "false": "falsch", "neither": "weder noch"},
    "es": {"question_word": "pregunta", "answer": "respuesta", "confirmation_word": "cierto", "yes": "sí", "no": "no", "also": "también", "cause_word": "porque", "effect_word": "por lo tanto", "or_word": "o", "true": "verdadero", "false": "falso", "neither": "ninguno"},
    "zh": {"question_word": "问题", "answer": "答案", "confirmation_word": "对吗", "yes": "是的", "no": "不是", "also": "而且", "cause_word": "因为", "effect_word": "所以", "or_word": "或", "true": "真", "false": "假", "neither": "都不是", "full_stop": "。", "comma": "，", "question_mark": "？", "exclamation_mark": "！", "word_space": "", "sentence_space": "", "colon": "："},
}
# Marks a language uses unless it names its own.
DEFAULT_MARKS = {"full_stop": ".", "comma": ",", "question_mark": "?", "exclamation_mark": "!", "word_space": " ", "sentence_space": " ", "colon": ":", "semicolon": ";"}

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
END_PUNCT = r"[\p{P}$+<=>^`|~]+\z"


def literals(lang, table=None):
    """Struct of words and marks for a language code Column (a constant map lookup, no join).

    A code that the table lacks is an error; a null code has no words.
    """
    table = LITERALS if table is None else table
    names = sorted({n for words in table.values() for n in words} | set(DEFAULT_MARKS))
    pairs = []
    for code, words in table.items():
        full = {**DEFAULT_MARKS, **words}
        pairs += [F.lit(code), F.struct(*[F.lit(full.get(n)).alias(n) for n in names])]
    unknown = F.raise_error(F.concat(F.lit("no words for language "), lang))
    return F.when(lang.isNotNull(), F.coalesce(F.create_map(*pairs)[lang], unknown))


# --- casing and punctuation ---------------------------------------------------


def capitalize(text):
    return let(text, lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2))))


def decapitalize(text):
    return let(text, lambda t: F.concat(F.lower(F.left(t, F.lit(1))), F.substr(t, F.lit(2))))


def fix_ending_punct(text, lit):
    """Final mark in the language's own form, trailing blanks dropped."""

    def fixed(t):
        last = F.right(t, F.lit(1))
        mark = (
            F.when(last == "?", lit["question_mark"])
            .when(last == ".", lit["full_stop"])
            .when(last == ",", lit["comma"])
            .when(last == ":", lit["colon"])
            .otherwise(last)
        )
        return F.concat(F.left(t, F.length(t) - 1), mark)

    return let(rstrip(text), fixed)


def ends_sentence(text, lit):
    """The last visible character is one of the language's sentence marks."""
    names = ("question_mark", "full_stop", "exclamation_mark", "colon", "semicolon")
    marks = F.array(*[lit[n] for n in names])
    return F.coalesce(F.array_contains(marks, F.right(rstrip(text), F.lit(1))), F.lit(False))


def fix_capitalization(prefix, text, lit):
    """Capital after nothing, a newline or a sentence end; lower case otherwise."""

    def cased(p):
        upper = (p == "") | p.endswith("\n") | ends_sentence(p, lit)
        return let(text, lambda t: F.when(upper, capitalize(t)).otherwise(decapitalize(t)))

    return let(prefix, cased)


# --- options and answers --------------------------------------------------------


def choice_prefix(kind, lit=None, native=None):
    """Array of option labels: Letters, NativeLetters or Numbers."""
    if kind == "Numbers":
        return F.array(*[F.lit(str(i)) for i in range(1, 27)])
    if kind == "NativeLetters" and native is not None:
        return native
    return F.array(*[F.lit(c) for c in LETTERS])


def label_at(labels, i):
    """Label of an option; one past the last label is an error rather than a line that vanishes."""
    missing = F.raise_error(F.lit("more options than labels")).cast("string")
    return F.when(i < F.size(labels), F.get(labels, i)).otherwise(missing)


def build_choices(choices, formulation, lit, prefix="Letters", sentence_space=True):
    """Option lines for MCF and Hybrid, NULL for CF."""
    if formulation == "CF":
        return F.lit(None).cast("string")
    labels = choice_prefix(prefix, lit)
    space = lit["sentence_space"] if sentence_space else lit["word_space"]
    lead, follow = (space, lit["sentence_space"]) if formulation == "MCF" else (lit["sentence_space"], space)
    line = lambda c, i: F.concat(lead, label_at(labels, i), lit["full_stop"], follow, c)
    return F.array_join(F.transform(choices, line), "\n")


def build_answers(choices, formulation, lit, prefix="Letters", sentence_space=True):
    """Scored answers: labels for MCF, texts for Hybrid and CF."""
    space = lit["sentence_space"] if sentence_space is True else lit["word_space"] if sentence_space is False else sentence_space
    if formulation == "MCF":
        labels = choice_prefix(prefix, lit)
        return F.transform(choices, lambda c, i: F.concat(space, label_at(labels, i)))
    return F.transform(choices, lambda c: F.concat(space, c))


def _line(text):
    """Text and a newline, empty for NULL or empty text."""
    return let(text, lambda t: F.when(F.coalesce(t, F.lit("")) == "", "").otherwise(F.concat(t, F.lit("\n"))))


def _doc(query, choices, instruction, unconditioned):
    return F.struct(
        query.alias("query"), choices.alias("choices"), instruction.alias("instruction"), unconditioned.alias("unconditioned_query")
    )


def _none():
    return F.lit(None).cast("string")


def multichoice(question, choices, lit, formulation="MCF", context=None, instruction=None):
    """Language-aware multiple choice question."""
    instruction = _none() if instruction is None else instruction
    context = _none() if context is None else context
    head = capitalize(fix_ending_punct(context, lit))
    texts = F.transform(choices, lambda c: capitalize(fix_ending_punct(c, lit)))
    options = _line(build_choices(texts, formulation, lit))
    answer = F.concat(capitalize(lit["answer"]), lit["colon"])
    query = F.concat(
        _line(instruction),
        _line(F.when(F.coalesce(context, F.lit("")) != "", head)),
        capitalize(lit["question_word"]),
        lit["colon"],
        lit["sentence_space"],
        capitalize(fix_ending_punct(question, lit)),
        F.lit("\n"),
        options,
        answer,
    )
    return _doc(query, build_answers(texts, formulation, lit), instruction, answer)


def continuation(context, continuations, lit, formulation="MCF", instruction=None, fix_formatting=True):
    """Context and possible endings."""
    instruction = _line(_none() if instruction is None else instruction)

    def doc(head):
        texts = continuations
        if fix_formatting:
            texts = F.transform(continuations, lambda c: fix_capitalization(head, fix_ending_punct(c, lit), lit))
        if formulation == "CF":
            space = F.when(ends_sentence(head, lit), lit["sentence_space"]).otherwise(lit["word_space"])
            return _doc(F.concat(instruction, head), build_answers(texts, "CF", lit, sentence_space=space), instruction, F.lit(""))
        options = _line(build_choices(texts, formulation, lit))
        answer = F.concat(capitalize(lit["answer"]), lit["colon"])
        query = F.concat(instruction, head, F.lit("\n"), options, answer)
        return _doc(query, build_answers(texts, formulation, lit), instruction, answer)

    return let(capitalize(fix_ending_punct(context, lit)) if fix_formatting else context, doc)


def copa(context, cause_effect, continuations, lit, formulation="MCF"):
    """Context with a cause or effect connector, then the endings."""
    head = capitalize(F.regexp_replace(context, END_PUNCT, ""))
    word = F.when(cause_effect == "cause", lit["cause_word"]).otherwise(lit["effect_word"])
    return continuation(F.concat(head, lit["word_space"], word), continuations, lit, formulation)


def hellaswag_clean(text, dot=None, strip_text=False):
    """Drop the title mark and bracketed spans, squeeze double blanks once."""
    dot = F.lit(". ") if dot is None else dot
    out = F.replace(text, F.lit(" [title]"), dot)
    out = replace(F.regexp_replace(out, r"\[.*?\]", ""), "  ", " ")
    return strip(out) if strip_text else out


def hellaswag(activity, ctx_a, ctx_b, endings, lit, formulation="CF"):
    """(doc, keep): label, joined contexts and cleaned endings; keep is false when an ending is blank."""
    dot = F.concat(lit["full_stop"], lit["sentence_space"])
    label = F.when(activity == "", "").otherwise(F.concat(capitalize(activity), F.lit(":\n")))
    a, b = (capitalize(fix_ending_punct(hellaswag_clean(c, strip_text=True), lit)) for c in (ctx_a, ctx_b))

    def joined(head):
        space = F.when(ends_sentence(head, lit), lit["sentence_space"]).otherwise(lit["word_space"])
        return let(b, lambda t: F.when(t == "", head).otherwise(F.concat(rstrip(head), space, fix_capitalization(head, t, lit))))

    cleaned = F.transform(endings, lambda e: hellaswag_clean(e, dot, True))
    keep = F.forall(cleaned, lambda c: strip(c) != "")
    return continuation(F.concat(label, let(a, joined)), cleaned, lit, formulation, F.lit("")), keep


# The word each relation is called by.
NATURAL_RELATIONS = {"entailment": "yes", "contradiction": "no", "neutral": "also"}
QUESTION_RELATIONS = {"entailment": "true", "contradiction": "false", "neutral": "neither"}


def nli(premise, hypothesis, relations, lit, formulation="MCF"):
    """Natural form for CF, question form otherwise."""
    if formulation == "CF":
        labels = [capitalize(lit[NATURAL_RELATIONS[r]]) for r in relations]
        ask = F.concat(lit["confirmation_word"], lit["question_mark"])
        head = capitalize(F.regexp_replace(premise, END_PUNCT, ""))
        tail = decapitalize(F.regexp_replace(hypothesis, END_PUNCT, ""))
        choices = [F.concat(lit["sentence_space"], x, lit["comma"], lit["word_space"], tail) for x in labels]
        return _doc(F.concat(head, lit["word_space"], ask), F.array(*choices), _none(), ask)
    labels = [capitalize(lit[QUESTION_RELATIONS[r]]) for r in relations]
    head = fix_ending_punct(capitalize(premise), lit)
    question = hypothesis
    if formulation == "Hybrid":
        order = [i for i, r in enumerate(relations) if r != "neutral"] + [i for i, r in enumerate(relations) if r == "neutral"]
        ordered = [labels[i] for i in order]
        sep = F.concat(lit["comma"], lit["word_space"])
        listed = ordered[0]
        for x in ordered[1:-1]:
            listed = F.concat(listed, sep, x)
        question = F.concat(
            F.regexp_replace(hypothesis, END_PUNCT, ""), lit["sentence_space"], listed, lit["word_space"],
            lit["or_word"], lit["word_space"], ordered[-1], lit["question_mark"],
        )
    return multichoice(question, F.array(*labels), lit, "CF" if formulation == "Hybrid" else formulation, context=head)


def boolq(question, lit, formulation="MCF", context=None):
    """Yes/no question; gold 0 when the answer is true."""
    return multichoice(question, F.array(lit["yes"], lit["no"]), lit, formulation, context)


def qa(question, answers, lit):
    """Distinct answers become the choices; all of them are gold."""
    return multichoice(question, F.array_distinct(answers), lit, "CF")


def translation(source, targets, source_code, target_code, source_lit, target_lit, english, formulation="CF"):
    """Source and target language lines with the targets as continuations."""
    head = F.concat(
        F.upper(source_code), F.lit(": "), capitalize(fix_ending_punct(source, source_lit)), F.lit(" "), F.upper(target_code), F.lit(":")
    )
    texts = F.transform(targets, lambda t: capitalize(fix_ending_punct(t, target_lit)))
    return continuation(head, texts, english, formulation, F.lit(""), fix_formatting=False)


# --- plain tasks ------------------------------------------------------------------


def letters_prompt(subject, question, choices):
    """Subject line, question, lettered options and ``Answer:``."""
    labels = choice_prefix("Letters")
    options = F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit("\n"), F.get(labels, i), F.lit(". "), c)), "")
    intro = F.concat(F.lit("The following are multiple choice questions (with answers) about "), replace(subject, "_", " "), F.lit(".\n\n"))
    return F.concat(intro, F.lit("Question: "), question, options, F.lit("\nAnswer:"))


def letter_gold(letter):
    """Zero-based position of an answer letter."""
    return (F.ascii(letter) - 65).cast("int")


def qa_prompt(question):
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))


# Rewrites that undo wikitext tokenisation, in order. True marks a pattern.
WIKITEXT_RULES = [
    (False, "s '", "s'"), (True, r"/' [0-9]/", "/'[0-9]/"), (False, " @-@ ", "-"), (False, " @,@ ", ","),
    (False, " @.@ ", "."), (False, " : ", ": "), (False, " ; ", "; "), (False, " . ", ". "), (False, " ! ", "! "),
    (False, " ? ", "? "), (False, " , ", ", "), (True, r"\(\s*([^\)]*?)\s*\)", "($1)"),
    (True, r"\[\s*([^\]]*?)\s*\]", "[$1]"), (True, r"\{\s*([^}]*?)\s*\}", "{$1}"), (True, r'"\s*([^"]*?)\s*"', '"$1"'),
    (True, r"'\s*([^']*?)\s*'", "'$1'"), (False, "= = = =", "===="), (False, "= = =", "==="), (False, "= =", "=="),
    (False, " ° ", "°"), (False, " \n", "\n"), (False, "\n ", "\n"), (False, " N ", " 1 "), (False, " 's", "'s"),
]


def wikitext_detok(text):
    """Text as it was before wikitext tokenisation."""
    for is_pattern, old, new in WIKITEXT_RULES:
        text = F.regexp_replace(text, old, new) if is_pattern else replace(text, old, new)
    return text


def drop_answer(answer):
    """Spans of one answer struct (number, spans, date): number, else spans, else the date."""
    date = answer["date"]
    day = strip(F.concat_ws(" ", date["day"], date["month"], date["year"]))
    return (
        F.when(answer["number"] != "", F.array(answer["number"].cast("string")))
        .when(F.size(answer["spans"]) > 0, answer["spans"])
        .otherwise(F.array(day))
    )


def drop_answers(answer, validated):
    """Distinct answers of a row, the main one first."""
    return F.array_distinct(F.transform(F.concat(F.array(answer), validated), drop_answer))


def truthfulqa_choices(mc1, mc1_labels, mc2, mc2_labels):
    """Struct of joined choices, gold positions and the size of the first block."""
    labels = F.concat(mc1_labels, mc2_labels)
    golds = F.filter(F.transform(labels, lambda v, i: F.when(v == 1, i)), lambda i: i.isNotNull())
    spaced = F.transform(F.concat(mc1, mc2), lambda c: F.concat(F.lit(" "), c))
    return F.struct(spaced.alias("choices"), golds.alias("gold_index"), F.size(mc1).alias("len_mc1"))


def hash_slot(identity, n, seed="slot"):
    """Position 0..n-1 drawn from a hash of the identity."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), identity.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n).cast("int")


def insert_at(values, slot, value):
    """Array with ``value`` at zero-based ``slot``."""
    return F.concat(F.slice(values, 1, slot), F.array(value), F.slice(values, slot + 1, F.size(values)))


def plain_prompt(system, instruction, fewshot, query):
    """Parts joined by blank lines; fewshot is an array of (query, instruction, gold) structs."""
    shots = F.transform(fewshot, lambda s: F.concat(extract_query(s["query"], s["instruction"]), F.lit(" "), strip(s["gold"])))
    return F.array_join(
        F.concat(F.array(system, instruction), shots, F.array(extract_query(query, instruction))), "\n\n"
    )


def extract_query(query, instruction):
    """Query without a leading instruction."""
    rest = strip(F.substr(query, F.length(instruction) + 1))
    return F.when(F.coalesce(F.startswith(query, instruction), F.lit(False)), rest).otherwise(query)


def _message(role, content):
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(system, instruction, fewshot, query):
    """Array of (role, content): system, alternating shots, final user turn.

    The instruction is put before the first user turn only.
    """
    inst = F.coalesce(instruction, F.lit(""))

    def shot(s, i):
        body = extract_query(s["query"], s["instruction"])
        return F.array(_message("user", F.when(i == 0, F.concat(inst, body)).otherwise(body)), _message("assistant", s["gold"]))

    main = extract_query(query, instruction)
    main = F.when(F.size(fewshot) == 0, F.concat(inst, main)).otherwise(main)
    first = F.filter(F.array(_message("system", system)), lambda m: m["content"].isNotNull())
    return F.concat(first, F.flatten(F.transform(fewshot, shot)), F.array(_message("user", main)))


def format_template(template, fields):
    """Fill ``{name}`` places of a template with Columns."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(head), fields[name]]
    return F.concat(*parts, F.lit(rest))


# Adversarial GLUE instructions and the two fields of each task.
GLUE_TASKS = {
    "mnli": ("Please identify whether the premise entails the hypothesis. The answer should be exactly 'A. yes', 'B. maybe' or 'C. no'\n", "Premise: ", "premise", "\nHypothesis: ", "hypothesis", "premise"),
    "mnli-mm": ("Please identify whether the premise entails the hypothesis. The answer should be exactly 'A. yes', 'B. maybe' or 'C. no'\n", "Premise: ", "premise", "\nHypothesis: ", "hypothesis", "hypothesis"),
    "qnli": ("Please identify whether the sentence answers the question. The answer should be exactly 'A. yes' or 'B. no'\n", "Question: ", "question", "\nSentence: ", "sentence", "question"),
    "rte": ("Please identify whether the sentence1 entails the sentence2. The answer should be exactly 'A. yes' or 'B. no'\n", "Sentence 1: ", "sentence1", "\nSentence 2: ", "sentence2", "sentence1"),
    "qqp": ("Please identify whether Question 1 has the same meaning as Question 2. The answer should be exactly 'A. yes' or 'B. no'\n", "Question 1: ", "question1", "\nQuestion 2: ", "question2", "question1"),
    "sst2": ("For each snippet of text, label the sentiment of the text as positive or negative. The answer should be exactly 'A. positive' or 'B. negative'\n", "Sentence: ", "sentence", None, None, "sentence"),
}
# Option texts by label.
GLUE_LABELS = {
    "mnli": [" A. yes", " B. maybe", " C. no"], "mnli-mm": [" A. yes", " B. maybe", " C. no"],
    "qnli": [" A. yes", " B. no"], "rte": [" A. yes", " B. no"], "qqp": [" A. yes", " B. no"],
    "sst2": [" A. positive", " B. negative"],
}


def glue_prompt(task, record, original=False):
    """Prompt of one record (a map of fields); ``original`` prefers the unattacked text when present."""
    out = None
    for name, (intro, first_word, first, second_word, second, attacked) in GLUE_TASKS.items():

        def field(f):
            plain = record[f]
            return F.coalesce(record[f"original_{f}"], plain) if original and f == attacked else plain

        parts = [F.lit(intro + first_word), field(first)]
        if second:
            parts += [F.lit(second_word), field(second)]
        prompt = F.concat(*parts, F.lit("\nAnswer:"))
        out = F.when(task == name, prompt) if out is None else out.when(task == name, prompt)
    return out


def glue_label(task, label):
    """Answer text of a labelled example."""
    out = None
    for name, texts in GLUE_LABELS.items():
        text = F.get(F.array(*[F.lit(t) for t in texts]), F.least(label, F.lit(len(texts) - 1)))
        out = F.when(task == name, text) if out is None else out.when(task == name, text)
    return out


def preset_prompt(question, preset_text, answer=None):
    """Question (and answer) after a preset; NULL preset gives the bare form."""
    bare = F.concat(F.lit("Q: "), question)
    if answer is None:
        return F.when(preset_text.isNull(), F.concat(bare, F.lit("\n\nA:"))).otherwise(F.concat(preset_text, F.lit("\n\n"), bare))
    return F.when(preset_text.isNull(), F.concat(bare, F.lit("\n\nA: "), answer)).otherwise(
        F.concat(preset_text, F.lit("\n\n"), bare, F.lit("\nA: "), answer)
    )


def comparison_prompt(question, a1, a2, primer=""):
    """Two answers side by side; the second gets a final period."""
    text = F.concat(F.lit(primer + "\n\nQ: "), question, F.lit("\nA1: "), a1, F.lit("\nA2: "), a2)
    return F.when(a2.endswith("."), text).otherwise(F.concat(text, F.lit(".")))


def truth_prompt(question, answer, info=False):
    """Judge prompt for truth or helpfulness."""
    return F.concat(F.lit("Q: "), question, F.lit("\nA: "), answer, F.lit("\nHelpful:" if info else "\nTrue:"))


def split_multi_answer(text, sep=";", close=True):
    """Trimmed, non-blank answers, each with a final period."""
    parts = F.filter(F.transform(F.split(strip(text), sep, -1), strip), lambda a: a != "")
    return F.transform(parts, format_best) if close else parts


def format_best(text):
    """Trimmed answer with a final period."""
    t = strip(text)
    return F.when(t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))


def code_prompt(question, starter):
    """Programming task with or without starter code."""
    intro = "You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests.\n\n"
    with_code = F.concat(
        F.lit("You will use the following starter code to write the solution to the problem and enclose your code within delimiters.\n```python\n"),
        starter,
        F.lit("\n```\n\n"),
    )
    without = F.lit(
        "Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test on the sample inputs). "
        "Enclose your code within delimiters as follows. Ensure that when the python program runs, it reads the inputs, runs the "
        "algorithm and writes output to STDOUT.\n```python\n# YOUR CODE HERE\n```\n\n"
    )
    body = F.when(F.coalesce(starter, F.lit("")) != "", with_code).otherwise(without)
    return F.concat(F.lit(intro + "Question: "), question, F.lit("\n\n"), body)


def code_tests(tests_json, metadata_json):
    """Struct of input array, output array and function name from the task's JSON fields."""
    tests = F.from_json(tests_json, "array<struct<input string, output string, testtype string>>")
    return F.struct(
        F.transform(tests, lambda t: t["input"]).alias("inputs"),
        F.transform(tests, lambda t: t["output"]).alias("outputs"),
        F.from_json(metadata_json, "func_name string")["func_name"].alias("fn_name"),
    )


def question_blocks(kinds, texts):
    """Facts since the previous question, per question, from parallel arrays of one story."""
    steps = F.arrays_zip(kinds.alias("kind"), texts.alias("text"))
    asked = F.filter(F.transform(kinds, lambda k, i: F.when(k == "question", i)), lambda i: i.isNotNull())

    def blocks(bound):
        zipped, at = bound["steps"], bound["asked"]

        def block(q, n):
            start = F.when(n == 0, F.lit(0)).otherwise(F.get(at, n - 1) + 1)
            facts = F.filter(F.slice(zipped, start + 1, q - start), lambda s: s["kind"] == "supporting fact")
            lines = F.array_join(F.transform(facts, lambda s: s["text"]), "\n")
            query = F.concat(lines, F.lit("\nQuestion: "), F.get(zipped, q)["text"], F.lit("\nAnswer: "))
            return F.struct(q.alias("position"), query.alias("query"), F.size(facts).alias("n_facts"))

        return F.transform(at, block)

    return let(F.struct(steps.alias("steps"), asked.alias("asked")), blocks)


# --- source-specific row clean-up ---------------------------------------------------

# Option labels some exam sources put before the option text.
EXAM_PREFIX = r"^\([A-Da-d1-5๑๒๓๔๕]\)\s*|^[A-Da-e1-5๑๒๓๔๕][.．।。]\s*"


def exam_choices(options):
    """Options without their label."""
    return F.transform(options, lambda o: F.regexp_replace(o, EXAM_PREFIX, ""))


def exam_gold(answer, letters=LETTERS):
    """Zero-based gold from a digit or a letter."""
    return F.when(answer.rlike(r"^\d+\z"), answer.try_cast("int") - 1).otherwise(F.instr(F.lit(letters), F.upper(answer)) - 1).cast("int")


def _common_prefix(choices):
    """The longest common prefix, its length found bit by bit; empty where a choice is NULL."""

    def longest(s):
        same = lambda n: F.forall(s["all"], lambda c: F.left(c, n) == F.left(s["first"], n))
        bits = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
        n = F.aggregate(bits, F.lit(0), lambda n, bit: F.when((n + bit <= s["shortest"]) & same(n + bit), n + bit).otherwise(n))
        return F.left(s["first"], n)

    shortest = F.array_min(F.transform(choices, F.length))
    return let(F.struct(choices.alias("all"), F.get(choices, F.lit(0)).alias("first"), shortest.alias("shortest")), longest)


def without_common_prefix(choices):
    """Struct (question, choices): the word-aligned common prefix moved out of the choices."""

    def at_word(prefix):
        last_word = F.substring_index(prefix, " ", -1)
        return F.when(F.contains(prefix, F.lit(" ")), F.left(prefix, F.length(prefix) - F.length(last_word) - 1)).otherwise("")

    def split(options):
        rest = lambda cut: F.transform(options, lambda c: F.substr(c, F.length(cut) + 1))
        return let(let(_common_prefix(options), at_word), lambda cut: F.struct(cut.alias("question"), rest(cut).alias("choices")))

    return let(choices, split)


def cloze(sentence, options):
    """Struct (context, continuations) of a sentence with one blank, NULL otherwise."""

    def doc(parts):
        head, tail = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        made = F.struct(
            head.alias("context"), F.transform(options, lambda o: F.concat(o, F.lit(" "), tail)).alias("continuations")
        )
        return F.when((F.size(parts) == 2) & (strip(head) != ""), made)

    return let(F.split(sentence, "_", -1), doc)


def fill_placeholders(question, descriptions, mark="[[placeholder]]"):
    """Each description replaces the first mark still left."""

    def step(acc, d):
        at = F.instr(acc, F.lit(mark))
        filled = F.concat(F.left(acc, at - 1), d, F.substr(acc, at + len(mark)))
        return F.when(at > 0, filled).otherwise(acc)

    return F.aggregate(descriptions, question, step)


def join_answer_group(choices, golds, sep):
    """Text of several right options joined into one."""
    return F.array_join(pick(choices, golds), sep)


def to_single_choice(identity, choices, golds, sep):
    """Struct (choices, gold): several right options become one, order drawn by hash."""
    correct = join_answer_group(choices, golds, sep)
    wrong = F.filter(F.transform(choices, lambda c, i: F.when(~F.array_contains(golds, i), c)), lambda c: c.isNotNull())
    keyed = F.transform(
        F.concat(wrong, F.array(correct)),
        lambda c: F.struct(F.md5(F.concat(identity.cast("string"), F.lit(":"), c)).alias("h"), c.alias("c")),
    )
    drawn = F.transform(F.array_sort(keyed), lambda x: x["c"])
    new = F.struct(drawn.alias("choices"), (F.array_position(drawn, correct) - 1).cast("int").alias("gold"))
    same = F.struct(choices.alias("choices"), F.get(golds, F.lit(0)).cast("int").alias("gold"))
    return F.when(F.size(golds) > 1, new).otherwise(same)


def marked_answers(text, marks):
    """Map mark -> answer for marks found from the right in descending order; NULL when one is missing.

    ``marks`` are single characters. The text before the first mark is not part
    of any answer.
    """
    ordered = F.reverse(F.array_sort(marks))
    start = F.struct(F.length(text).alias("right"), F.array().cast("array<string>").alias("found"))

    def step(acc, mark):
        head = F.left(text, acc["right"])
        behind = F.instr(F.reverse(head), mark)
        at = F.length(head) - behind
        piece = strip(F.regexp_replace(F.substr(text, at + 2, acc["right"] - at - 1), END_PUNCT, ""))
        hit = (behind > 0) & (acc["right"] >= 0)
        return F.struct(
            F.when(hit, at).otherwise(F.lit(-1)).cast("int").alias("right"),
            F.when(hit, F.concat(acc["found"], F.array(piece))).otherwise(acc["found"]).alias("found"),
        )

    done = F.aggregate(ordered, start, step)
    return F.when(F.size(done["found"]) == F.size(marks), F.map_from_arrays(ordered, done["found"]))
