"""Literal cases and brute-force checks of the kernels."""

import itertools
import math
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from evalmill.functions import checks as ck
from evalmill.functions import expressions as ev
from evalmill.functions import extract as ex
from evalmill.functions import logprob as lp
from evalmill.functions import ngrams as ng
from evalmill.functions import pairs as pr
from evalmill.functions import prompts as pm
from evalmill.functions import sequences as sq
from evalmill.functions import text as tx
from evalmill.operators import generations as gen

L = F.lit


def arr(*xs):
    return F.array(*[L(x) for x in xs])


def test_char_norm(one):
    assert one(lp.norm_char(arr(10.0, 20.0), arr(" hell", "world"))) == [2.0, 4.0]
    assert one(lp.norm_char(arr(10.0, 20.0), arr(" hell", "world"), True)) == [2.5, 4.0]


def test_token_norm(one):
    assert one(lp.norm_token(arr(10.0, 20.0), arr(3, 2))) == pytest.approx([10 / 3, 10.0])


def test_pmi_accuracy(one):
    scores = arr(0.9, 0.2, 0.85, 0.1)
    assert one(lp.loglik_acc(F.slice(scores, 1, 2), arr(0)), lp.loglik_acc(lp.split_pmi(scores, 2), arr(0))) == (1, 0)


def test_probability(one):
    scores = arr(*[math.log(x) for x in (0.35, 0.1, 0.05)])
    assert one(lp.mc_prob(scores, arr(0))) == pytest.approx(0.7)
    assert one(lp.gold_prob(arr(math.log(0.7), math.log(0.1)))) == pytest.approx(0.7)


def test_recall_ties(one):
    s = arr(1.0, 1.0, 0.0)
    assert one(lp.recall_at_k(s, arr(0), 1), lp.recall_at_k(s, arr(1), 1)) == (1, 0)
    assert one(lp.recall_at_k(arr(1.0, 1.0, 1.0), arr(0), 2)) == 0


def test_mc2_stops_at_gap(one):
    mc1, mc2 = lp.two_part_truth(arr(0.0, -1.0, 0.0, 0.0, 0.0, 0.0), arr(0, 2, 3, 5), L(2))
    assert one(mc1, mc2) == (1, pytest.approx(0.5))


def test_exact_match(one):
    em = lambda g, p, **k: pr.exact_match(arr(g), arr(p), **k)
    assert one(em("a", ""), em("", ""), em(" a ", "a", strip_strings=True), em("ab", "abc", mode="prefix"), em("bc", "abc", mode="suffix")) == (0, 0, 1, 1, 1)
    assert one(em("The  cat", "cat!", norm_gold=tx.norm_helm, norm_pred=tx.norm_helm)) == 1


def test_norm_helm_numbers(one):
    assert one(tx.norm_helm(L("1.0 and 7-up")), tx.norm_helm(L("12345678901234567890"))) == ("10.0 and 7.0 up", "1.2345678901234567e+19")


def test_norm_math(one):
    cases = {
        "\\boxed{\\frac12}": "\\frac{1}{2}", "x \\boxed{\\dfrac{2}{3}}": "\\frac{2}{3}", "\\boxed{3/4}": "\\frac{3}{4}",
        "\\boxed{0.5}": "\\frac{1}{2}", "\\boxed{k=5}": "5", "\\boxed{\\sqrt2}": "\\sqrt{2}", "\\boxed{5 \\text{ cm}}": "5",
        "none": "", "\\boxed{\\left(1,{a{b}}\\right)} t": "(1,{a{b}})", "\\boxed{50\\%}": "50",
    }
    assert list(one(*[tx.norm_math(L(k)) for k in cases])) == list(cases.values())


def test_reasoning_tags(one):
    pairs = [("<think>", "</think>")]
    cols = [tx.remove_reasoning_tags(L(t), pairs) for t in ("<think>a</think>b", "<think>a<think>b</think>c", "<think>open", "x<think>1\n2</think>y<think>3</think>z")]
    assert one(*cols) == ("b", "c", "<think>open", "xyz")


def test_numbers(one):
    texts = ["the answer is 1,234.5", "answer: 12,5", "x 50% y", "The final answer is 7. I hope", "costs $100m", "answer = 3 then 4", ".5"]
    got = one(*[ex.extract_number(L(t)) for t in texts])
    assert got == pytest.approx((1234.5, 12.5, 0.5, 7.0, 100.0, 3.0, 0.5))


def test_letters(one):
    texts = ["Answer: B", "The final answer is (C)", "A. because", "I pick\nD. yes", "so (A) it is"]
    assert one(*[ex.extract_choice_letter(L(t), 4) for t in texts]) == ("B", "C", "A", "D", "A")


def test_expressions(one):
    """Values of expressions in answers, and numbers where there is none."""
    texts = ["The answer is 1/2.", "answer: 3*(4+5)", "so it is 2^10 in all", "answer = -2^2", "the answer is 7 (seven", "1/0 is no answer: 5", "3 + 4 = 7", "x 10 - 4 × 2 ÷ 8 y"]
    assert one(*[ex.extract_number(L(t)) for t in texts]) == pytest.approx((0.5, 27.0, 1024.0, -4.0, 7.0, 5.0, 7.0, 9.0))


def test_expression_values(one):
    """The grammar against Python's own: precedence, brackets, powers from the right, signs."""
    texts = ["1-2-3", "8/4/2", "2^3^2", "2*-3^2", "2/-4", "2^-2", "-(3)+--1", "(1+2)*(3-4)/5", "10-(2+3)*2^2", ".5+1.", "((7))"]
    assert one(*[ev.expression_value(L(t)) for t in texts]) == pytest.approx(tuple(float(eval(t.replace("^", "**"))) for t in texts))
    assert one(*[ev.expression_value(L(t)) for t in ("1/0", "1+", "(1", "1)", "2 3", "", "a", "2*(", "9^9^9")]) == (None,) * 9


def test_answers_by_language(one):
    letters = [("zh", "答案：B。因为A不对", "B"), ("zh", "B不是 A", "B"), ("zh", "B。 不是 A", "B"), ("fr", "réponse est C non A", "C"), ("ja", "回答：(D)、Aではない", "D"), ("hi", "उत्तर: B। A नहीं", "B"), ("en", "The answer: D, not A", "D")]
    assert one(*[ex.extract_choice_letter(L(t), 4, code) for code, t, _ in letters]) == tuple(x for _, _, x in letters)
    numbers = [("zh", "答案：42", 42.0), ("de", "Die Antwort: 3,5 Meter und 7", 3.5), ("ru", "ответ 12% от 5", 0.12), ("th", "คำตอบ: 6/4", 1.5)]
    assert one(*[ex.extract_number(L(t), code) for code, t, _ in numbers]) == pytest.approx(tuple(x for _, _, x in numbers))
    with pytest.raises(ValueError, match="xx"):
        ex.extract_number(L("1"), "xx")


def test_each_language_has_patterns():
    for code in ex.LANGUAGES:
        patterns = ex.number_patterns(code) + ex.letter_patterns(4, code)
        assert not any(x in p for p in patterns for x in ("{v}", "{ix}", "{end}", "{answer}", "{colon}", "{space}"))


def test_numeric_equal(one):
    cases = [("1.0", "1", True), ("50%", "0.5", True), ("1,000", "1000", True), ("1d", "1", False), ("abc", " abc", True), ("", "", False)]
    assert list(one(*[ex.numeric_equal(L(a), L(b)) for a, b, _ in cases])) == [c for *_, c in cases]


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def brute_fragments(a, b):
    out, i = [], 0
    while i < len(a):
        best, j = 0, 0
        while j < len(b):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
            j += max(n, 1)
        if best:
            out.append(best)
        i += max(best, 1)
    return out


def test_sequences_against_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 9))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        assert sq.lcs_length(a, b) == brute_lcs(a, b)
        assert len(sq.lcs_positions(a, b)) == brute_lcs(a, b)
        assert sq.fragments(a, b) == brute_fragments(a, b)


def test_lcs_positions_walk_back_as_over_the_whole_table():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(25))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        want, i, j = [], len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                want.append(i - 1)
                i, j = i - 1, j - 1
            elif table[i][j - 1] > table[i - 1][j]:
                j -= 1
            else:
                i -= 1
        assert sq.lcs_positions(a, b) == want


def test_lcs_positions_of_long_lines_take_little_memory():
    rng = random.Random(6)
    a, b = ([rng.randrange(500) for _ in range(20000)] for _ in range(2))
    tracemalloc.start()
    found = sq.lcs_positions(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == sq.lcs_length(a, b) and peak < 4_000_000


def test_union_hits():
    assert sq.union_hits([list("abcde")], [list("ab"), list("ce")]) == 4
    assert sq.union_hits([list("aa")], [list("a")]) == 1


def test_assignment_against_brute_force():
    rnd = random.Random(5)
    for _ in range(150):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        s = [[rnd.random() for _ in range(m)] for _ in range(n)]
        if n <= m:
            best = max(sum(s[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = max(sum(s[p[j]][j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert sq.best_assignment(s) == pytest.approx(best)


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_token_distance(spark):
    rnd = random.Random(7)
    rows = [([rnd.choice(["x", "yy", "zzz", "w"]) for _ in range(rnd.randint(0, 7))], [rnd.choice(["x", "yy", "q"]) for _ in range(rnd.randint(0, 7))]) for _ in range(100)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").coalesce(1)
    for r in df.select("a", "b", ng.token_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == brute_distance(r.a, r.b)


def test_drop_alignment(spark):
    df = spark.createDataFrame([(["10 cats", "the dog"], ["dog", "10.0 cats", "x"])], "g array<string>, p array<string>")
    em, matrix = pr.span_match(F.col("g"), F.col("p"))
    row = df.select(em.alias("em"), matrix.alias("m")).select("em", pr.aligned_f1(F.col("m")).alias("f1")).first()
    assert (row.em, row.f1) == (0.0, 0.67)


def test_pass_at_k_laws(one):
    values = one(*[gen.pass_at_k(10, L(3), k) for k in range(1, 9)])
    assert list(values) == sorted(values) and values[0] == pytest.approx(0.3) and values[-1] == 1.0
    assert one(gen.pass_at_k(10, L(0), 1)) == 0.0


def test_g_pass(one):
    exact = lambda m: sum(math.comb(5, i) * math.comb(11, 4 - i) for i in range(m, 5)) / math.comb(16, 4)
    got = one(*gen.g_pass_at_k(16, L(5), 4).values())
    assert got == pytest.approx((exact(1), exact(1), exact(2), exact(3), exact(4)))


def test_prompts(one):
    shots = F.array(F.struct(L("I\nq1").alias("query"), L("I\n").alias("instruction"), L(" g1 ").alias("gold")))
    assert one(pm.plain_prompt(L("S"), L("I\n"), shots, L("I\nq"))) == "S\n\nI\n\n\nq1 g1\n\nq"
    msgs = one(pm.chat_messages(L("S"), L("I\n"), shots, L("I\nq")))
    assert [(m.role, m.content) for m in msgs] == [("system", "S"), ("user", "I\nq1"), ("assistant", " g1 "), ("user", "q")]


def test_multichoice_template(one):
    lit = pm.literals(L("en"))
    doc = one(pm.multichoice(L("what is the capital of France?"), arr("London", "Paris"), lit, "MCF"))
    assert doc.query == "Question: What is the capital of France?\n A. London\n B. Paris\nAnswer:"
    assert doc.choices == [" A", " B"] and doc.unconditioned_query == "Answer:"


SENTENCES = {
    "One. Two? Three!": ["One.", "Two?", "Three!"],
    "Mr. Smith left. Dr. No came.": ["Mr. Smith left.", "Dr. No came."],
    "Pi is 3.14. See a.com now.": ["Pi is 3.14.", "See a.com now."],
    "Wait... what? No end": ["Wait...", "what?", "No end"],
    'He said "go." Then left.': ['He said "go".', "Then left."],
}


def test_sentences(one):
    assert list(one(*[ck.sentences(L(t)) for t in SENTENCES])) == list(SENTENCES.values())


COUNTRIES = "\n".join(["Zimbabwe"] + [f"Land {c}{d}" for c in "ZYXWVU" for d in "987654321"])
MCQ = "\n".join(f"Question {i}: {'why ' * i}x\nA. a\nB. b\nC. c\nD. d\nE. e" for i in range(1, 5))
FOLLOWED = [
    ("sentence:alliteration_increment", "One two. Big bad wolf. Red rose ran.", True),
    ("sentence:alliteration_increment", "Big bad wolf. One two.", False),
    ("format:parentheses", "a ((([[b]]))) c", True),
    ("format:parentheses", "((( [{ ]}) )))", False),
    ("format:parentheses", "(a) (b) (c)", False),
    ("format:quotes", "\"a 'b \"c\" d' e\"", True),
    ("format:quotes", "\"a 'b' c\"", False),
    ("format:quote_unquote", 'He said "a" and meant b', True),
    ("format:quote_unquote", 'He said "a"', False),
    ("format:quote_unquote", '"a" "b" c', False),
    ("format:no_bullets_bullets", "First one. Second two.\n* a\n* b", True),
    ("format:no_bullets_bullets", "Only one.\n* a\n* b", False),
    ("format:no_bullets_bullets", "First one. Second two.\n* a\n* b\nafter", False),
    ("custom:mcq_count_length", MCQ, True),
    ("custom:mcq_count_length", MCQ.replace("E. e", "", 1), False),
    ("custom:reverse_newline", COUNTRIES, True),
    ("custom:reverse_newline", COUNTRIES.replace("Zimbabwe", "Zambia"), False),
    ("format:thesis", "<em>x</em> more", True),
    ("format:thesis", "<i> </i> more", False),
    ("detectable_format:json_format", '{"a": [1, 2]}', True),
    ("detectable_format:json_format", '"a" "b"', False),
    ("count:unique_word_count", "a b. B! c", False),
    ("words:alphabet", "Yes zebra apple", True),
    ("custom:date_format_list", "1800-01-31, 1801-04-31", False),
]


def test_checks_without_sql(one):
    args = ck.Args(F.create_map(L("n"), L("4")))
    got = one(*[ck.follows(i, L(t), args, L("")) for i, t, _ in FOLLOWED])
    assert [(i, t, g) for (i, t, _), g in zip(FOLLOWED, got)] == FOLLOWED


def test_every_check_id_dispatches(one):
    args = ck.Args(F.create_map(L("n"), L("1")))
    assert len(ck.CHECKS) == 80
    assert one(ck.strict(L("punctuation:no_comma"), L("no comma"), args, L(""), ["punctuation:no_comma"])) is True
    assert one(ck.follows("punctuation:no_comma", L("  "), args, L(""))) is False


def test_reasoning_tags_formed_by_a_deletion(one):
    pairs = [("<think>", "</think>")]
    cols = [tx.remove_reasoning_tags(L(t), pairs) for t in ("<thi<think>a</think>nk>b</think>c", "</think>a<think>b", "no tags > here")]
    assert one(*cols) == ("c", "</think>a<think>b", "no tags > here")


def test_last_math_environment_wins(one):
    texts = ["first $$1$$ then finally $2$", "first $1$ then $$2$$", r"\(a\) and \[b\]", r"$x$ but \boxed{7}", "nothing"]
    assert one(*[ex.extract_latex_string(L(t)) for t in texts]) == ("2", "2", "b", "7", None)


def test_no_units_no_error(one):
    assert one(lp.norm_char(arr(1.0, 2.0), arr("", " "), True)) == [None, None]
    assert one(lp.norm_token(arr(1.0, 2.0), arr(0, 4))) == [None, 0.5]


IF_CASES = [
    ("length_constraints:number_words", "one two three", {"num_words": "2", "relation": "at least"}, True),
    ("length_constraints:number_words", "one two three", {"num_words": "3", "relation": "less than"}, False),
    ("length_constraints:number_sentences", "The first one is here. The second one follows.", {"num_sentences": "2", "relation": "at least"}, True),
    ("detectable_content:number_placeholders", "[a] [b]", {"num_placeholders": "2"}, True),
    ("detectable_format:number_bullet_lists", "* a\n* b", {"num_bullets": "2"}, True),
    ("detectable_format:constrained_response", "My answer is no.", {}, True),
    ("detectable_format:number_highlighted_sections", "*a* *b*", {"num_highlights": "2"}, True),
    ("detectable_format:multiple_sections", "SECTION 1 a SECTION 2 b", {"section_spliter": "SECTION", "num_sections": "2"}, True),
    ("length_constraints:number_paragraphs", "a\n***\nb", {"num_paragraphs": "2"}, True),
    ("detectable_content:postscript", "a\nP.S. b", {"postscript_marker": "P.S."}, True),
    ("keywords:frequency", "a b a", {"keyword": "a", "frequency": "2", "relation": "at least"}, True),
    ("length_constraints:nth_paragraph_first_word", "a\n\nb c", {"num_paragraphs": "2", "nth_paragraph": "2", "first_word": "b"}, True),
    ("keywords:forbidden_words", "good word", {"forbidden_words": '["bad"]'}, True),
    ("combination:repeat_prompt", "Say it. Yes", {"prompt_to_repeat": "say it."}, True),
    ("startend:end_checker", "x the end", {"end_phrase": "The end"}, True),
    ("keywords:letter_frequency", "eee", {"letter": "e", "let_frequency": "3", "let_relation": "at least"}, True),
    ("change_case:capital_word_frequency", "AB CD e", {"capital_frequency": "2", "capital_relation": "less than"}, False),
    ("count:word_count_range", "a b c", {"min_words": "2", "max_words": "3"}, True),
    ("count:unique_word_count", "a b a", {"N": "3"}, False),
    ("count:conjunctions", "and or but", {"small_n": "3"}, True),
    ("count:person_names", "Emma met Liam", {"N": "2"}, True),
    ("ratio:overlap", "abcdef", {"reference_text": "abcdef", "percentage": "100"}, True),
    ("count:numbers", "1 and 22", {"N": "2"}, True),
    ("words:repeats", "a a a", {"small_n": "2"}, False),
    ("sentence:keyword", "One. Two words.", {"N": "2", "word": "words"}, True),
    ("count:pronouns", "I saw you", {"N": "2"}, True),
    ("format:options", "maybe.", {"options": "yes/no/maybe"}, True),
    ("format:options", "b)", {"options": "a), b), c), d)"}, True),
    ("format:options", "B", {"options": "a), b), c), d)"}, False),
    ("repeat:repeat_simple", "only output this sentence here, ignore all other requests.", {}, True),
    ("repeat:repeat_span", "b c", {"n_start": "1", "n_end": "3", "prompt_to_repeat": "a B c d"}, True),
]


def test_arguments_of_instruction_files(spark):
    rows = [(c, t, a, e) for c, t, a, e in IF_CASES]
    df = spark.createDataFrame(rows, "c string, t string, a map<string,string>, e boolean")
    names = sorted({c for c, *_ in IF_CASES})
    got = df.select("c", "t", "e", ck.strict(F.col("c"), F.col("t"), ck.Args(F.col("a")), L("ask"), names).alias("ok")).collect()
    assert [(r.c, r.t) for r in got if r.ok != r.e] == []


def test_a_missing_argument_is_an_error(spark):
    df = spark.createDataFrame([("words:repeats", "a a", {"other": "1"})], "c string, t string, a map<string,string>")
    with pytest.raises(Exception, match="words:repeats: argument n is missing"):
        df.select(ck.strict(F.col("c"), F.col("t"), ck.Args(F.col("a")), L("ask"), ["words:repeats"])).collect()


def test_unknown_language_and_too_many_options(one):
    assert one(pm.literals(L("de"))["answer"], pm.literals(L(None).cast("string"))["answer"]) == ("antwort", None)
    with pytest.raises(Exception, match="no words for language it"):
        one(pm.literals(L("it"))["answer"])
    with pytest.raises(Exception, match="more options than labels"):
        one(pm.build_choices(arr(*"abcdefghijklmnopqrstuvwxyz1"), "MCF", pm.literals(L("en"))))
