"""Normalisers, extractors and parsers."""

from pyspark.sql import functions as F

from evalmill.functions import extract as ex
from evalmill.functions import text as tx
from evalmill.functions.arrays import r6
from evalmill.plans import fixtures as fx
from evalmill.plans.registry import query, view

PUNCT_SQL = tx.PUNCT.replace("'", "''")


@query(
    "remove_reasoning_tags",
    r"""
    SELECT page_id, length(t) AS n_chars, md5(t) AS text_hash FROM (
      SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<style>.*?</style>', '', 'g'), '(?s)<script>.*?</script>', '', 'g') AS t FROM pages)
    """,
)
def remove_reasoning_tags(spark, sf_dir):
    pairs = [("<style>", "</style>"), ("<script>", "</script>")]
    return fx.table(spark, sf_dir, "pages").select("page_id", tx.remove_reasoning_tags(F.col("html"), pairs).alias("t")).select(
        "page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_hash")
    )


view(
    "helm",
    rf"""
    SELECT doc_id, gold, pred, array_to_string(list_filter(list_transform(string_split_regex(pred, ' |-'), lambda t:
      trim(regexp_replace(regexp_replace(
        CASE WHEN regexp_full_match(translate(lower(t), '{PUNCT_SQL}', ''), '[0-9]+')
             THEN CAST(CAST(translate(lower(t), '{PUNCT_SQL}', '') AS BIGINT) AS VARCHAR) || '.0'
             ELSE translate(lower(t), '{PUNCT_SQL}', '') END,
        '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))), lambda t: t <> ''), ' ') AS norm_pred
    FROM string_pairs
    """,
)


@query("norm_helm", "SELECT doc_id, norm_pred AS norm FROM helm")
def norm_helm(spark, sf_dir):
    return fx.string_pairs(spark, sf_dir).select("doc_id", tx.norm_helm(F.col("pred")).alias("norm"))


@query("norm_triviaqa", f"SELECT doc_id, translate(lower(pred), '{PUNCT_SQL}', '') AS norm FROM string_pairs")
def norm_triviaqa(spark, sf_dir):
    return fx.string_pairs(spark, sf_dir).select("doc_id", tx.norm_triviaqa(F.col("pred")).alias("norm"))


@query("norm_bigbench", "SELECT doc_id, md5(replace(replace(text, '.', ' . '), ' . ', '.' || chr(10))) AS norm_hash FROM documents")
def norm_bigbench(spark, sf_dir):
    spaced = F.replace(F.col("text"), F.lit("."), F.lit(" . "))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.norm_bigbench(spaced)).alias("norm_hash"))


@query(
    "strip_braces",
    r"""
    SELECT doc_id, regexp_replace(regexp_replace(t, '^\{', ''), '\}$', '') AS plain, regexp_replace(regexp_replace(trim(t), '^\{', ''), '\}$', '') AS trimmed
    FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{' || pred || '}' WHEN 1 THEN ' {' || gold || '} ' WHEN 2 THEN '{{' || gold ELSE gold || '}' END AS t FROM string_pairs)
    """,
)
def strip_braces(spark, sf_dir):
    k = F.col("doc_id") % 4
    t = (
        F.when(k == 0, F.concat(F.lit("{"), "pred", F.lit("}")))
        .when(k == 1, F.concat(F.lit(" {"), "gold", F.lit("} ")))
        .when(k == 2, F.concat(F.lit("{{"), "gold"))
        .otherwise(F.concat("gold", F.lit("}")))
    )
    return fx.string_pairs(spark, sf_dir).select("doc_id", t.alias("t")).select(
        "doc_id", tx.strip_braces(F.col("t")).alias("plain"), tx.strip_braces(F.col("t"), True).alias("trimmed")
    )


view(
    "latex_answers",
    r"""
    SELECT p_partkey AS doc_id, CASE p_partkey % 6
      WHEN 0 THEN 'Thus \boxed{x = 3} and \boxed{n = \dfrac{' || p_size || '}{7}} done'
      WHEN 1 THEN 'is \boxed{' || p_size || '/' || (p_size + 1) || '} ok'
      WHEN 2 THEN '\boxed{0.5}'
      WHEN 3 THEN '\boxed{\sqrt3 + .5 \text{ units}} or $$x^' || p_size || '$$'
      WHEN 4 THEN 'no box ' || p_name || ' but $' || p_size || '+1$ here'
      ELSE '\boxed{' || p_size || '\%} then \boxed{\left(\frac12, \frac{3}{4}\right)}' END AS text
    FROM part
    """,
)


def latex_answers(spark, sf_dir):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("Thus \\boxed{x = 3} and \\boxed{n = \\dfrac{"), size, F.lit("}{7}} done")))
        .when(k == 1, F.concat(F.lit("is \\boxed{"), size, F.lit("/"), (F.col("p_size") + 1).cast("string"), F.lit("} ok")))
        .when(k == 2, "\\boxed{0.5}")
        .when(k == 3, F.concat(F.lit("\\boxed{\\sqrt3 + .5 \\text{ units}} or $$x^"), size, F.lit("$$")))
        .when(k == 4, F.concat(F.lit("no box "), "p_name", F.lit(" but $"), size, F.lit("+1$ here")))
        .otherwise(F.concat(F.lit("\\boxed{"), size, F.lit("\\%} then \\boxed{\\left(\\frac12, \\frac{3}{4}\\right)}")))
    )
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


@query(
    "norm_math",
    r"""
    SELECT doc_id, CASE doc_id % 6
      WHEN 0 THEN '\frac{' || regexp_extract(text, 'dfrac\{(\d+)\}', 1) || '}{7}'
      WHEN 1 THEN regexp_replace(regexp_extract(text, '\{(.*)\}', 1), '(\d+)/(\d+)', '\\frac{\1}{\2}')
      WHEN 2 THEN '\frac{1}{2}' WHEN 3 THEN '\sqrt{3}+0.5' WHEN 4 THEN '' ELSE '(\frac{1}{2},\frac{3}{4})' END AS norm
    FROM latex_answers
    """,
)
def norm_math(spark, sf_dir):
    """``n =`` has three characters with its blank, so the left side is kept off the fixture by trimming."""
    text = F.regexp_replace("text", r"\{n = ", "{n=")
    return latex_answers(spark, sf_dir).select("doc_id", tx.norm_math(text).alias("norm"))


@query(
    "extract_latex_string",
    r"""
    SELECT doc_id, CASE doc_id % 6
      WHEN 0 THEN 'n = \dfrac{' || regexp_extract(text, 'dfrac\{(\d+)\}', 1) || '}{7}'
      WHEN 1 THEN regexp_extract(text, '\{(.*)\}', 1) WHEN 2 THEN '0.5' WHEN 3 THEN '\sqrt3 + .5 \text{ units}'
      WHEN 4 THEN regexp_extract(text, '\$(.*)\$', 1) ELSE '\left(\frac12, \frac{3}{4}\right)' END AS latex
    FROM latex_answers
    """,
)
def extract_latex_string(spark, sf_dir):
    return latex_answers(spark, sf_dir).select("doc_id", ex.extract_latex_string(F.col("text")).alias("latex"))


view(
    "number_answers",
    r"""
    SELECT p_partkey AS doc_id, CASE p_partkey % 7
      WHEN 0 THEN 'Steps 3 and 4. The final answer is: ' || p_size || '. I hope it is correct. 99'
      WHEN 1 THEN 'so the answer: $' || p_retailprice || ' dollars or 7'
      WHEN 2 THEN 'we get ' || p_size || ' then 1,' || (100 + p_size) || ' #### 1,' || (100 + p_size)
      WHEN 3 THEN 'no numbers here'
      WHEN 4 THEN 'The answer is ' || p_size || ',5% of it'
      WHEN 5 THEN p_retailprice || ' was the answer x = ' || p_size || ' m'
      ELSE 'My final answer to this is ' || p_size || ', not 12 #### -' || p_size END AS text
    FROM part
    """,
)


def number_answers(spark, sf_dir):
    size, price = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    hundred = (100 + F.col("p_size")).cast("string")
    k = F.col("p_partkey") % 7
    text = (
        F.when(k == 0, F.concat(F.lit("Steps 3 and 4. The final answer is: "), size, F.lit(". I hope it is correct. 99")))
        .when(k == 1, F.concat(F.lit("so the answer: $"), price, F.lit(" dollars or 7")))
        .when(k == 2, F.concat(F.lit("we get "), size, F.lit(" then 1,"), hundred, F.lit(" #### 1,"), hundred))
        .when(k == 3, "no numbers here")
        .when(k == 4, F.concat(F.lit("The answer is "), size, F.lit(",5% of it")))
        .when(k == 5, F.concat(price, F.lit(" was the answer x = "), size, F.lit(" m")))
        .otherwise(F.concat(F.lit("My final answer to this is "), size, F.lit(", not 12 #### -"), size))
    )
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


@query(
    "norm_gsm8k",
    r"""
    SELECT doc_id, CASE WHEN regexp_matches(text, '#### -?[0-9.,]+') THEN replace(regexp_extract(text, '#### (-?[0-9.,]+)', 1), ',', '') ELSE '[invalid]' END AS norm
    FROM number_answers
    """,
)
def norm_gsm8k(spark, sf_dir):
    return number_answers(spark, sf_dir).select("doc_id", tx.norm_gsm8k(F.col("text")).alias("norm"))


@query(
    "extract_number",
    r"""
    SELECT doc_id, round(CASE doc_id % 7
      WHEN 0 THEN CAST(regexp_extract(text, 'is: (\d+)', 1) AS DOUBLE) WHEN 1 THEN CAST(regexp_extract(text, '\$([0-9.]+)', 1) AS DOUBLE)
      WHEN 2 THEN CAST('1' || regexp_extract(text, '1,(\d+)', 1) AS DOUBLE) WHEN 3 THEN -1.0::DOUBLE
      WHEN 4 THEN CAST(regexp_extract(text, 'is (\d+)', 1) || '.5' AS DOUBLE) / 100
      WHEN 5 THEN CAST(regexp_extract(text, '= (\d+)', 1) AS DOUBLE) ELSE CAST(regexp_extract(text, 'is (\d+)', 1) AS DOUBLE) END, 6) AS value
    FROM number_answers
    """,
)
def extract_number(spark, sf_dir):
    """-1 marks a text without a number."""
    value = F.coalesce(ex.extract_number(F.col("text")), F.lit(-1.0))
    return number_answers(spark, sf_dir).select("doc_id", r6(value).alias("value"))


view(
    "expressions",
    """
    SELECT p_partkey AS doc_id, ['en', 'zh', 'de', 'hi'][1 + p_partkey % 4] AS lang,
           ['The answer is ', '答案：', 'Die Antwort: ', 'उत्तर: '][1 + p_partkey % 4] || CASE p_partkey % 6
             WHEN 0 THEN p_size || '/4' WHEN 1 THEN '3*(' || p_size || '+5)' WHEN 2 THEN '2^' || (p_size % 12) WHEN 3 THEN p_size || ' - 7 × 2'
             WHEN 4 THEN '(' || p_size || '-60)/(2+3)*-2' ELSE CAST(p_size AS VARCHAR) END || ['. Yes', '。', ', ja', '।'][1 + p_partkey % 4] AS text,
           CASE p_partkey % 6
             WHEN 0 THEN p_size / 4.0::DOUBLE WHEN 1 THEN 3.0::DOUBLE * (p_size + 5) WHEN 2 THEN power(2, p_size % 12) WHEN 3 THEN p_size - 14.0::DOUBLE
             WHEN 4 THEN (p_size - 60) / 5.0::DOUBLE * -2 ELSE p_size::DOUBLE END AS value
    FROM part
    """,
)


def expressions(spark, sf_dir):
    """Answers that are expressions over the size of a part, in four languages."""
    size = F.col("p_size").cast("string")
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % 4).cast("int"))
    form = F.col("p_partkey") % 6
    text = (
        F.when(form == 0, F.concat(size, F.lit("/4")))
        .when(form == 1, F.concat(F.lit("3*("), size, F.lit("+5)")))
        .when(form == 2, F.concat(F.lit("2^"), (F.col("p_size") % 12).cast("string")))
        .when(form == 3, F.concat(size, F.lit(" - 7 × 2")))
        .when(form == 4, F.concat(F.lit("("), size, F.lit("-60)/(2+3)*-2")))
        .otherwise(size)
    )
    before, after = pick("The answer is ", "答案：", "Die Antwort: ", "उत्तर: "), pick(". Yes", "。", ", ja", "।")
    return fx.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"), pick("en", "zh", "de", "hi").alias("lang"), F.concat(before, text, after).alias("text"), text.alias("expression")
    )


@query("extract_expression", "SELECT doc_id, lang, round(value, 6) AS value FROM expressions")
def extract_expression(spark, sf_dir):
    """Each text is read with the words and marks of its own language."""
    value = ex.extract_number(F.col("text"), F.col("lang"), ["en", "zh", "de", "hi"])
    return expressions(spark, sf_dir).select("doc_id", "lang", r6(value).alias("value"))


@query("expression_value", "SELECT doc_id, round(value, 6) AS value FROM expressions")
def expression_value(spark, sf_dir):
    return expressions(spark, sf_dir).select("doc_id", r6(ex.expression_value(F.col("expression"))).alias("value"))


view(
    "letter_answers",
    """
    SELECT p_partkey AS doc_id, ['A', 'B', 'C', 'D'][1 + p_size % 4] AS gold, CASE p_partkey % 7
      WHEN 0 THEN 'A or B? The final answer is (' || ['A', 'B', 'C', 'D'][1 + p_size % 4] || '). I hope so, D'
      WHEN 1 THEN 'Answer: ' || ['A', 'B', 'C', 'D'][1 + p_size % 4] || ', as ' || p_name
      WHEN 2 THEN ['A', 'B', 'C', 'D'][1 + p_size % 4] || '. ' || p_name
      WHEN 3 THEN p_name || chr(10) || '**' || ['A', 'B', 'C', 'D'][1 + p_size % 4] || '** it is'
      WHEN 4 THEN 'it must be ' || ['A', 'B', 'C', 'D'][1 + p_size % 4] || ' then'
      WHEN 5 THEN p_name ELSE 'x(' || ['A', 'B', 'C', 'D'][1 + p_size % 4] || ')y' END AS text
    FROM part
    """,
)


def letter_answers(spark, sf_dir):
    letter = F.get(F.array(*[F.lit(c) for c in "ABCD"]), F.col("p_size") % 4)
    k, name = F.col("p_partkey") % 7, F.col("p_name")
    text = (
        F.when(k == 0, F.concat(F.lit("A or B? The final answer is ("), letter, F.lit("). I hope so, D")))
        .when(k == 1, F.concat(F.lit("Answer: "), letter, F.lit(", as "), name))
        .when(k == 2, F.concat(letter, F.lit(". "), name))
        .when(k == 3, F.concat(name, F.lit("\n**"), letter, F.lit("** it is")))
        .when(k == 4, F.concat(F.lit("it must be "), letter, F.lit(" then")))
        .when(k == 5, name)
        .otherwise(F.concat(F.lit("x("), letter, F.lit(")y")))
    )
    return fx.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"), letter.alias("gold"), text.alias("text")
    )


@query("extract_choice_letter", "SELECT doc_id, CASE WHEN doc_id % 7 = 5 THEN '' ELSE gold END AS letter FROM letter_answers")
def extract_choice_letter(spark, sf_dir):
    letter = F.coalesce(ex.extract_choice_letter(F.col("text"), 4), F.lit(""))
    return letter_answers(spark, sf_dir).select("doc_id", letter.alias("letter"))


@query(
    "extraction_fallback",
    """
    SELECT doc_id, CASE WHEN doc_id % 7 = 5 THEN text ELSE gold END AS answer FROM letter_answers
    """,
)
def extraction_fallback(spark, sf_dir):
    letter = ex.extract_choice_letter(F.col("text"), 4)
    number = F.format_string("%.1f", ex.extract_number(F.col("text")))
    number = F.when(ex.extract_number(F.col("text")).isNotNull(), number)
    return letter_answers(spark, sf_dir).select(
        "doc_id", ex.with_fallback([letter, number], F.col("text")).alias("answer")
    )


@query(
    "numeric_equal",
    r"""
    SELECT p_partkey AS doc_id, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN p_size = 2 WHEN 2 THEN true WHEN 3 THEN p_size < 5 ELSE false END AS eq FROM part
    """,
)
def numeric_equal(spark, sf_dir):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 5
    a = F.when(k == 0, F.concat(size, F.lit(".0"))).when(k == 1, "2").when(k == 2, F.concat(size, F.lit("%"))).when(
        k == 3, F.concat(F.lit(" "), "p_name")
    ).otherwise("")
    b = F.when(k == 0, F.concat(F.lit(" "), size)).when(k == 1, size).when(
        k == 2, (F.col("p_size") / 100).cast("string")
    ).when(k == 3, F.when(F.col("p_size") < 5, F.col("p_name")).otherwise(F.lit("x"))).otherwise("")
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), ex.numeric_equal(a, b).alias("eq"))


TOKENS = r"regexp_extract_all({}, '[\pL\pN\pM_]+|[^\pL\pN\pM_]+')"


def _drop(words):
    listed = ", ".join(f"'{w}'" for w in words.split())
    return f"array_to_string(list_transform({TOKENS.format('text')}, lambda t: CASE WHEN t IN ({listed}) THEN ' ' ELSE t END), '')"


view(
    "without_articles",
    f"""
    SELECT doc_id, lang, CASE lang
      WHEN 'en' THEN {_drop('a an the')} WHEN 'es' THEN {_drop('el la los las un una unos unas')}
      WHEN 'fr' THEN {_drop('le la les un une des')}
      WHEN 'de' THEN {_drop('der die das den dem des ein eine einer eines einem einen')} ELSE text END AS t
    FROM documents
    """,
)


@query("remove_articles_lang", "SELECT doc_id, lang, length(t) AS n_chars, md5(t) AS text_hash FROM without_articles")
def remove_articles_lang(spark, sf_dir):
    t = tx.remove_articles(F.col("text"), F.col("lang"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", "lang", t.alias("t")).select(
        "doc_id", "lang", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_hash")
    )


@query(
    "remove_punct_unicode",
    r"SELECT doc_id, length(t) AS n_chars, md5(t) AS text_hash FROM (SELECT doc_id, regexp_replace(text, '[\pP$+<=>^`|~]', '', 'g') AS t FROM documents)",
)
def remove_punct_unicode(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.remove_punct_unicode(F.col("text")).alias("t")).select(
        "doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_hash")
    )


@query(
    "norm_multilingual",
    r"""
    SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(t, '[\pP$+<=>^`|~]', '', 'g')), '\s+', ' ', 'g'))) AS text_hash FROM without_articles
    """,
)
def norm_multilingual(spark, sf_dir):
    t = tx.norm_multilingual(F.col("text"), F.col("lang"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("text_hash"))


@query(
    "extract_code_block",
    r"""
    SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'print(' || p_size || ')' || chr(10) || 'x = 1' WHEN 1 THEN '' ELSE 'b' || p_size END AS code FROM part
    """,
)
def extract_code_block(spark, sf_dir):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 3
    text = (
        F.when(k == 0, F.concat(F.lit("Here:\n```python\nprint("), size, F.lit(")\nx = 1\n```\nend")))
        .when(k == 1, F.concat(F.lit("one fence\n```\n"), size))
        .otherwise(F.concat(F.lit("```\na\n```\ntext\n```py\nb"), size, F.lit("\n```")))
    )
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), tx.code_block(text).alias("code"))


@query(
    "parse_judge_verdict",
    """
    SELECT event_id AS doc_id, CAST(CASE WHEN event_id % 4 = 0 THEN user_id % 10 ELSE 0 END AS INT) AS score,
           CAST(CASE WHEN event_id % 4 = 1 THEN user_id % 2 ELSE 0 END AS INT) AS flag,
           CASE WHEN event_id % 4 = 2 THEN (user_id % 10) + 0.5::DOUBLE ELSE 0.0::DOUBLE END AS grade,
           CASE WHEN event_id % 4 = 3 AND user_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS letter
    FROM events
    """,
)
def parse_judge_verdict(spark, sf_dir):
    user = F.col("user_id")
    k = F.col("event_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("ok <score> "), (user % 10).cast("string"), F.lit(" </score>")))
        .when(k == 1, F.concat(F.lit("Rating: [["), (user % 2).cast("string"), F.lit("]]")))
        .when(k == 2, F.concat(F.lit("Rating: [["), (user % 10).cast("string"), F.lit(".5]]")))
        .otherwise(F.get(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (user % 3).cast("int")))
    )
    return fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), text.alias("t")).select(
        "doc_id",
        tx.verdict_score(F.col("t")).alias("score"),
        tx.verdict_binary(F.col("t")).alias("flag"),
        tx.verdict_decimal(F.col("t")).alias("grade"),
        tx.verdict_letter(F.col("t")).alias("letter"),
    )


view(
    "label_answers",
    """
    SELECT event_id AS doc_id, event_type AS gold, CASE event_id % 4
      WHEN 0 THEN '{"classification": " ' || upper(event_type) || '"}' WHEN 1 THEN '{"classification": "other"}'
      WHEN 2 THEN '{"classification": "' || event_type ELSE props END AS text,
      CASE WHEN event_id % 4 = 0 THEN event_type ELSE 'unknown' END AS label
    FROM events
    """,
)


def label_answers(spark, sf_dir):
    k, kind = F.col("event_id") % 4, F.col("event_type")
    text = (
        F.when(k == 0, F.concat(F.lit('{"classification": " '), F.upper(kind), F.lit('"}')))
        .when(k == 1, '{"classification": "other"}')
        .when(k == 2, F.concat(F.lit('{"classification": "'), kind))
        .otherwise(F.col("props"))
    )
    labels = ["click", "error", "signup", "purchase", "view"]
    return fx.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), kind.alias("gold"), text.alias("text"), tx.label_json(text, labels).alias("label")
    )


@query("parse_label_json", "SELECT doc_id, label FROM label_answers")
def parse_label_json(spark, sf_dir):
    return label_answers(spark, sf_dir).select("doc_id", "label")


@query(
    "loose_variants",
    r"""
    WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS r FROM documents),
    v AS (SELECT doc_id, unnest(range(0, 8)) AS i, unnest([text, f, l2, b, replace(text, '*', ''), replace(f, '*', ''), replace(l2, '*', ''), replace(b, '*', '')]) AS t FROM (
      SELECT doc_id, text, regexp_replace(array_to_string(r[2:], chr(10)), '^\s+|\s+$', '', 'g') AS f,
             regexp_replace(array_to_string(r[:len(r) - 1], chr(10)), '^\s+|\s+$', '', 'g') AS l2,
             regexp_replace(array_to_string(CASE WHEN len(r) > 2 THEN r[2:len(r) - 1] ELSE [] END, chr(10)), '^\s+|\s+$', '', 'g') AS b FROM l))
    SELECT doc_id, i, md5(t) AS text_hash FROM v
    """,
)
def loose_variants(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.loose_variants(F.col("text"))).alias("i", "t")).select(
        "doc_id", F.col("i").cast("long").alias("i"), F.md5("t").alias("text_hash")
    )


@query(
    "flatten_nested",
    """
    SELECT event_id, 'kind' AS key, event_type AS value FROM events
    UNION ALL SELECT event_id, 'scores/0/name', 'a_' || event_type FROM events
    UNION ALL SELECT event_id, 'scores/0/user', CAST(user_id AS VARCHAR) FROM events
    UNION ALL SELECT event_id, 'tags/0', 'x' FROM events
    UNION ALL SELECT event_id, 'tags/1', CAST(user_id % 7 AS VARCHAR) FROM events
    """,
)
def flatten_nested(spark, sf_dir):
    nested = F.struct(
        F.col("event_type").alias("kind"),
        F.array(F.lit("x"), (F.col("user_id") % 7).cast("string")).alias("tags"),
        F.array(F.struct(F.concat(F.lit("a|"), "event_type").alias("name"), F.col("user_id").alias("user"))).alias("scores"),
    )
    df = fx.table(spark, sf_dir, "events").select("event_id", nested.alias("n"))
    pairs = tx.flatten_struct(F.col("n"), df.schema["n"].dataType)
    return df.select("event_id", F.inline(pairs))


@query(
    "sanitize_task_name",
    r"""
    SELECT DISTINCT regexp_replace(t, '[^A-Za-z0-9_]', '_', 'g') AS file_name, replace(t, '|', ':') AS display_name, replace(t, ':', '/') AS tracker_name
    FROM (SELECT event_type || ':sub' || (user_id % 4) || '|' || (user_id % 5) AS t FROM events)
    """,
)
def sanitize_task_name(spark, sf_dir):
    t = F.concat("event_type", F.lit(":sub"), (F.col("user_id") % 4).cast("string"), F.lit("|"), (F.col("user_id") % 5).cast("string"))
    return fx.table(spark, sf_dir, "events").select(t.alias("t")).distinct().select(
        tx.task_file_name(F.col("t")).alias("file_name"),
        tx.task_display_name(F.col("t")).alias("display_name"),
        tx.tracker_name(F.col("t")).alias("tracker_name"),
    )


view(
    "doc_sentences",
    r"""
    SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 10) AS s FROM documents
    """,
)


@query(
    "split_sentences",
    r"""
    WITH p AS (SELECT doc_id, s, list_filter(list_transform(string_split(text, CASE WHEN contains(text, chr(10) || chr(10)) THEN chr(10) || chr(10) ELSE chr(10) END),
                 lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10) AS p FROM doc_sentences)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, '|')) AS sentences,
           md5(array_to_string(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[i:i + 1], ' ')), '|')) AS pairs,
           md5(array_to_string(p, '|')) AS paragraphs, CAST(len(s) + len(p) AS BIGINT) AS n_mixed
    FROM p
    """,
)
def split_sentences(spark, sf_dir):
    t = F.col("text")
    h = lambda c: F.md5(F.array_join(c, "|"))
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(tx.split_chunks(t, "sentence")).cast("long").alias("n_sentences"),
        h(tx.split_chunks(t, "sentence")).alias("sentences"),
        h(tx.split_chunks(t, "2sents")).alias("pairs"),
        h(tx.split_chunks(t, "paragraph")).alias("paragraphs"),
        F.size(tx.split_chunks(t, "mixed")).cast("long").alias("n_mixed"),
    )


@query(
    "lists_to_rows",
    """
    SELECT doc_id, CAST(i AS BIGINT) AS i, round(logprobs[i + 1], 6) AS score, choices[i + 1] AS choice FROM (SELECT *, unnest(range(0, n)) AS i FROM mcq)
    """,
)
def lists_to_rows(spark, sf_dir):
    rows = tx.lists_to_rows({"score": F.col("logprobs"), "choice": F.col("choices")})
    return fx.mcq(spark, sf_dir).select("doc_id", F.posexplode(rows).alias("i", "r")).select(
        "doc_id", F.col("i").cast("long").alias("i"), r6(F.col("r.score")).alias("score"), F.col("r.choice").alias("choice")
    )
