"""Document building: prompts, templates, adapters, filters."""

from pyspark.sql import functions as F

from evalmill.functions import prompts as pm
from evalmill.functions.arrays import let
from evalmill.operators import docs as dc
from evalmill.plans import fixtures as fx
from evalmill.plans.registry import query, view

L = F.lit
NL = "chr(10)"


def cat(*parts):
    """Concat of Columns and text."""
    return F.concat(*[L(p) if isinstance(p, str) else p for p in parts])


view(
    "mcq_rows",
    """
    SELECT p_partkey AS id, ['en', 'fr', 'de', 'es', 'zh'][1 + p_partkey % 5] AS lang, 'part_' || lower(p_type) AS subject,
           'is ' || p_name || ' of kind ' || lower(p_type) || CASE p_partkey % 3 WHEN 0 THEN '?' WHEN 1 THEN '. ' ELSE '' END AS question,
           [lower(p_type), p_name || '.', 'size ' || p_size, lower(p_brand)] AS choices, CAST(p_size % 4 AS INT) AS gold,
           p_name || ' costs ' || p_retailprice || CASE p_partkey % 4 WHEN 0 THEN '.' WHEN 1 THEN ',' ELSE '' END AS context
    FROM part
    """,
)


def mcq_rows(spark, sf_dir):
    """Multiple choice rows in five languages from the part table."""
    k, kind, name = F.col("p_partkey"), F.lower("p_type"), F.col("p_name")
    langs = F.array(*[L(x) for x in ("en", "fr", "de", "es", "zh")])
    return fx.table(spark, sf_dir, "part").select(
        k.alias("id"),
        F.get(langs, (k % 5).cast("int")).alias("lang"),
        cat("part_", kind).alias("subject"),
        cat("is ", name, " of kind ", kind, F.when(k % 3 == 0, "?").when(k % 3 == 1, ". ").otherwise("")).alias("question"),
        F.array(kind, cat(name, "."), cat("size ", F.col("p_size").cast("string")), F.lower("p_brand")).alias("choices"),
        (F.col("p_size") % 4).cast("int").alias("gold"),
        cat(name, " costs ", F.col("p_retailprice").cast("string"), F.when(k % 4 == 0, ".").when(k % 4 == 1, ",").otherwise("")).alias("context"),
    )


def _joined(col, sep="|"):
    return F.array_join(col, sep)


def _doc_columns(df, doc, extra=()):
    """Flatten a template struct for output."""
    return df.select("id", *extra, doc.alias("d")).select(
        "id",
        *extra,
        F.col("d.query").alias("query"),
        _joined(F.col("d.choices")).alias("choices"),
        F.col("d.unconditioned_query").alias("uncond"),
    )


# --- building, filters, sampling ---------------------------------------------------


@query(
    "build_docs",
    """
    SELECT doc_id, 'Q: ' || text AS query, lang AS task, 100 AS generation_size FROM documents WHERE trim(text) <> ''
    """,
)
def build_docs(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents")
    text = F.when(F.trim("text") != "", cat("Q: ", F.col("text")))
    return dc.build_docs(rows, {"query": text, "task": F.col("lang")}, "doc_id", {"generation_size": 100})


@query("dedup_docs", "SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang")
def dedup_docs(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return dc.dedup_docs(rows, "doc_id", ["text", "lang"])


@query(
    "sample_docs",
    """
    SELECT task, doc_id FROM (SELECT lang AS task, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 20
    """,
)
def sample_docs(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("task"), "doc_id")
    return dc.sample_docs(docs, "task", "doc_id", 20)


@query("filter_has_answer", "SELECT id, question FROM mcq_rows WHERE gold = 1 OR id % 3 = 0")
def filter_has_answer(spark, sf_dir):
    hit = (F.col("gold") == 1) | (F.col("id") % 3 == 0)
    rows = mcq_rows(spark, sf_dir).withColumn("answers", F.when(hit, F.array(L(""), "question")).otherwise(F.array(L(""))))
    return dc.filter_has_answer(rows, "answers").select("id", "question")


@query("filter_label_in", "SELECT id, gold FROM mcq_rows WHERE gold IN (0, 2)")
def filter_label_in(spark, sf_dir):
    rows = mcq_rows(spark, sf_dir).withColumn("label", F.col("gold").cast("string"))
    return dc.filter_label_in(rows, "label", [0, 2]).select("id", "gold")


@query("filter_subset_equals", "SELECT id FROM mcq_rows WHERE subject = 'part_economy'")
def filter_subset_equals(spark, sf_dir):
    rows = mcq_rows(spark, sf_dir).withColumn("subject", cat("Exam/", F.upper(F.replace("subject", L("_"), L(" ")))))
    return dc.filter_subset_equals(rows, "subject", "part_economy").select("id")


@query("filter_all_nonempty", "SELECT id FROM mcq_rows WHERE id % 4 <> 2")
def filter_all_nonempty(spark, sf_dir):
    choices = F.transform("choices", lambda c, i: F.when((i == 3) & (F.col("id") % 4 == 2), "  ").otherwise(c))
    return dc.filter_all_nonempty(mcq_rows(spark, sf_dir).withColumn("choices", choices), "choices").select("id")


@query("drop_image_rows", "SELECT id FROM mcq_rows WHERE id % 3 <> 1")
def drop_image_rows(spark, sf_dir):
    k = F.col("id") % 3
    rows = mcq_rows(spark, sf_dir).withColumn("image", F.when(k == 0, "").when(k == 1, "data:image/png"))
    return dc.drop_image_rows(rows, "image").select("id")


@query(
    "get_golds",
    "SELECT id, choices[gold + 1] || '|' || choices[1] AS golds, choices[2] || '|' || choices[gold + 1] || '|' || choices[1] AS nested FROM mcq_rows",
)
def get_golds(spark, sf_dir):
    ix = F.array("gold", L(0))
    nested = F.transform("choices", lambda c, i: F.array(c))
    nested = F.concat(nested, F.array(F.array(F.get("choices", L(1)), F.get("choices", F.col("gold")))))
    return mcq_rows(spark, sf_dir).select(
        "id",
        _joined(dc.get_golds(F.col("choices"), ix)).alias("golds"),
        _joined(dc.get_nested_golds(nested, F.array(L(4), L(0)))).alias("nested"),
    )


@query(
    "num_samples_max",
    """
    WITH s AS (SELECT 'brand:' || p_brand AS task, max(p_size) AS n FROM part GROUP BY p_brand)
    SELECT p_partkey AS doc_id, 'brand:' || p_brand AS task, greatest(coalesce(n, 1), 1) AS num_samples FROM part LEFT JOIN s ON s.task = 'brand:' || p_brand
    """,
)
def num_samples_max(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part").withColumn("task", cat("brand:", F.col("p_brand")))
    specs = part.select("task", F.col("p_size").alias("num_samples"))
    return dc.num_samples_max(part.select(F.col("p_partkey").alias("doc_id"), "task"), specs)


# --- plain prompts ----------------------------------------------------------------


@query(
    "mcq_letters_prompt",
    f"""
    SELECT id, 'The following are multiple choice questions (with answers) about ' || replace(subject, '_', ' ') || '.' || {NL} || {NL} || 'Question: ' || question
           || {NL} || 'A. ' || choices[1] || {NL} || 'B. ' || choices[2] || {NL} || 'C. ' || choices[3] || {NL} || 'D. ' || choices[4] || {NL} || 'Answer:' AS query, gold
    FROM mcq_rows
    """,
)
def mcq_letters_prompt(spark, sf_dir):
    letter = F.get(F.array(*[L(c) for c in "ABCD"]), F.col("gold"))
    return mcq_rows(spark, sf_dir).select(
        "id",
        pm.letters_prompt(F.col("subject"), F.col("question"), F.col("choices")).alias("query"),
        pm.letter_gold(letter).alias("gold"),
    )


@query(
    "qa_prompt",
    f"SELECT id, 'Question: ' || question || {NL} || 'Answer:' AS query, ' ' || array_to_string(choices, '| ') AS choices, gold FROM mcq_rows",
)
def qa_prompt(spark, sf_dir):
    labels = F.array(*[L(c) for c in "1234"])
    key = F.get(labels, F.col("gold"))
    return mcq_rows(spark, sf_dir).select(
        "id",
        pm.qa_prompt(F.col("question")).alias("query"),
        _joined(F.transform("choices", lambda c: cat(" ", c))).alias("choices"),
        (F.array_position(labels, key) - 1).cast("int").alias("gold"),
    )


# --- language templates -------------------------------------------------------------

LIT_SQL = """
    SELECT * FROM (VALUES
      ('en', 'Question', 'Answer', 'right', 'Yes', 'No', 'Also', 'because', 'therefore', 'or', 'True', 'False', 'Neither', '.', ',', '?', ' ', ':'),
      ('fr', 'Question', 'Réponse', 'n''est-ce pas', 'Oui', 'Non', 'De plus', 'parce que', 'donc', 'ou', 'Vrai', 'Faux', 'Aucun des deux', '.', ',', '?', ' ', ':'),
      ('de', 'Frage', 'Antwort', 'richtig', 'Ja', 'Nein', 'Auch', 'weil', 'deshalb', 'oder', 'Wahr', 'Falsch', 'Weder noch', '.', ',', '?', ' ', ':'),
      ('es', 'Pregunta', 'Respuesta', 'cierto', 'Sí', 'No', 'También', 'porque', 'por lo tanto', 'o', 'Verdadero', 'Falso', 'Ninguno', '.', ',', '?', ' ', ':'),
      ('zh', '问题', '答案', '对吗', '是的', '不是', '而且', '因为', '所以', '或', '真', '假', '都不是', '。', '，', '？', '', '：'))
    AS t(lang, qw, aw, conf, yes, no, also, cause, effect, orw, tru, fal, nei, stop, comma, qm, sp, colon)
"""
view("lits", LIT_SQL)
CAP = "upper(left({0}, 1)) || substr({0}, 2)"
view(
    "tmpl",
    f"""
    SELECT m.*, t.*, rtrim(question) AS rq, rtrim(context) AS rc,
           {CAP.format("(CASE right(rtrim(question), 1) WHEN '?' THEN left(rtrim(question), length(rtrim(question)) - 1) || qm WHEN '.' THEN left(rtrim(question), length(rtrim(question)) - 1) || stop ELSE rtrim(question) END)")} AS q,
           {CAP.format("(CASE right(context, 1) WHEN '.' THEN left(context, length(context) - 1) || stop WHEN ',' THEN left(context, length(context) - 1) || comma ELSE context END)")} AS c,
           [{CAP.format('choices[1]')}, {CAP.format("left(choices[2], length(choices[2]) - 1)")} || stop, {CAP.format('choices[3]')}, {CAP.format('choices[4]')}] AS caps,
           [choices[1], left(choices[2], length(choices[2]) - 1) || stop, choices[3], choices[4]] AS lows
    FROM mcq_rows m JOIN lits t USING (lang)
    """,
)


def _options(col, prefix="['A', 'B', 'C', 'D']"):
    return f"array_to_string(list_transform(range(1, 5), lambda i: sp || {prefix}[i] || stop || sp || {col}[i]), {NL})"


LETTER_CHOICES = "array_to_string(list_transform(['A', 'B', 'C', 'D'], lambda x: sp || x), '|')"


def _texts(col):
    return f"array_to_string(list_transform({col}, lambda x: sp || x), '|')"


def _tmpl(spark, sf_dir):
    return mcq_rows(spark, sf_dir).withColumn("lit", pm.literals(F.col("lang")))


@query(
    "build_choices",
    f"""
    SELECT id, {_options('choices')} AS mcf, {_options('choices', "['1', '2', '3', '4']")} AS numbered, '' AS cf FROM tmpl
    """,
)
def build_choices(spark, sf_dir):
    c, lit = F.col("choices"), F.col("lit")
    return _tmpl(spark, sf_dir).select(
        "id",
        pm.build_choices(c, "MCF", lit).alias("mcf"),
        pm.build_choices(c, "Hybrid", lit, "Numbers").alias("numbered"),
        F.coalesce(pm.build_choices(c, "CF", lit), L("")).alias("cf"),
    )


@query("build_answers", f"SELECT id, {LETTER_CHOICES} AS mcf, {_texts('choices')} AS cf FROM tmpl")
def build_answers(spark, sf_dir):
    c, lit = F.col("choices"), F.col("lit")
    return _tmpl(spark, sf_dir).select(
        "id",
        _joined(pm.build_answers(c, "MCF", lit)).alias("mcf"),
        _joined(pm.build_answers(c, "CF", lit, sentence_space=False)).alias("cf"),
    )


@query(
    "choice_prefix",
    "SELECT id, ['A', 'B', 'C', 'D'][gold + 1] AS letter, CAST(gold + 1 AS VARCHAR) AS number, ['α', 'β', 'γ', 'δ'][gold + 1] AS native FROM mcq_rows",
)
def choice_prefix(spark, sf_dir):
    native = F.array(*[L(c) for c in "αβγδ"])
    pick = lambda kind, n=None: F.get(pm.choice_prefix(kind, native=n), F.col("gold"))
    return mcq_rows(spark, sf_dir).select(
        "id", pick("Letters").alias("letter"), pick("Numbers").alias("number"), pick("NativeLetters", native).alias("native")
    )


@query(
    "tmpl_multichoice",
    f"""
    SELECT id, c || {NL} || qw || colon || sp || q || {NL} || {_options('caps')} || {NL} || aw || colon AS query, {LETTER_CHOICES} AS choices, aw || colon AS uncond FROM tmpl
    """,
)
def tmpl_multichoice(spark, sf_dir):
    doc = pm.multichoice(F.col("question"), F.col("choices"), F.col("lit"), "MCF", F.col("context"))
    return _doc_columns(_tmpl(spark, sf_dir), doc)


ENDS = "right(c, 1) = stop"
CONT = f"list_transform(lows, lambda x: CASE WHEN {ENDS} THEN upper(left(x, 1)) ELSE lower(left(x, 1)) END || substr(x, 2))"


@query(
    "tmpl_continuation",
    f"""
    SELECT id, c AS query, {_texts(CONT)} AS choices, '' AS uncond, c || {NL} || {_options(CONT)} || {NL} || aw || colon AS mcf_query FROM tmpl
    """,
)
def tmpl_continuation(spark, sf_dir):
    args = (F.col("context"), F.col("choices"), F.col("lit"))
    df = _tmpl(spark, sf_dir).withColumn("mcf_query", pm.continuation(*args, "MCF")["query"])
    return _doc_columns(df, pm.continuation(*args, "CF"), ["mcf_query"])


@query(
    "tmpl_copa",
    f"""
    SELECT id, {CAP.format("rtrim(context, '.,')")} || sp || CASE WHEN gold % 2 = 0 THEN cause ELSE effect END AS query,
           {_texts("list_transform(lows[1:2], lambda x: lower(left(x, 1)) || substr(x, 2))")} AS choices, '' AS uncond FROM tmpl
    """,
)
def tmpl_copa(spark, sf_dir):
    kind = F.when(F.col("gold") % 2 == 0, "cause").otherwise("effect")
    doc = pm.copa(F.col("context"), kind, F.slice("choices", 1, 2), F.col("lit"), "CF")
    return _doc_columns(_tmpl(spark, sf_dir), doc)


@query(
    "tmpl_hellaswag",
    f"""
    SELECT id, {CAP.format('subject')} || ':' || {NL} || c || CASE WHEN {ENDS} THEN sp || {CAP.format('lows[3]')} ELSE sp || lows[3] END || '. x' AS query,
           {_texts("list_transform(lows[1:2], lambda x: lower(left(x, 1)) || substr(x, 2))")} AS choices, '' AS uncond
    FROM tmpl WHERE id % 5 <> 3
    """,
)
def tmpl_hellaswag(spark, sf_dir):
    """Second context carries a title mark; every fifth row has a blank ending and is dropped."""
    b = cat(F.get("choices", L(2)), " [title]x")
    endings = F.transform(
        F.slice("choices", 1, 2), lambda e, i: F.when((i == 1) & (F.col("id") % 5 == 3), "[header] ").otherwise(cat(e, "[step]"))
    )
    df = _tmpl(spark, sf_dir).withColumns({"b": b, "endings": endings})
    doc, keep = pm.hellaswag(F.col("subject"), F.col("context"), F.col("b"), F.col("endings"), F.col("lit"))
    return _doc_columns(df.filter(keep), doc)


@query(
    "tmpl_nli",
    f"""
    SELECT id, {CAP.format("rtrim(context, '.,')")} || sp || conf || qm AS query,
           sp || yes || comma || sp || lower(left(rq, 1)) || substr(rtrim(rq, '?.'), 2) || '|' || sp || also || comma || sp || lower(left(rq, 1)) || substr(rtrim(rq, '?.'), 2) || '|' || sp || no || comma || sp || lower(left(rq, 1)) || substr(rtrim(rq, '?.'), 2) AS choices,
           conf || qm AS uncond,
           c || {NL} || qw || colon || sp || q || {NL} || sp || 'A' || stop || sp || tru || {NL} || sp || 'B' || stop || sp || nei || {NL} || sp || 'C' || stop || sp || fal || {NL} || aw || colon AS mcf_query,
           c || {NL} || qw || colon || sp || {CAP.format("rtrim(rq, '?.')")} || sp || tru || comma || sp || fal || sp || orw || sp || nei || qm || {NL} || aw || colon AS hybrid_query
    FROM tmpl
    """,
)
def tmpl_nli(spark, sf_dir):
    relations = ["entailment", "neutral", "contradiction"]
    hypothesis = F.rtrim("question")
    args = (F.col("context"), hypothesis, relations, F.col("lit"))
    df = _tmpl(spark, sf_dir).withColumns(
        {"mcf_query": pm.nli(*args, "MCF")["query"], "hybrid_query": pm.nli(*args, "Hybrid")["query"]}
    )
    return _doc_columns(df, pm.nli(*args, "CF"), ["mcf_query", "hybrid_query"])


@query(
    "tmpl_boolq",
    f"""
    SELECT id, qw || colon || sp || q || {NL} || sp || 'A' || stop || sp || yes || {NL} || sp || 'B' || stop || sp || no || {NL} || aw || colon AS query,
           sp || 'A|' || sp || 'B' AS choices, aw || colon AS uncond, CASE WHEN gold = 1 THEN 0 ELSE 1 END AS gold_ix FROM tmpl
    """,
)
def tmpl_boolq(spark, sf_dir):
    df = _tmpl(spark, sf_dir).withColumn("gold_ix", F.when(F.col("gold") == 1, 0).otherwise(1))
    return _doc_columns(df, pm.boolq(F.col("question"), F.col("lit"), "MCF"), ["gold_ix"])


@query(
    "tmpl_qa",
    f"""
    SELECT id, qw || colon || sp || q || {NL} || aw || colon AS query, {_texts('caps')} AS choices, aw || colon AS uncond, '0,1,2,3' AS golds FROM tmpl
    """,
)
def tmpl_qa(spark, sf_dir):
    """Answers hold a repeat; all distinct ones are gold."""
    doc = pm.qa(F.col("question"), F.concat("choices", F.slice("choices", 1, 1)), F.col("lit"))
    golds = _joined(F.transform(doc["choices"], lambda c, i: i.cast("string")), ",")
    return _doc_columns(_tmpl(spark, sf_dir).withColumn("golds", golds), doc, ["golds"])


@query(
    "tmpl_translation",
    """
    SELECT id, 'EN: ' || upper(left(context, 1)) || substr(context, 2) || ' ' || upper(lang) || ':' AS query, ' ' || array_to_string(list_transform([caps[1], caps[2]], lambda x: x), '| ') AS choices, '' AS uncond
    FROM tmpl
    """,
)
def tmpl_translation(spark, sf_dir):
    """The context line ends the sentence space rule of English (colon at the end)."""
    english = pm.literals(L("en"))
    doc = pm.translation(F.col("context"), F.slice("choices", 1, 2), L("en"), F.col("lang"), english, F.col("lit"), english)
    return _doc_columns(_tmpl(spark, sf_dir), doc)


@query(
    "hellaswag_clean",
    r"""
    SELECT doc_id, md5(trim(replace(regexp_replace(replace(t, ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' '))) AS clean_hash
    FROM (SELECT doc_id, replace(replace(text, ', ', ' [title] '), '. ', ' [step]  ') AS t FROM documents)
    """,
)
def hellaswag_clean(spark, sf_dir):
    t = F.replace(F.replace("text", L(", "), L(" [title] ")), L(". "), L(" [step]  "))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.trim(pm.hellaswag_clean(t))).alias("clean_hash"))


@query(
    "fix_punct_caps",
    f"""
    SELECT id, {CAP.format('rq')} AS capital, lower(left(rq, 1)) || substr(rq, 2) AS small, right(q, 1) AS last, right(rq, 1) IN ('?', '.') AND lang <> 'zh' OR (lang = 'zh' AND false) AS ends,
           CASE WHEN {ENDS} THEN 'X' ELSE 'x' END AS cased FROM tmpl
    """,
)
def fix_punct_caps(spark, sf_dir):
    q, lit = F.rtrim("question"), F.col("lit")
    fixed = pm.fix_ending_punct(F.col("question"), lit)
    head = pm.capitalize(pm.fix_ending_punct(F.col("context"), lit))
    return _tmpl(spark, sf_dir).select(
        "id",
        pm.capitalize(q).alias("capital"),
        pm.decapitalize(q).alias("small"),
        F.right(fixed, L(1)).alias("last"),
        pm.ends_sentence(q, lit).alias("ends"),
        pm.fix_capitalization(head, L("x"), lit).alias("cased"),
    )


def _detok_sql():
    """The same fixed rules as SQL text."""
    out = "t"
    for is_pattern, old, new in pm.WIKITEXT_RULES:
        esc = lambda s: s.replace("'", "''")
        old_sql = f"'{esc(old)}'".replace("\n", "' || chr(10) || '")
        new_sql = f"'{esc(new)}'".replace("\n", "' || chr(10) || '")
        if is_pattern:
            out = f"regexp_replace({out}, {old_sql}, {new_sql.replace('$1', chr(92) + '1')}, 'g')"
        else:
            out = f"replace({out}, {old_sql}, {new_sql})"
    return out


@query(
    "wikitext_detok",
    f"SELECT doc_id, length({_detok_sql()}) AS n_chars, md5({_detok_sql()}) AS text_hash FROM (SELECT doc_id, replace(replace(replace(text, ',', ' , '), '.', ' . '), '-', ' @-@ ') AS t FROM documents)",
)
def wikitext_detok(spark, sf_dir):
    t = F.replace(F.replace(F.replace("text", L(","), L(" , ")), L("."), L(" . ")), L("-"), L(" @-@ "))
    return fx.table(spark, sf_dir, "documents").select("doc_id", pm.wikitext_detok(t).alias("t")).select(
        "doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_hash")
    )


@query(
    "drop_answers",
    """
    SELECT id, CASE gold WHEN 0 THEN 'size' WHEN 1 THEN choices[1] || ', ' || choices[3] ELSE '3 May 1999' END
           || CASE WHEN gold = 1 THEN '' ELSE '|' || choices[1] || ', ' || choices[3] END AS answers
    FROM mcq_rows
    """,
)
def drop_answers(spark, sf_dir):
    """Main answer by kind; the validated ones repeat it and add the spans."""
    g, c = F.col("gold"), F.col("choices")
    none = F.array().cast("array<string>")
    spans = F.array(F.get(c, L(0)), F.get(c, L(2)))
    date = F.struct(L("3").alias("day"), L("May").alias("month"), L("1999").alias("year"))
    answer = lambda number, s: F.struct(number.alias("number"), s.alias("spans"), date.alias("date"))
    main = answer(F.when(g == 0, "size").otherwise(""), F.when(g == 1, spans).otherwise(none))
    answers = pm.drop_answers(main, F.array(main, answer(L(""), spans)))
    return mcq_rows(spark, sf_dir).select("id", _joined(F.transform(answers, lambda a: F.array_join(a, ", "))).alias("answers"))


@query(
    "truthfulqa_choices",
    """
    SELECT id, ' ' || array_to_string(list_concat(choices, choices[1:3]), '| ') AS choices, 4 AS len_mc1, '0,4,' || CASE WHEN gold % 2 = 0 THEN '5' ELSE '6' END AS gold_index FROM mcq_rows
    """,
)
def truthfulqa_choices(spark, sf_dir):
    ones = lambda *xs: F.array(*[x if not isinstance(x, int) else L(x) for x in xs])
    even = (F.col("gold") % 2 == 0).cast("int")
    doc = pm.truthfulqa_choices(F.col("choices"), ones(1, 0, 0, 0), F.slice("choices", 1, 3), ones(1, even, 1 - even))
    return mcq_rows(spark, sf_dir).select("id", doc.alias("d")).select(
        "id", _joined(F.col("d.choices")).alias("choices"), F.col("d.len_mc1").alias("len_mc1"), _joined(F.col("d.gold_index"), ",").alias("gold_index")
    )


SLOT = "CAST(('0x' || substr(md5('slot:' || id), 1, 8))::BIGINT % {n} AS INT)"


@query(
    "permute_choices",
    f"""
    SELECT id, slot, array_to_string(list_concat(list_concat(choices[2:1 + slot], [choices[1]]), choices[2 + slot:]), '|') AS choices
    FROM (SELECT *, {SLOT.format(n=4)} AS slot FROM mcq_rows)
    """,
)
def permute_choices(spark, sf_dir):
    """The right answer goes to a slot drawn from the id's hash."""
    slot = pm.hash_slot(F.col("id"), 4)
    new = pm.insert_at(F.slice("choices", 2, 3), slot, F.get("choices", L(0)))
    return mcq_rows(spark, sf_dir).select("id", slot.alias("slot"), _joined(new).alias("choices"))


@query(
    "adapt_mcq_rows",
    f"""
    SELECT id, array_to_string(choices, '|') AS exam_choices, gold AS exam_gold, 'the' AS prefix_question, ' ' || array_to_string(choices[1:2], '| ') AS prefix_choices,
           CASE WHEN id % 3 = 0 THEN '' ELSE 'a ' || question || ' |' || choices[1] || ' end' END AS cloze, 'see ' || choices[1] || ' and ' || choices[2] AS filled
    FROM mcq_rows WHERE gold < 4
    """,
)
def adapt_mcq_rows(spark, sf_dir):
    """Label strip, digit and letter golds, common prefix, one-blank cloze, placeholders."""
    c, g = F.col("choices"), F.col("gold")
    letters = F.array(*[L(x) for x in "ABCD"])
    labelled = F.transform(c, lambda x, i: cat(F.get(letters, i), ". ", x))
    answer = F.when(F.col("id") % 2 == 0, (g + 1).cast("string")).otherwise(F.lower(F.get(letters, g)))
    prefixed = pm.without_common_prefix(F.transform(F.slice(c, 1, 2), lambda x: cat("the ", x)))
    shared = let(prefixed, lambda s: F.struct(s["question"].alias("question"), _joined(s["choices"]).alias("choices")))
    blanks = F.when(F.col("id") % 3 == 0, cat("no blank ", F.col("question"))).otherwise(cat("a ", F.col("question"), " _end"))
    gap = let(pm.cloze(blanks, c), lambda d: F.coalesce(cat(d["context"], "|", F.get(d["continuations"], L(0))), L("")))
    filled = pm.fill_placeholders(L("see [[placeholder]] and [[placeholder]]"), F.slice(c, 1, 3))
    # A small file holds much work a row: it is dealt to as many tasks as a shuffle has.
    rows = mcq_rows(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = rows.select(
        "id",
        _joined(pm.exam_choices(labelled)).alias("exam_choices"),
        pm.exam_gold(answer).alias("exam_gold"),
        shared.alias("shared"),
        gap.alias("cloze"),
        filled.alias("filled"),
    )
    return out.select(
        "id", "exam_choices", "exam_gold", F.col("shared.question").alias("prefix_question"), F.col("shared.choices").alias("prefix_choices"),
        "cloze", "filled",
    )


@query(
    "multichoice_to_single",
    f"""
    WITH r AS (SELECT id, CASE WHEN gold = 0 THEN choices ELSE list_transform(list_sort(list_transform([choices[2], choices[4], choices[1] || ', ' || choices[3]], lambda c: md5(id || ':' || c) || c)), lambda x: substr(x, 33)) END AS c,
                      choices[1] || ', ' || choices[3] AS right_answer, gold, choices FROM mcq_rows)
    SELECT id, array_to_string(c, '|') AS choices, CAST(CASE WHEN gold = 0 THEN 2 ELSE list_position(c, right_answer) - 1 END AS INT) AS gold,
           'alpha ' || choices[1] || '|beta;|gamma' AS marked
    FROM r
    """,
)
def multichoice_to_single(spark, sf_dir):
    """Options 0 and 2 are right, except where only option 2 is; marks are read back from the text."""
    golds = F.when(F.col("gold") == 0, F.array(L(2))).otherwise(F.array(L(0), L(2)))
    one = pm.to_single_choice(F.col("id"), F.col("choices"), golds, ", ")
    text = cat("Which? ①alpha ", F.get("choices", L(0)), " ② beta; ③gamma.")
    found = pm.marked_answers(text, F.array(L("①"), L("②"), L("③")))
    df = mcq_rows(spark, sf_dir).select("id", one.alias("one"), found.alias("found"))
    return df.select(
        "id",
        _joined(F.col("one.choices")).alias("choices"),
        F.col("one.gold").alias("gold"),
        F.concat_ws("|", *[F.col("found")[m] for m in "①②③"]).alias("marked"),
    )


@query(
    "glue_prompts",
    f"""
    SELECT id, CASE WHEN gold = 0 THEN 'For each snippet of text, label the sentiment of the text as positive or negative. The answer should be exactly ''A. positive'' or ''B. negative''' || {NL} || 'Sentence: ' || question || {NL} || 'Answer:'
                    WHEN gold = 1 THEN 'Please identify whether the sentence1 entails the sentence2. The answer should be exactly ''A. yes'' or ''B. no''' || {NL} || 'Sentence 1: ' || context || {NL} || 'Sentence 2: ' || question || {NL} || 'Answer:'
                    ELSE 'Please identify whether the premise entails the hypothesis. The answer should be exactly ''A. yes'', ''B. maybe'' or ''C. no''' || {NL} || 'Premise: ' || CASE WHEN gold = 2 THEN 'orig ' || context ELSE context END || {NL} || 'Hypothesis: ' || question || {NL} || 'Answer:' END AS prompt
    FROM mcq_rows
    """,
)
def glue_prompts(spark, sf_dir):
    g, q, c = F.col("gold"), F.col("question"), F.col("context")
    task = F.when(g == 0, "sst2").when(g == 1, "rte").otherwise("mnli")
    m = lambda *kv: F.create_map(*[L(x) if isinstance(x, str) else x for x in kv])
    record = (
        F.when(g == 0, m("sentence", q))
        .when(g == 1, m("sentence1", c, "sentence2", q))
        .when(g == 2, m("premise", c, "original_premise", cat("orig ", c), "hypothesis", q))
        .otherwise(m("premise", c, "hypothesis", q))
    )
    return mcq_rows(spark, sf_dir).select("id", pm.glue_prompt(task, record, original=True).alias("prompt"))


@query(
    "tqa_prompts",
    f"""
    SELECT id, CASE WHEN gold = 0 THEN 'Q: ' || question || {NL} || {NL} || 'A:' ELSE 'Preset ' || gold || {NL} || {NL} || 'Q: ' || question END AS ask,
           CASE WHEN gold = 0 THEN 'Q: ' || question || {NL} || {NL} || 'A: ' || choices[1] ELSE 'Preset ' || gold || {NL} || {NL} || 'Q: ' || question || {NL} || 'A: ' || choices[1] END AS answered,
           'P' || {NL} || {NL} || 'Q: ' || question || {NL} || 'A1: ' || choices[1] || {NL} || 'A2: ' || choices[gold + 1] || CASE WHEN gold = 1 THEN '' ELSE '.' END AS compared,
           'Q: ' || question || {NL} || 'A: ' || choices[1] || {NL} || 'True:' AS judged
    FROM mcq_rows
    """,
)
def tqa_prompts(spark, sf_dir):
    q, c = F.col("question"), F.col("choices")
    preset = F.when(F.col("gold") > 0, cat("Preset ", F.col("gold").cast("string")))
    a = F.get(c, L(0))
    return mcq_rows(spark, sf_dir).select(
        "id",
        pm.preset_prompt(q, preset).alias("ask"),
        pm.preset_prompt(q, preset, a).alias("answered"),
        pm.comparison_prompt(q, a, F.get(c, F.col("gold")), "P").alias("compared"),
        pm.truth_prompt(q, a).alias("judged"),
    )


@query(
    "split_multi_answer",
    "SELECT id, choices[1] || '.|' || choices[2] || '|' || choices[3] || '.' AS answers, choices[gold + 1] || CASE WHEN gold = 1 THEN '' ELSE '.' END AS best FROM mcq_rows",
)
def split_multi_answer(spark, sf_dir):
    c = F.col("choices")
    text = cat(F.get(c, L(0)), ";  ", F.get(c, L(1)), " ;;", F.get(c, L(2)), "; ")
    return mcq_rows(spark, sf_dir).select(
        "id", _joined(pm.split_multi_answer(text)).alias("answers"), pm.format_best(cat(F.get(c, F.col("gold")), " ")).alias("best")
    )


def _shots(n=2):
    """Few-shot structs of a row: its own question with two of its choices as golds."""
    shot = lambda i: F.struct(
        cat("Do it. ", F.col("question"), str(i)).alias("query"), L("Do it.").alias("instruction"), cat(" ", F.get("choices", L(i))).alias("gold")
    )
    return F.array(*[shot(i) for i in range(n)])


SHOT = "trim(question || '{i}')"


@query(
    "plain_prompt",
    f"""
    SELECT id, CASE WHEN gold = 0 THEN 'SYS' || {NL} || {NL} ELSE '' END || 'Do it.' || {NL} || {NL} || trim(question || '0') || ' ' || choices[1] || {NL} || {NL} || trim(question || '1') || ' ' || choices[2] || {NL} || {NL} || trim(question) AS prompt
    FROM mcq_rows
    """,
)
def plain_prompt(spark, sf_dir):
    system = F.when(F.col("gold") == 0, "SYS")
    prompt = pm.plain_prompt(system, L("Do it."), _shots(), cat("Do it. ", F.col("question")))
    return mcq_rows(spark, sf_dir).select("id", prompt.alias("prompt"))


@query(
    "chat_messages",
    f"""
    SELECT id, CASE WHEN gold = 0 THEN 'system:SYS;' ELSE '' END || CASE WHEN gold < 2 THEN 'user:Do it.' || trim(question || '0') || ';assistant: ' || choices[1] || ';user:' || trim(question || '1') || ';assistant: ' || choices[2] || ';user:' || trim(question)
           ELSE 'user:Do it.' || trim(question) END AS messages FROM mcq_rows
    """,
)
def chat_messages(spark, sf_dir):
    system = F.when(F.col("gold") == 0, "SYS")
    shots = F.when(F.col("gold") < 2, _shots()).otherwise(F.slice(_shots(), 1, 0))
    msgs = pm.chat_messages(system, L("Do it."), shots, cat("Do it. ", F.col("question")))
    return mcq_rows(spark, sf_dir).select("id", _joined(F.transform(msgs, lambda m: F.concat(m["role"], L(":"), m["content"])), ";").alias("messages"))


@query("extract_query", "SELECT id, CASE WHEN gold = 0 THEN trim(question) ELSE question END AS q FROM mcq_rows")
def extract_query(spark, sf_dir):
    inst = F.when(F.col("gold") == 0, "Do it.").when(F.col("gold") == 1, "Other.")
    q = F.when(F.col("gold") == 0, cat("Do it. ", F.col("question"))).otherwise(F.col("question"))
    return mcq_rows(spark, sf_dir).select("id", pm.extract_query(q, inst).alias("q"))


@query(
    "truncate_tokens",
    "SELECT doc_id, md5(array_to_string(string_split(text, ' ')[1:50], ' ')) AS head, CAST(least(len(string_split(text, ' ')), 50) AS BIGINT) AS n FROM documents",
)
def truncate_tokens(spark, sf_dir):
    cut = dc.truncate_tokens(F.split("text", " ", -1), 50)
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(cut, " ")).alias("head"), F.size(cut).cast("long").alias("n"))


JUDGE = "[Question]\n{question}\n\n[Reference]\n{gold}\n\n[Options]\n{options}\n\n[Answer]\n{answer}\n\nRate it as <score> N </score>."


@query(
    "judge_prompts",
    f"""
    SELECT id, '[Question]' || {NL} || question || {NL} || {NL} || '[Reference]' || {NL} || choices[gold + 1] || {NL} || {NL} || '[Options]' || {NL} || array_to_string(choices, ', ') || {NL} || {NL} || '[Answer]' || {NL} || p_name || {NL} || {NL} || 'Rate it as <score> N </score>.' AS prompt
    FROM mcq_rows JOIN part ON id = p_partkey
    """,
)
def judge_prompts(spark, sf_dir):
    """Documents joined with their answers, then one template."""
    answers = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("answer"))
    rows = mcq_rows(spark, sf_dir).join(answers, "id")
    fields = {"question": F.col("question"), "gold": F.get("choices", F.col("gold")), "options": F.array_join("choices", ", "), "answer": F.col("answer")}
    return rows.select("id", pm.format_template(JUDGE, fields).alias("prompt"))


@query(
    "explode_questions",
    r"""
    WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS t FROM documents),
    e AS (SELECT doc_id, unnest(t) AS line, unnest(range(0, len(t))) AS i FROM s),
    q AS (SELECT doc_id, i, line, contains(line, ',') AS ask, count(*) FILTER (contains(line, ',')) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM e)
    SELECT doc_id, max(i) FILTER (ask) AS position, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT ask), '') || chr(10) || 'Question: ' || max(line) FILTER (ask) || chr(10) || 'Answer: ') AS query_hash,
           count(*) FILTER (NOT ask) AS n_facts
    FROM q GROUP BY doc_id, coalesce(g, 0) HAVING count(*) FILTER (ask) > 0
    """,
)
def explode_questions(spark, sf_dir):
    """Sentences with a comma are questions, the others facts; all inside the story's own row."""
    lines = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001", -1)
    df = fx.table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    kinds = F.transform("lines", lambda s: F.when(F.contains(s, L(",")), "question").otherwise("supporting fact"))
    df = df.withColumn("kinds", kinds)
    blocks = pm.question_blocks(F.col("kinds"), F.col("lines"))
    return df.select("doc_id", F.inline(blocks)).select(
        "doc_id", F.col("position").cast("long").alias("position"), F.md5("query").alias("query_hash"), F.col("n_facts").cast("long").alias("n_facts")
    )


@query("map_columns", "SELECT id, question AS q, gold AS label, upper(subject) AS topic FROM mcq_rows")
def map_columns(spark, sf_dir):
    return dc.map_columns(mcq_rows(spark, sf_dir), {"id": "id", "q": "question", "label": "gold", "topic": F.upper("subject")})


@query("perplexity_prompt", "SELECT doc_id, text AS query, lang AS task, true AS no_choices FROM documents")
def perplexity_prompt(spark, sf_dir):
    none = L(None).cast("array<string>")
    docs = dc.build_docs(
        fx.table(spark, sf_dir, "documents"), {"query": F.col("text"), "task": F.col("lang"), "choices": none}, "doc_id"
    )
    return docs.select("doc_id", "query", "task", F.col("choices").isNull().alias("no_choices"))


@query(
    "code_task_rows",
    f"""
    SELECT id, gold || '|x' AS inputs, 'out' || gold || '|y' AS outputs, CASE WHEN gold = 1 THEN 'solve' ELSE '' END AS fn_name,
           CASE WHEN gold = 2 THEN 1 ELSE 0 END AS has_starter,
           'You will be given a question (problem specification) and will generate a correct Python program that matches the specification and passes all tests.' || {NL} || {NL} || 'Question: ' || question || {NL} || {NL} AS head
    FROM mcq_rows
    """,
)
def code_task_rows(spark, sf_dir):
    g = F.col("gold").cast("string")
    tests = cat('[{"input": "', g, '", "output": "out', g, '", "testtype": "stdin"}, {"input": "x", "output": "y", "testtype": "stdin"}]')
    meta = F.when(F.col("gold") == 1, '{"func_name": "solve"}').otherwise("{}")
    starter = F.when(F.col("gold") == 2, "def f(): pass").otherwise("")
    prompt = pm.code_prompt(F.col("question"), starter)
    df = mcq_rows(spark, sf_dir).select("id", "question", pm.code_tests(tests, meta).alias("t"), prompt.alias("p"))
    return df.select(
        "id",
        _joined(F.col("t.inputs")).alias("inputs"),
        _joined(F.col("t.outputs")).alias("outputs"),
        F.coalesce("t.fn_name", L("")).alias("fn_name"),
        F.contains(F.col("p"), L("```python\ndef f(): pass\n```")).cast("int").alias("has_starter"),
        F.concat(F.substring_index("p", "\n\n", 2), L("\n\n")).alias("head"),
    )
