"""Predictions against golds: match, overlap, distance and embedding metrics."""

from pyspark.sql import functions as F

from evalmill.functions import extract as ex
from evalmill.functions import ngrams as ng
from evalmill.functions import pairs as pr
from evalmill.functions import sequences as sq
from evalmill.functions import text as tx
from evalmill.functions.arrays import array_sum, let, r6
from evalmill.operators import textpairs as tp
from evalmill.plans import fixtures as fx
from evalmill.plans.registry import query, view
from evalmill.plans.strings import label_answers, letter_answers


def _one(col):
    return F.array(F.col(col))


@query(
    "exact_match",
    """
    SELECT doc_id, CAST(pred = gold AS INT) AS em, CAST(trim(pred) = trim(gold) AS INT) AS em_strip,
           CAST(starts_with(lower(trim(pred)), gold) AS INT) AS pem, CAST(ends_with(pred, split_part(gold, ' ', 2)) AS INT) AS sem,
           CAST(norm_pred = gold AS INT) AS qem
    FROM helm
    """,
)
def exact_match(spark, sf_dir):
    g, p = _one("gold"), _one("pred")
    last = F.array(F.lit("zzz"), F.split_part("gold", F.lit(" "), F.lit(2)))
    return fx.string_pairs(spark, sf_dir).select(
        "doc_id",
        pr.exact_match(g, p).alias("em"),
        pr.exact_match(g, p, strip_strings=True).alias("em_strip"),
        pr.exact_match(g, p, mode="prefix", strip_strings=True, norm_pred=F.lower).alias("pem"),
        pr.exact_match(last, p, mode="suffix").alias("sem"),
        pr.exact_match(g, p, norm_gold=tx.norm_helm, norm_pred=tx.norm_helm).alias("qem"),
    )


def _set_f1(a, b):
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {both} / (len({a}) + len({b})) END"


@query(
    "bow_f1",
    f"""
    SELECT doc_id, round({_set_f1('g', 'p')}, 6) AS f1, round({_set_f1('g', 'q')}, 6) AS quasi_f1 FROM (
      SELECT doc_id, list_distinct(list_filter(string_split(gold, ' '), lambda w: w <> '')) AS g,
             list_distinct(list_filter(string_split(pred, ' '), lambda w: w <> '')) AS p,
             list_distinct(list_filter(string_split(norm_pred, ' '), lambda w: w <> '')) AS q FROM helm)
    """,
)
def bow_f1(spark, sf_dir):
    g, p = _one("gold"), _one("pred")
    return fx.string_pairs(spark, sf_dir).select(
        "doc_id",
        r6(pr.bow_f1(g, p)).alias("f1"),
        r6(pr.bow_f1(g, p, tx.norm_helm, tx.norm_helm)).alias("quasi_f1"),
    )


@query(
    "quasi_f1_lang",
    rf"""
    SELECT doc_id, CAST(q = gold AS INT) AS em, round({_set_f1('gs', 'qs')}, 6) AS f1 FROM (
      SELECT doc_id, gold, q, list_distinct(string_split(gold, ' ')) AS gs, list_distinct(list_filter(string_split(q, ' '), lambda w: w <> '')) AS qs
      FROM (SELECT doc_id, gold, trim(regexp_replace(lower(regexp_replace(regexp_replace(pred, '\b(a|an|the)\b', ' ', 'g'), '[\pP$+<=>^`|~]', '', 'g')), '\s+', ' ', 'g')) AS q FROM string_pairs))
    """,
)
def quasi_f1_lang(spark, sf_dir):
    g, p = _one("gold"), _one("pred")
    norm = lambda c: tx.norm_multilingual(c, "en")
    return fx.string_pairs(spark, sf_dir).select(
        "doc_id", pr.exact_match(g, p, norm_gold=norm, norm_pred=norm).alias("em"), r6(pr.bow_f1(g, p, norm, norm)).alias("f1")
    )


@query(
    "drop_em_f1",
    rf"""
    WITH s AS (SELECT doc_id, string_split(gold, ' ') AS g, list_filter(string_split(norm_pred, ' '), lambda w: true) AS p,
                      len(string_split(pred, ' ')) AS n_spans FROM helm),
    c AS (SELECT doc_id, n_spans, list_sum(list_transform(list_distinct(g), lambda x: least(len(list_filter(g, lambda y: y = x)), len(list_filter(p, lambda y: y = x))))) AS hits, len(p) AS np FROM s)
    SELECT doc_id, CASE WHEN hits = 2 AND np = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em,
           round_even(hits::DOUBLE / greatest(2, n_spans), 2) AS f1
    FROM c
    """,
)
def drop_em_f1(spark, sf_dir):
    """Two one-word gold spans against the words of the prediction; blanks at its ends are empty spans."""
    df = fx.string_pairs(spark, sf_dir)
    em, matrix = pr.span_match(F.split("gold", " "), F.split("pred", " "))
    return df.select("doc_id", em.alias("em"), matrix.alias("m")).select("doc_id", "em", pr.aligned_f1(F.col("m")).alias("f1"))


@query(
    "extractive_match",
    "SELECT doc_id, CAST(doc_id % 7 <> 5 AS INT) AS hit FROM letter_answers",
)
def extractive_match(spark, sf_dir):
    """Letter from the prediction against the gold letter; the gold falls back to its raw text."""
    gold = ex.with_fallback([ex.extract_choice_letter(F.col("gold"), 4)], F.col("gold"))
    pred = ex.extract_choice_letter(F.col("text"), 4)
    hit = F.coalesce(ex.numeric_equal(gold, pred), F.lit(False)).cast("int")
    return letter_answers(spark, sf_dir).select("doc_id", hit.alias("hit"))


TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _gram_sql(source, n):
    return (
        f"SELECT doc_id, {n} AS n, array_to_string(t[i:i + {n - 1}], ' ') AS gram, side FROM "
        f"(SELECT doc_id, t, side, unnest(range(1, len(t) - {n - 2})) AS i FROM {source})"
    )


ROUGE = f"""
    WITH t AS (SELECT doc_id, {TOKENS.format('source')} AS t, 'g' AS side FROM text_pairs
               UNION ALL SELECT doc_id, {TOKENS.format('summary')}, 'p' FROM text_pairs),
    grams AS ({_gram_sql('t', 1)} UNION ALL {_gram_sql('t', 2)}),
    c AS (SELECT doc_id, n, gram, count(*) FILTER (side = 'g') AS g, count(*) FILTER (side = 'p') AS p FROM grams GROUP BY doc_id, n, gram),
    r AS (SELECT doc_id, n, CASE WHEN sum(least(g, p)) > 0 THEN 2.0::DOUBLE * sum(least(g, p)) / (sum(g) + sum(p)) ELSE 0.0::DOUBLE END AS f FROM c GROUP BY doc_id, n)
"""


def rouge_pairs(spark, sf_dir):
    """Per (doc_id, task, n) F-measure of the summary against its source, n = 1, 2."""
    pairs = fx.text_pairs(spark, sf_dir).select(
        "doc_id", "task", ng.alnum_tokens(F.col("source")).alias("g"), ng.alnum_tokens(F.col("summary")).alias("p")
    )
    sides = {s: [(F.col(c), " ", {n: n for n in (1, 2)})] for s, c in (("gold", "g"), ("pred", "p"))}
    stats = tp.ngram_overlap(pairs, ["doc_id", "task"], sides, by=["doc_id"])
    return stats.withColumn("f", pr.f_measure(F.col("match"), F.col("n_gold"), F.col("n_pred")))


@query(
    "rouge_n",
    ROUGE + "SELECT doc_id, round(max(f) FILTER (n = 1), 6) AS rouge1, round(coalesce(max(f) FILTER (n = 2), 0), 6) AS rouge2 FROM r GROUP BY doc_id",
)
def rouge_n(spark, sf_dir):
    f = F.col("f")
    return rouge_pairs(spark, sf_dir).groupBy("doc_id").agg(
        r6(F.max(F.when(F.col("n") == 1, f))).alias("rouge1"),
        r6(F.coalesce(F.max(F.when(F.col("n") == 2, f)), F.lit(0.0))).alias("rouge2"),
    )


@query(
    "rouge_t5",
    ROUGE + "SELECT lang AS task, n, round(avg(f) * 100, 6) AS score FROM r JOIN documents USING (doc_id) GROUP BY lang, n",
)
def rouge_t5(spark, sf_dir):
    """Point estimate x100 per task; its error comes from the bootstrap operator."""
    return rouge_pairs(spark, sf_dir).groupBy("task", "n").agg(r6(F.avg("f") * 100).alias("score"))


MEASURE = "CASE WHEN {m} > 0 THEN 2.0::DOUBLE * {m} / ({g} + {p}) ELSE 0.0::DOUBLE END"


@query(
    "rouge_t5_mid",
    f"""
    WITH b AS (SELECT doc_id, task, gold, pred, split_part(gold, ' ', 1) AS a, split_part(gold, ' ', 2) AS z FROM string_pairs),
    pairs AS (SELECT doc_id, task, a, z, 0 AS i, pred AS p FROM b UNION ALL SELECT doc_id, task, a, z, 1, task || ' . ' || gold FROM b
              UNION ALL SELECT doc_id, task, a, z, 2, z || ' . ' || a FROM b),
    t AS (SELECT doc_id, task, a, z, i, regexp_extract_all(lower(p), '[a-z0-9]+') AS p,
                 list_transform(string_split(replace(p, ' . ', '.' || chr(10)), chr(10)), lambda x: regexp_extract_all(lower(x), '[a-z0-9]+')) AS lines FROM pairs),
    m AS (SELECT *, len(list_filter(p, lambda x: x = a)) AS na, len(list_filter(p, lambda x: x = z)) AS nz,
                 CAST(len(list_filter(range(1, len(p)), lambda k: p[k] = a AND p[k + 1] = z)) > 0 AS INT) AS m2,
                 CASE WHEN len(list_filter(range(1, len(p) + 1), lambda k: p[k] = a AND list_contains(p[k + 1:], z))) > 0 THEN 2
                      WHEN list_contains(p, a) OR list_contains(p, z) THEN 1 ELSE 0 END AS ml FROM t),
    s AS (SELECT doc_id, task, i, {MEASURE.format(m="(CASE WHEN a = z THEN least(2, na) ELSE least(1, na) + least(1, nz) END)", g="2", p="len(p)")} AS f1,
                 {MEASURE.format(m="m2", g="1", p="len(p) - 1")} AS f2, {MEASURE.format(m="ml", g="2", p="len(p)")} AS fl,
                 {MEASURE.format(m="(CASE WHEN len(lines) = 1 OR ml = 2 AND i < 2 OR a = z THEN CASE WHEN i = 2 THEN 1 ELSE ml END ELSE least(1, na) + least(1, nz) END)", g="2", p="len(p)")} AS fs
          FROM m),
    l AS (SELECT doc_id, task, list(f1 ORDER BY i) AS f1, list(f2 ORDER BY i) AS f2, list(fl ORDER BY i) AS fl, list(fs ORDER BY i) AS fs FROM s GROUP BY doc_id, task),
    d AS (SELECT *, list_transform(range(0, 3), lambda j: CAST('0x' || substr(md5(doc_id || ':' || r || ':0'), 8 * j + 1, 8) AS BIGINT) % 3 + 1) AS d
          FROM (SELECT *, unnest(range(0, 1000)) AS r FROM l)),
    mid AS (SELECT doc_id, task, {", ".join(f"median(({f}[d[1]] + {f}[d[2]] + {f}[d[3]]) / 3) AS {f}" for f in ("f1", "f2", "fl", "fs"))} FROM d GROUP BY doc_id, task)
    SELECT task, round(100 * avg(f1), 6) AS "rouge1", round(100 * avg(f2), 6) AS "rouge2", round(100 * avg(fl), 6) AS "rougeL", round(100 * avg(fs), 6) AS "rougeLsum"
    FROM mid GROUP BY task
    """,
)
def rouge_t5_mid(spark, sf_dir):
    """Three pairs a sample: the prediction, the gold behind its task, the gold's words in turned lines."""
    df = fx.string_pairs(spark, sf_dir)
    turned = F.concat(F.split_part("gold", F.lit(" "), F.lit(2)), F.lit(" . "), F.split_part("gold", F.lit(" "), F.lit(1)))
    preds = F.array("pred", F.concat("task", F.lit(" . "), "gold"), turned)
    out = tp.rouge_t5(df.select("doc_id", "task", F.array_repeat("gold", F.lit(3)).alias("g"), preds.alias("p")), F.col("doc_id"), F.col("g"), F.col("p"))
    return out.groupBy("task").agg(*[r6(F.avg(c)).alias(c) for c in ("rouge1", "rouge2", "rougeL", "rougeLsum")])


@query(
    "rouge_l",
    """
    WITH t AS (SELECT doc_id, gold, string_split(gold, ' ') AS g, regexp_extract_all(lower(pred), '[a-z0-9]+') AS p FROM string_pairs),
    l AS (SELECT doc_id, len(g) + len(p) AS total, CASE
        WHEN len(list_filter(range(1, len(p) + 1), lambda i: p[i] = g[1] AND list_contains(p[i + 1:], g[2]))) > 0 THEN 2
        WHEN list_contains(p, g[1]) OR list_contains(p, g[2]) THEN 1 ELSE 0 END AS lcs FROM t)
    SELECT doc_id, round(2.0::DOUBLE * lcs / total, 6) AS rouge_l FROM l
    """,
)
def rouge_l(spark, sf_dir):
    df = fx.string_pairs(spark, sf_dir).select(
        "doc_id", ng.alnum_tokens(F.col("gold")).alias("g"), ng.alnum_tokens(F.col("pred")).alias("p")
    )
    lcs = df.select("doc_id", F.size("g").alias("ng"), F.size("p").alias("np"), sq.lcs_udf(F.col("g"), F.col("p")).alias("l"))
    return lcs.select("doc_id", r6(pr.f_measure(F.col("l"), F.col("ng"), F.col("np"))).alias("rouge_l"))


@query("rouge_lsum")
def rouge_lsum(spark, sf_dir):
    """Whole sources and summaries, line by line; checked against brute force in the tests."""
    lines = lambda c: F.filter(
        F.transform(F.split(c, "\n", -1), ng.alnum_tokens), lambda t: F.size(t) > 0
    )
    df = fx.text_pairs(spark, sf_dir).select("doc_id", lines("source").alias("g"), lines("summary").alias("p"))
    size = lambda c: F.size(F.flatten(c))
    hits = df.select("doc_id", size("g").alias("ng"), size("p").alias("np"), sq.union_lcs_udf(F.col("g"), F.col("p")).alias("h"))
    return hits.select("doc_id", r6(pr.f_measure(F.col("h"), F.col("ng"), F.col("np"))).alias("rouge_lsum"))


@query(
    "rouge_multi_gold",
    """
    WITH t AS (SELECT doc_id, gi, pi, regexp_extract_all(lower(CASE gi WHEN 0 THEN gold ELSE task || ' ' || gold END), '[a-z0-9]+') AS g,
                      regexp_extract_all(lower(CASE pi WHEN 0 THEN pred ELSE task END), '[a-z0-9]+') AS p
               FROM string_pairs, (VALUES (0), (1)) AS a(gi), (VALUES (0), (1)) AS b(pi)),
    s AS (SELECT doc_id, gi, pi, len(g) AS ng, len(p) AS np,
                 list_sum(list_transform(list_distinct(g), lambda w: least(len(list_filter(g, lambda x: x = w)), len(list_filter(p, lambda x: x = w))))) AS m FROM t),
    f AS (SELECT doc_id, pi, max(2.0::DOUBLE * m / (ng + np)) AS f FROM s GROUP BY doc_id, pi)
    SELECT doc_id, round(avg(f), 6) AS rouge1 FROM f GROUP BY doc_id
    """,
)
def rouge_multi_gold(spark, sf_dir):
    """Two golds and two predictions per document: best gold per prediction, then the mean."""
    df = fx.string_pairs(spark, sf_dir)
    rows = df.select("doc_id", F.posexplode(F.array("gold", F.concat_ws(" ", "task", "gold"))).alias("gi", "g"), "pred", "task")
    rows = rows.select("doc_id", "gi", "g", F.posexplode(F.array("pred", "task")).alias("pi", "p"))
    sides = {"gold": {1: ng.alnum_tokens(F.col("g"))}, "pred": {1: ng.alnum_tokens(F.col("p"))}}
    stats = tp.ngram_overlap(rows, ["doc_id", "gi", "pi"], sides, by=["doc_id"])
    best = stats.groupBy("doc_id", "pi").agg(F.max(pr.f_measure(F.col("match"), F.col("n_gold"), F.col("n_pred"))).alias("f"))
    return best.groupBy("doc_id").agg(r6(F.avg("f")).alias("rouge1"))


WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"


@query(
    "bleu_sentence",
    f"""
    WITH t AS (SELECT doc_id, {WORDS.format('summary')} AS t, 'p' AS side FROM text_pairs
               UNION ALL SELECT doc_id, {WORDS.format('source')}, 'a' FROM text_pairs
               UNION ALL SELECT doc_id, {WORDS.format("lower(summary) || ' end'")}, 'b' FROM text_pairs),
    grams AS ({" UNION ALL ".join(_gram_sql('t', n) for n in (1, 2, 3, 4))}),
    c AS (SELECT doc_id, n, gram, count(*) FILTER (side = 'p') AS p, greatest(count(*) FILTER (side = 'a'), count(*) FILTER (side = 'b')) AS g FROM grams GROUP BY doc_id, n, gram),
    o AS (SELECT doc_id, n, sum(least(g, p))::DOUBLE / greatest(sum(p), 1) AS pr FROM c GROUP BY doc_id, n),
    l AS (SELECT doc_id, max(len(t)) FILTER (side = 'p') AS lp, max(len(t)) FILTER (side = 'a') AS la, max(len(t)) FILTER (side = 'b') AS lb FROM t GROUP BY doc_id),
    b AS (SELECT doc_id, lp, CASE WHEN abs(la - lp) < abs(lb - lp) OR (abs(la - lp) = abs(lb - lp) AND la < lb) THEN la ELSE lb END AS ref FROM l),
    w AS (SELECT doc_id, CASE WHEN max(lp) > max(ref) THEN 1.0::DOUBLE ELSE exp(1 - max(ref)::DOUBLE / max(lp)) END AS bp,
                 {", ".join(f"coalesce(max(pr) FILTER (n = {n}), 0) AS p{n}" for n in (1, 2, 3, 4))}
          FROM b JOIN o USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, {", ".join(f"round(CASE WHEN p1 > 0 THEN bp * p{n} ELSE 0 END, 6) AS bleu_{n}" for n in (1, 2, 3, 4))} FROM w
    """,
)
def bleu_sentence(spark, sf_dir):
    """Golds: the source and a lower-cased copy of the summary with one word more."""
    df = fx.text_pairs(spark, sf_dir).select(
        "doc_id",
        tx.words(F.col("source")).alias("a"),
        tx.words(F.concat(F.lower("summary"), F.lit(" end"))).alias("b"),
        tx.words(F.col("summary")).alias("p"),
    )
    out = tp.bleu_single_order(df, ["doc_id"], [F.col("a"), F.col("b")], F.col("p"))
    return out.select("doc_id", *[r6(F.col(f"bleu_{n}")).alias(f"bleu_{n}") for n in (1, 2, 3, 4)])


@query(
    "string_distance",
    """
    WITH t AS (SELECT doc_id, list_filter(string_split(trim(pred), ' '), lambda w: w <> '') AS c, list_filter(string_split(substr(gold, 1, length(trim(pred))), ' '), lambda w: w <> '') AS r FROM string_pairs),
    e AS (SELECT doc_id, c, r, levenshtein(array_to_string(list_transform(c, lambda w: chr(CAST(65 + list_position(list_distinct(list_concat(c, r)), w) AS INT))), ''),
                                           array_to_string(list_transform(r, lambda w: chr(CAST(65 + list_position(list_distinct(list_concat(c, r)), w) AS INT))), '')) AS d FROM t)
    SELECT doc_id, CAST(d AS DOUBLE) AS edit_distance, round(1 - d::DOUBLE / greatest(len(c), len(r)), 6) AS edit_similarity,
           CAST(CASE WHEN c[1] <> r[1] THEN 0 WHEN len(c) < 2 OR len(r) < 2 OR c[2] <> r[2] THEN 1 ELSE 2 END AS DOUBLE) AS longest_common_prefix_length
    FROM e
    """,
)
def string_distance(spark, sf_dir):
    """Reference cut to the completion's length, then token distances."""
    completion = tx.strip(F.col("pred"))
    df = fx.string_pairs(spark, sf_dir).select(
        "doc_id",
        tx.words(completion).alias("c"),
        tx.words(F.substr("gold", F.lit(1), F.length(completion))).alias("r"),
    ).withColumn("d", ng.token_distance(F.col("c"), F.col("r")))
    longest = F.greatest(F.size("c"), F.size("r"))
    both = (F.size("c") > 0) & (F.size("r") > 0)
    return df.select(
        "doc_id",
        F.col("d").cast("double").alias("edit_distance"),
        r6(F.when(both, 1 - F.col("d") / longest).otherwise(F.lit(0.0))).alias("edit_similarity"),
        ng.common_prefix(F.col("c"), F.col("r")).cast("double").alias("longest_common_prefix_length"),
    )


@query("extractiveness")
def extractiveness(spark, sf_dir):
    """Coverage, density and compression of whole pairs; brute-force checked in the tests."""
    df = fx.text_pairs(spark, sf_dir).select(
        "doc_id", tx.words(F.lower("source")).alias("s"), tx.words(F.lower("summary")).alias("m")
    )
    df = df.select("doc_id", F.size("s").alias("ns"), F.size("m").alias("nm"), sq.fragments_udf(F.col("m"), F.col("s")).alias("f"))
    total = array_sum(F.col("f").cast("array<double>"))
    squares = array_sum(F.transform(F.col("f").cast("array<double>"), lambda x: x * x))
    per = lambda x: F.when(F.col("nm") > 0, x / F.col("nm")).otherwise(F.lit(0.0))
    return df.select(
        "doc_id",
        r6(per(total)).alias("coverage"),
        r6(per(squares)).alias("density"),
        r6(per(F.col("ns").cast("double"))).alias("compression"),
    )


@query(
    "ngram_novelty",
    f"""
    WITH t AS (SELECT doc_id, {WORDS.format('lower(summary)')} AS t, 'p' AS side FROM text_pairs UNION ALL SELECT doc_id, {WORDS.format('lower(source)')}, 'g' FROM text_pairs),
    grams AS ({" UNION ALL ".join(_gram_sql('t', n) for n in (1, 2, 3))}),
    c AS (SELECT doc_id, n, gram, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'g') AS g FROM grams GROUP BY doc_id, n, gram HAVING count(*) FILTER (side = 'p') > 0)
    SELECT doc_id, n, round(count(*) FILTER (g = 0)::DOUBLE / count(*), 6) AS novel, round(count(*) FILTER (p > 1)::DOUBLE / count(*), 6) AS repeated
    FROM c GROUP BY doc_id, n
    """,
)
def ngram_novelty(spark, sf_dir):
    """Rows only for orders the summary has; sets stay inside the row."""
    df = fx.text_pairs(spark, sf_dir).select(
        "doc_id", tx.words(F.lower("source")).alias("s"), tx.words(F.lower("summary")).alias("m")
    )

    def row(n):
        """Each array is built once and bound."""

        def shares(grams):
            def told(distinct):
                d = F.size(distinct)
                novel = F.try_divide(F.size(F.array_except(distinct, ng.ngrams(F.col("s"), n))), d)
                return F.struct(F.lit(n).alias("n"), d.alias("d"), novel.alias("novel"), F.try_divide(F.size(ng.repeated(grams)), d).alias("repeated"))

            return let(F.array_distinct(grams), told)

        return let(ng.ngrams(F.col("m"), n), shares)

    out = df.select("doc_id", F.explode(F.array(*[row(n) for n in (1, 2, 3)])).alias("r")).select("doc_id", "r.*").filter("d > 0")
    return out.select("doc_id", "n", r6(F.col("novel")).alias("novel"), r6(F.col("repeated")).alias("repeated"))


DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


@query(
    "greedy_embedding_match",
    f"""
    WITH v AS (SELECT CAST(floor(vec_id / 16) AS BIGINT) AS pair, vec_id % 2 AS side, vec_id, embedding AS e, 1.0::DOUBLE + label AS w FROM embeddings),
    s AS (SELECT r.pair, r.vec_id AS rt, r.w AS rw, h.vec_id AS ht, h.w AS hw,
                 {DOT.format(a='r.e', b='h.e')} / sqrt({DOT.format(a='r.e', b='r.e')} * {DOT.format(a='h.e', b='h.e')}) AS s
          FROM v r JOIN v h ON r.pair = h.pair AND r.side = 0 AND h.side = 1),
    p AS (SELECT pair, sum(s * w) / sum(w) AS precision FROM (SELECT pair, ht, max(s) AS s, max(hw) AS w FROM s GROUP BY pair, ht) GROUP BY pair),
    q AS (SELECT pair, sum(s * w) / sum(w) AS recall FROM (SELECT pair, rt, max(s) AS s, max(rw) AS w FROM s GROUP BY pair, rt) GROUP BY pair)
    SELECT pair, round(precision, 5) AS precision, round(recall, 5) AS recall, round(2 * precision * recall / (precision + recall), 5) AS f1 FROM p JOIN q USING (pair)
    """,
)
def greedy_embedding_match(spark, sf_dir):
    """Sixteen consecutive vectors are the tokens of one reference/prediction pair."""
    v = fx.table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 16).alias("pair"),
        (F.col("vec_id") % 2).alias("side"),
        "vec_id",
        "embedding",
        (1.0 + F.col("label")).alias("w"),
    )
    out = tp.greedy_embedding_match(v, "pair", "side", "vec_id", "embedding", "w")
    return out.select("pair", *[F.round(c, 5).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "faithfulness_from_nli",
    """
    WITH c AS (SELECT l_orderkey AS doc_id, l_suppkey % 3 AS g, max(l_discount) - max(l_tax) AS mx, avg(l_discount) - avg(l_tax) AS mn FROM lineitem GROUP BY l_orderkey, l_suppkey % 3)
    SELECT doc_id, round(avg(mx), 6) + 0.0::DOUBLE AS max_mean, round(min(mn), 6) + 0.0::DOUBLE AS mean_min FROM c GROUP BY doc_id
    """,
)
def faithfulness_from_nli(spark, sf_dir):
    nli = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 3).alias("gen_ix"), F.col("l_discount").alias("ent"), F.col("l_tax").alias("con")
    )
    settings = {"max_mean": ("max", "mean"), "mean_min": ("mean", "min")}
    out = tp.faithfulness(nli, "doc_id", "gen_ix", "ent", "con", settings)
    return out.select("doc_id", *[r6(F.col(c)).alias(c) for c in settings])


@query(
    "nli_pairs",
    r"""
    WITH c AS (SELECT t.doc_id, list_filter(string_split(regexp_replace(t.source, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 10) AS s,
                      list_filter(string_split(regexp_replace(t.summary, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 10) AS m FROM text_pairs t)
    SELECT doc_id, CAST(len(s) * len(m) AS BIGINT) AS n_pairs, CAST(list_sum(list_transform(s, lambda x: length(x))) * len(m) AS BIGINT) AS premise_chars
    FROM c WHERE len(s) > 0 AND len(m) > 0
    """,
)
def nli_pairs(spark, sf_dir):
    df = fx.text_pairs(spark, sf_dir)
    rows = tp.nli_pairs(df, tx.split_chunks(F.col("source"), "sentence"), tx.split_chunks(F.col("summary"), "sentence"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.sum(F.length("premise")).alias("premise_chars"))


@query(
    "label_match_group",
    "SELECT doc_id, CAST(label = gold AS INT) AS exact_match, CAST(label = 'unknown' AS INT) AS unknown, 1 AS total_samples FROM label_answers",
)
def label_match_group(spark, sf_dir):
    return label_answers(spark, sf_dir).select(
        "doc_id",
        (F.col("label") == F.lower("gold")).cast("int").alias("exact_match"),
        (F.col("label") == "unknown").cast("int").alias("unknown"),
        F.lit(1).alias("total_samples"),
    )
