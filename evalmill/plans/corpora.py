"""Calibration mixes, token budgets, packing and task lists."""

from pyspark.sql import functions as F

from evalmill.functions.arrays import r6
from evalmill.operators import corpora as co
from evalmill.operators import corpus as cp
from evalmill.plans import fixtures as fx
from evalmill.plans.registry import query, view

L = F.lit
LANGS = ("de", "en", "es", "fr")


@query("union_categories", "SELECT doc_id, lang AS category, CASE WHEN lang = 'en' THEN source ELSE '' END AS note FROM documents")
def union_categories(spark, sf_dir):
    """One set has a column the others lack."""
    docs = fx.table(spark, sf_dir, "documents")
    sets = [
        docs.filter(F.col("lang") == x).select("doc_id", L(x).alias("category"), *([F.col("source").alias("note")] if x == "en" else []))
        for x in LANGS
    ]
    return co.union_sets(sets).fillna("", ["note"])


@query(
    "calibration_mix",
    """
    WITH s AS (SELECT doc_id, text AS question, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE source IN ('src0', 'src1', 'src2'))
    SELECT doc_id, md5(question) AS question_hash FROM s WHERE rn <= 16
    """,
)
def calibration_mix(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    sources = [(docs.filter(F.col("source") == s), "text") for s in ("src0", "src1", "src2")]
    return co.calibration_mix(sources, "doc_id", 48).select("doc_id", F.md5("question").alias("question_hash"))


@query(
    "chat_calibration",
    r"""
    WITH c AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY md5('42:' || conv_id), conv_id LIMIT 32),
    t AS (SELECT conv_id, string_agg('<' || role || '> ' || text, ' ' ORDER BY turn) AS x FROM conversations JOIN c USING (conv_id) GROUP BY conv_id)
    SELECT conv_id, CAST(least(len(string_split_regex(x, '\s+')), 64) AS BIGINT) AS n, md5(array_to_string(string_split_regex(x, '\s+')[1:64], ' ')) AS text_hash FROM t
    """,
)
def chat_calibration(spark, sf_dir):
    out = co.chat_calibration(fx.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", 32, 64)
    return out.select("conv_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("text_hash"))


view(
    "token_rows",
    r"""
    SELECT doc_id, t, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM (
      SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS t, unnest(range(0, len(string_split_regex(text, '\s+')))) AS i FROM documents)
    """,
)


def _stream(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.split("text", r"\s+", -1).alias("tokens"))


def _total(spark, sf_dir):
    """Number of all tokens."""
    return int(_stream(spark, sf_dir).agg(F.sum(F.size("tokens"))).first()[0])


BUDGET = "(SELECT count(*) // 2 FROM token_rows)"


@query(
    "token_budget",
    f"""
    SELECT doc_id, count(*) AS n_tokens, min(p) AS start, md5(string_agg(t, ' ' ORDER BY p)) AS token_hash FROM token_rows WHERE p < {BUDGET} GROUP BY doc_id
    """,
)
def token_budget(spark, sf_dir):
    out = co.token_budget(_stream(spark, sf_dir), "doc_id", "tokens", _total(spark, sf_dir) // 2)
    return out.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "start", F.md5(F.array_join("tokens", " ")).alias("token_hash"))


SPLIT = """
    WITH b AS (SELECT *, CAST(floor(0.9::DOUBLE * (SELECT count(*) FROM token_rows)) AS BIGINT) AS cut FROM token_rows),
    s AS (SELECT doc_id, t, CASE WHEN p < cut THEN 'train' ELSE 'val' END AS split, CASE WHEN p < cut THEN p ELSE p - cut END AS p FROM b)
"""


def _split(spark, sf_dir):
    total = _total(spark, sf_dir)
    stream = co.token_budget(_stream(spark, sf_dir), "doc_id", "tokens", total)
    return co.train_val_by_tokens(stream, "doc_id", "tokens", total)


@query("train_val_by_tokens", SPLIT + "SELECT split, doc_id, min(p) AS start, count(*) AS n_tokens FROM s GROUP BY split, doc_id")
def train_val_by_tokens(spark, sf_dir):
    return _split(spark, sf_dir).select("split", "doc_id", "start", F.size("tokens").cast("long").alias("n_tokens"))


@query(
    "pack_blocks",
    SPLIT
    + """
    SELECT split, p // 256 AS block, md5(string_agg(t, ' ' ORDER BY p)) AS block_hash FROM s GROUP BY split, p // 256 HAVING count(*) = 256
    """,
)
def pack_blocks(spark, sf_dir):
    out = co.pack_blocks(_split(spark, sf_dir), "split", "start", "tokens", 256)
    return out.select("split", "block", F.md5(F.array_join("tokens", " ")).alias("block_hash"))


@query(
    "block_perplexity",
    """
    WITH b AS (SELECT p, p // 256 AS block, length(t) / 10.0::DOUBLE AS nll, count(*) OVER (PARTITION BY p // 256) AS n FROM token_rows)
    SELECT round(exp(sum(nll) / count(*)), 6) AS perplexity, count(*) AS tokens FROM b WHERE n = 256 AND p % 256 > 0
    """,
)
def block_perplexity(spark, sf_dir):
    """Token cost is its length / 10; the first token of every block is not scored."""
    docs = _stream(spark, sf_dir)
    total = int(docs.agg(F.sum(F.size("tokens"))).first()[0])
    stream = co.token_budget(docs, "doc_id", "tokens", total).withColumn("split", L("all"))
    blocks = co.pack_blocks(stream, "split", "start", "tokens", 256)
    scored = F.slice("tokens", 2, 255)
    nll = F.aggregate(scored, L(0.0), lambda acc, t: acc + F.length(t) / 10.0)
    out = cp.block_perplexity(blocks.select(nll.alias("nll"), F.size(scored).alias("n")), "nll", "n")
    return out.select(r6(F.col("perplexity")).alias("perplexity"), "tokens")


@query("hash_split", "SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('42:' || doc_id), 1, 4) AS INT) < 65208 THEN 'train' ELSE 'test' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return co.hash_split(fx.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    "sweep_grid",
    """
    SELECT p_partkey, start, array_to_string(list_concat(range(0, start), range(start + 3, p_size)), ',') AS kept
    FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, unnest(range(0, p_size - 2)) AS start FROM part WHERE p_size >= 3)
    """,
)
def sweep_grid(spark, sf_dir):
    grid = co.sweep_grid(fx.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", 3)
    kept = F.array_join(F.col("kept").cast("array<string>"), ",")
    return grid.select("p_partkey", F.col("start").cast("long").alias("start"), kept.alias("kept"))


@query("distinct_task_list", "SELECT DISTINCT event_type || ':sub' || (user_id % 4) AS task, user_id % 3 AS shots FROM events")
def distinct_task_list(spark, sf_dir):
    user = F.col("user_id")
    return fx.table(spark, sf_dir, "events").select(
        F.concat("event_type", L(":sub"), (user % 4).cast("string")).alias("task"), (user % 3).alias("shots")
    ).distinct()


@query(
    "superset_members",
    """
    WITH a AS (SELECT DISTINCT CASE WHEN event_type = 'view' THEN 'view:only' ELSE event_type || ':sub' || (user_id % 4) END AS m FROM events),
    k AS (SELECT m, split_part(m, ':', 1) AS name, count(*) OVER (PARTITION BY split_part(m, ':', 1)) AS n FROM a)
    SELECT r.name AS task, coalesce(k.m, r.name) AS member FROM (SELECT DISTINCT event_type AS name FROM events) r LEFT JOIN k ON k.name = r.name AND k.n > 1
    """,
)
def superset_members(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id")
    events = fx.table(spark, sf_dir, "events")
    name = F.when(kind == "view", "view:only").otherwise(F.concat(kind, L(":sub"), (user % 4).cast("string")))
    available = events.select(name.alias("task")).distinct()
    return co.superset_members(events.select(kind.alias("task")).distinct(), available, "task")


@query("language_pairs", "SELECT a.lang AS source, b.lang AS target FROM (SELECT DISTINCT lang FROM documents) a, (SELECT DISTINCT lang FROM documents) b WHERE a.lang <> b.lang")
def language_pairs(spark, sf_dir):
    return co.language_pairs(fx.table(spark, sf_dir, "documents"), "lang")
