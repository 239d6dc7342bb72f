"""Source rows to documents: projection, filters, deduplication, sampling."""

from pyspark.sql import functions as F

from evalmill.functions.text import strip
from evalmill.operators.boards import top_per_task


def build_docs(rows, fields, identity, settings=None, keep=None):
    """Project rows to documents; rows without a query (or failing ``keep``) are dropped.

    ``fields`` maps document columns to Columns, ``settings`` adds task-level
    constants, the id is a stable key of the source.
    """
    docs = rows.select(
        F.col(identity).alias("doc_id"),
        *[c.alias(n) for n, c in fields.items()],
        *[F.lit(v).alias(n) for n, v in (settings or {}).items()],
        *([keep.alias("_keep")] if keep is not None else []),
    )
    ok = F.coalesce(F.col("query"), F.lit("")) != ""
    if keep is not None:
        return docs.filter(ok & F.col("_keep")).drop("_keep")
    return docs.filter(ok)


def dedup_docs(docs, identity, columns):
    """First document (by id) of every distinct content.

    Only (hash, id) is shuffled, combined map-side, so a group of copies
    holding a third of the rows arrives as one row per input task; whole rows
    are then kept by a semi join on the id.
    """
    content = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    first = docs.select(F.sha2(content, 256).alias("_h"), identity).groupBy("_h").agg(F.min(identity).alias(identity))
    return docs.join(first.select(identity), identity, "left_semi")


def sample_docs(docs, task, identity, n, seed=42):
    """First n documents of every task in hash order."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(identity).cast("string")))
    return top_per_task(docs, task, [digest, F.col(identity)], n)


def filter_has_answer(rows, answers):
    return rows.filter(F.exists(answers, lambda a: F.length(a) > 0))


def filter_label_in(rows, label, allowed):
    return rows.filter(F.col(label).try_cast("int").isin(list(allowed)))


def subset_key(col):
    """Subject in comparable form: lower case, blanks to underscores, text after the last slash."""
    return F.replace(F.lower(F.substring_index(col, "/", -1)), F.lit(" "), F.lit("_"))


def filter_subset_equals(rows, subject, wanted):
    return rows.filter(subset_key(F.col(subject)) == wanted)


def filter_all_nonempty(rows, choices):
    return rows.filter(F.forall(choices, lambda c: F.length(strip(c)) > 0))


def drop_image_rows(rows, image):
    return rows.filter(F.coalesce(F.col(image), F.lit("")) == "")


def get_golds(choices, gold_index):
    """Gold strings; choices that are lists themselves are flattened."""
    return F.transform(gold_index, lambda i: F.get(choices, i))


def get_nested_golds(choices, gold_index):
    return F.flatten(get_golds(choices, gold_index))


def num_samples_max(docs, specs, task="task", samples="num_samples"):
    """Generations needed per document: largest over the task's metrics, at least one."""
    need = specs.groupBy(task).agg(F.max(samples).alias("num_samples"))
    return docs.join(need, task, "left").withColumn("num_samples", F.greatest(F.coalesce("num_samples", F.lit(1)), F.lit(1)))


def map_columns(rows, adapter):
    """Adapter: target field -> source column name or Column."""
    return rows.select(*[(F.col(s) if isinstance(s, str) else s).alias(t) for t, s in adapter.items()])


def truncate_tokens(tokens, n):
    return F.slice(tokens, 1, n)
