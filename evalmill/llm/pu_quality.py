"""Quality classifier learned from trusted positives and unlabelled web text.

Positive-unlabelled learning: only positive labels are used. With the logistic loss l, the
prior p of good text, trusted positives P and unlabelled text U, the model minimises the
non-negative unbiased risk

    p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])

over a linear f of text measures. While the bracket is positive the risk is convex and each
round is a Newton step; if it turns negative, the round climbs the bracket instead (the
correction of non-negative PU learning). The prior is the least ratio, with a confidence
term, of the shares of U and P above a threshold of a P-against-U classifier fitted on other
rows than those it is read from.

Every round is one Spark job: partitions send sums of gradients and curvatures, which are
added by key. All texts are measured once, into a table of MEASURES numbers a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.common import held_out, staged
from evalmill.llm.words import Words, grams, read_words

# Byte classes, counted per text.
_CLASSES = ["other", "upper", "lower", "digit", "blank", "newline", "high", ".", ",", "!", "?", "|", "#", "$", "%", "&", "*", "quote", "bracket"]
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[9, 32]] = 4
_CLASS[[10, 11, 12, 13]] = 5
_CLASS[128:] = 6
for _k, _c in enumerate(".,!?|#$%&*"):
    _CLASS[ord(_c)] = 7 + _k
for _c in "\"'`":
    _CLASS[ord(_c)] = 17
for _c in "()[]{}<>":
    _CLASS[ord(_c)] = 18
_CONTINUES = np.arange(256) // 64 == 2

#: Numbers that describe a text; the last is the constant.
MEASURES = len(_CLASSES) + 12


def measure(words: Words) -> np.ndarray:
    """One row of MEASURES numbers per text of the chunk; an empty text gives finite numbers too."""
    docs, counts = len(words), np.diff(words.bounds)
    size = np.diff(words.offsets)
    of_byte = np.repeat(np.arange(docs), size)
    kinds = np.bincount(of_byte * len(_CLASSES) + _CLASS[words.data], minlength=docs * len(_CLASSES))
    kinds = kinds.reshape(docs, len(_CLASSES)).astype(np.float64)
    of_word = np.repeat(np.arange(docs), counts)
    n, letters = np.maximum(counts, 1), np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 6], 1)

    def per_word(flags):
        return np.bincount(of_word, weights=flags, minlength=docs) / n

    last = words.data[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    first = words.data[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    length = (words.ends - words.starts).astype(np.float64)
    same = np.zeros(len(of_word))
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (of_word[1:] == of_word[:-1])
    triples = grams(words.hashes, 3)
    distinct, top, fresh = np.ones(docs), np.zeros(docs), np.ones(docs)
    for k in np.flatnonzero(counts):
        _, each = np.unique(words.of(k), return_counts=True)
        distinct[k], top[k] = len(each) / counts[k], each.max() / counts[k]
        own = triples[words.bounds[k] : max(words.bounds[k + 1] - 2, words.bounds[k])]
        if len(own):
            fresh[k] = len(np.unique(own)) / len(own)
    share = kinds / np.maximum(size, 1)[:, None]
    columns = [
        *np.log(share + 1e-3).T,
        np.log1p(counts),
        per_word(length) / 10,
        np.log(per_word(length > 20) + 1e-2),
        np.log(per_word((_CLASS[last] == 7) | (_CLASS[last] == 9) | (_CLASS[last] == 10)) + 1e-2),
        np.log(per_word(np.isin(_CLASS[last], [0, 11, 12, 13, 14, 15, 16])) + 1e-2),
        np.log(per_word(_CLASS[first] == 1) + 1e-2),
        np.log(per_word(same) + 1e-2),
        distinct,
        np.log(top + 1e-2),
        np.log(1.001 - fresh),
        kinds[:, 1] / letters,
        np.ones(docs),
    ]
    return np.stack(columns, axis=1)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row, from the whole text."""

    def run(batches):
        for batch in batches:
            rows = [measure(words) for words in read_words(batch.column(1))]
            x = np.concatenate(rows).astype(np.float32) if rows else np.zeros((0, MEASURES), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, MEASURES, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), MEASURES)


def sums(train: DataFrame, part, fields: int) -> np.ndarray:
    """Add up ``part(x, positive)``, a vector of ``fields`` numbers, over all rows."""

    def run(batches):
        total = np.zeros(fields)
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(batch.column(0)), np.asarray(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(fields)), pa.array(total)], names=["k", "v"])

    rows = train.select("x", "positive").mapInArrow(run, "k long, v double")
    found = rows.groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(fields)
    out[found["k"].to_numpy()] = found["v"].to_numpy()
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def moments(train: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Mean and deviation of each measure, and the numbers of positive and unlabelled rows."""

    def part(x, positive):
        own = x[~positive]
        return np.concatenate([own.sum(0), (own * own).sum(0), [positive.sum(), len(own)]])

    s = sums(train, part, 2 * MEASURES + 2)
    n = max(s[-1], 1)
    mean = s[:MEASURES] / n
    spread = np.sqrt(np.maximum(s[MEASURES : 2 * MEASURES] / n - mean**2, 0))
    mean[-1], spread[-1] = 0, 1
    return mean, np.where(spread > 1e-9, spread, 1), int(s[-2]), int(s[-1])


def step_sums(train: DataFrame, w: np.ndarray, mean, spread) -> dict[str, np.ndarray]:
    """Risks, gradients and curvatures of both samples at ``w``."""
    d = MEASURES

    def part(x, positive):
        x = (x - mean) / spread
        f = x @ w
        up, s = np.logaddexp(0, -f), sigmoid(f)
        out = []
        for rows in (positive, ~positive):
            xr, sr = x[rows], s[rows]
            out += [[up[rows].sum(), np.logaddexp(0, f[rows]).sum()], ((sr - 1)[:, None] * xr).sum(0), (sr[:, None] * xr).sum(0), ((xr * (sr * (1 - sr))[:, None]).T @ xr).ravel()]
        return np.concatenate([np.asarray(o, dtype=np.float64) for o in out])

    size = 2 + 2 * d + d * d
    s = sums(train, part, 2 * size)
    found = {}
    for name, own in (("p", s[:size]), ("u", s[size:])):
        found |= {f"{name}+": own[0], f"{name}-": own[1], f"g{name}+": own[2 : 2 + d], f"g{name}-": own[2 + d : 2 + 2 * d], f"h{name}": own[2 + 2 * d :].reshape(d, d)}
    return found


def fit(train: DataFrame, prior: float | None, mean, spread, n_p: int, n_u: int, rounds: int, ridge: float) -> np.ndarray:
    """Weights that minimise the non-negative risk; without a prior, P against U with equal weights."""
    w, best, best_risk, stay = np.zeros(MEASURES), np.zeros(MEASURES), np.inf, 0
    hold = np.full(MEASURES, ridge)
    hold[-1] = 1e-9
    for _ in range(rounds):
        s = step_sums(train, w, mean, spread)
        p = {k: s[f"{k}"] / n_p for k in ("p+", "p-", "gp+", "gp-", "hp")}
        u = {k: s[f"{k}"] / n_u for k in ("u+", "u-", "gu+", "gu-", "hu")}
        penalty = float(hold @ (w * w)) / 2
        if prior is None:
            risk, slope, curve = p["p+"] + u["u-"], p["gp+"] + u["gu-"], p["hp"] + u["hu"]
            negative = 0.0
        else:
            negative = u["u-"] - prior * p["p-"]
            risk = prior * p["p+"] + max(0.0, negative)
            slope, curve = prior * (p["gp+"] - p["gp-"]) + u["gu-"], u["hu"]
        if risk + penalty < best_risk:
            best, best_risk, stay = w.copy(), risk + penalty, 0
        else:
            stay += 1
            if stay >= 2:
                break
        if negative < 0:
            w = w + 0.5 * (u["gu-"] - prior * p["gp-"])
            continue
        move = np.linalg.solve(curve + np.diag(hold + 1e-6), slope + hold * w)
        w = w - move * min(1.0, 4.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-3:
            break
    return best


def class_prior(rows: DataFrame, w: np.ndarray, mean, spread, sure: float = 0.1) -> float:
    """Share of positives among unlabelled rows: least ratio of the shares above a threshold."""
    bins = 2000

    def part(x, positive):
        at = np.minimum((sigmoid(((x - mean) / spread) @ w) * bins).astype(np.int64), bins - 1)
        return np.concatenate([np.bincount(at[positive], minlength=bins), np.bincount(at[~positive], minlength=bins)]).astype(np.float64)

    s = sums(rows, part, 2 * bins)
    p, u = np.cumsum(s[:bins][::-1]), np.cumsum(s[bins:][::-1])
    if not p[-1] or not u[-1]:
        return 0.5
    slack = np.sqrt(np.log(4 / sure) / 2) * (p[-1] ** -0.5 + u[-1] ** -0.5)
    qp, qu = p / p[-1], u / u[-1]
    ok = qp > 0
    at = int(np.argmin(qu[ok] / qp[ok] + slack / qp[ok]))
    return float(np.clip(qu[ok][at] / qp[ok][at], 0.05, 0.99))


def quality_scores(docs: DataFrame, labels: DataFrame, rounds: int = 16, ridge: float = 1e-4) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, quality): only rows of quality 1 outside the test fold are learned
    from, as trusted positives; all texts outside the test fold are the unlabelled sample.
    A document's own label, language, source or id never enters its score.

    A null text counts as empty; empty texts get a score like any other. Rows that repeat a
    doc_id are scored one by one; a document labelled several times is positive if one label
    is 1. A row without a doc_id is scored, is in no test fold and has no label. Without any
    positive or unlabelled text, every score is 0.5. Other columns are not read.
    """
    x = staged(measured(docs), "measures").withColumn("held_out", held_out(F.col("doc_id")))
    good = labels.filter((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    open_rows = x.filter("not held_out")
    train = staged(
        open_rows.join(good, "doc_id", "left_semi").select("doc_id", "x", F.lit(True).alias("positive"))
        .union(open_rows.select("doc_id", "x", F.lit(False))),
        "pu-train",
    )
    mean, spread, n_p, n_u = moments(train)
    w = np.zeros(MEASURES)
    if n_p and n_u:
        inner = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(True))
        contrast = fit(train.filter(inner), None, mean, spread, max(n_p // 2, 1), max(n_u // 2, 1), rounds, 1e-3)
        prior = class_prior(train.filter(~inner), contrast, mean, spread)
        w = fit(train, prior, mean, spread, n_p, n_u, rounds, ridge)

    def run(batches):
        for batch in batches:
            score = sigmoid(((matrix(batch.column(2)) - mean) / spread) @ w)
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return x.select("doc_id", "held_out", "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of the documents that are predicted good; rows without a doc_id stay."""
    bad = quality_scores(docs, labels).filter("predicted = 0").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
