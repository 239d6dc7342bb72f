"""Kernels no built-in expresses: LCS, shared fragments, span assignment.

Each is a pandas UDF over Arrow batches that loops inside the batch; joins,
grouping and averaging around them stay in Spark.
"""

import hashlib
import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a, b):
    """Length of the longest common subsequence, one bit per token of ``a``."""
    masks = {}
    for i, token in enumerate(a):
        masks[token] = masks.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & masks.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def lcs_positions(ref, cand):
    """Positions in ``ref`` of one longest common subsequence with ``cand``.

    Where two cells of the classic table tie, the walk back leaves the reference's token out. The
    table is never built: a row is one bit per token of ``cand``, set where the length does not
    grow. Every sqrt(n)-th row is kept, and the rows between are made again on the way back, so
    two lines of 20,000 words take about 2 MB. Along a row pair the lengths of the lower row
    exceed those above by 0 or 1, and change sides where the bits differ: the parity of the
    differing bits before a column tells which.
    """
    masks = {}
    for j, token in enumerate(cand):
        masks[token] = masks.get(token, 0) | (1 << j)
    full = (1 << len(cand)) - 1

    def below(row, token):
        hit = row & masks.get(token, 0)
        return ((row + hit) | (row - hit)) & full

    stride = math.isqrt(len(ref)) + 1
    kept, row = [], full
    for i, token in enumerate(ref):
        if i % stride == 0:
            kept.append(row)
        row = below(row, token)
    out, i, j = [], len(ref), len(cand)
    base = len(ref)
    rows = []
    while i and j:
        if i <= base:
            base = (i - 1) // stride * stride
            rows = [kept[base // stride]]
            for token in ref[base:i]:
                rows.append(below(rows[-1], token))
        if ref[i - 1] == cand[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif ((rows[i - base] ^ rows[i - 1 - base]) & ((1 << j) - 1)).bit_count() & 1:
            j -= 1
        else:
            i -= 1
    return out


def union_hits(ref_lines, cand_lines):
    """Reference tokens covered by the union of per-line subsequences, clipped by counts."""
    left_r, left_c = {}, {}
    for line in ref_lines:
        for t in line:
            left_r[t] = left_r.get(t, 0) + 1
    for line in cand_lines:
        for t in line:
            left_c[t] = left_c.get(t, 0) + 1
    hits = 0
    for line in ref_lines:
        covered = set()
        for other in cand_lines:
            covered.update(lcs_positions(line, other))
        for i in sorted(covered):
            t = line[i]
            if left_r.get(t, 0) > 0 and left_c.get(t, 0) > 0:
                hits += 1
                left_r[t] -= 1
                left_c[t] -= 1
    return hits


def rouge_matches(gold_lines, pred_lines):
    """Shared unigrams, bigrams, subsequence tokens and union hits, and the tokens of both sides."""
    gold, pred = ([t for line in lines for t in line] for lines in (gold_lines, pred_lines))
    pairs = [Counter(zip(side, side[1:])) for side in (gold, pred)]
    length = lcs_length(gold, pred) if len(gold) <= len(pred) else lcs_length(pred, gold)
    shared = [(Counter(gold) & Counter(pred)).total(), (pairs[0] & pairs[1]).total(), length, union_hits(gold_lines, pred_lines)]
    return [*shared, len(gold), len(pred)]


def fragments(summary, source):
    """Lengths of the greedy longest shared fragments, left to right in the summary."""
    where = {}
    for j, token in enumerate(source):
        where.setdefault(token, []).append(j)
    out, i = [], 0
    while i < len(summary):
        best, resume = 0, 0
        for j in where.get(summary[i], ()):
            if j < resume:
                continue
            n = 1
            while i + n < len(summary) and j + n < len(source) and summary[i + n] == source[j + n]:
                n += 1
            best = max(best, n)
            resume = j + n
        if best:
            out.append(best)
        i += max(best, 1)
    return out


def best_assignment(scores):
    """Largest sum over one-to-one pairings of rows and columns."""
    cost = -np.asarray([list(r) for r in scores], dtype=float)
    if cost.shape[0] > cost.shape[1]:
        cost = cost.T
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0] = i
        slack, back, done, j = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool), 0
        while True:
            done[j] = True
            free = ~done[1:]
            reduced = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = free & (reduced < slack[1:])
            slack[1:][better], back[1:][better] = reduced[better], j
            nxt = 1 + int(np.argmin(np.where(free, slack[1:], np.inf)))
            delta = slack[nxt]
            u[owner[done]] += delta
            v[done] -= delta
            slack[~done] -= delta
            j = nxt
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    return float(-sum(cost[owner[j] - 1, j - 1] for j in range(1, m + 1) if owner[j]))


def lcs_udf(ref, cand):
    """LCS length of two token array Columns."""

    @F.pandas_udf(T.LongType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(x, y) if len(x) <= len(y) else lcs_length(y, x) for x, y in zip(a, b)])

    return run(ref, cand)


def union_lcs_udf(ref_lines, cand_lines):
    """Union-LCS hits of two arrays of token lines."""

    @F.pandas_udf(T.LongType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([union_hits([list(r) for r in x], [list(c) for c in y]) for x, y in zip(a, b)])

    return run(ref_lines, cand_lines)


def rouge_matches_udf(golds, preds):
    """``rouge_matches`` of each gold with the prediction at its place, both as token lines."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        plain = lambda text: [list(line) for line in text]
        return pd.Series([[rouge_matches(plain(g), plain(p)) for g, p in zip(x, y)] for x, y in zip(a, b)])

    return run(golds, preds)


# Rotations and constants of md5.
MD5_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
MD5_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_words(blocks):
    """The four words (little-endian) of the md5 of each padded block of 64 bytes.

    ``blocks`` holds the 16 words of a block along its first axis; one that is None is 0 in all blocks.
    """
    shape = np.broadcast_shapes(*(w.shape for w in blocks if w is not None))
    a, b, c, d = (np.full(shape, x, dtype=np.uint32) for x in MD5_START)
    mixed, turned = np.empty(shape, dtype=np.uint32), np.empty(shape, dtype=np.uint32)
    for i in range(64):  # in place: the arrays stay in the cache
        turn, slot = divmod(i, 16)
        if turn == 0:
            np.bitwise_xor(c, d, out=mixed)
            np.bitwise_and(mixed, b, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
            word = slot
        elif turn == 1:
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_and(mixed, d, out=mixed)
            np.bitwise_xor(mixed, c, out=mixed)
            word = (5 * slot + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
            word = (3 * slot + 5) % 16
        else:
            np.bitwise_not(d, out=mixed)
            np.bitwise_or(mixed, b, out=mixed)
            np.bitwise_xor(mixed, c, out=mixed)
            word = 7 * slot % 16
        np.add(mixed, a, out=mixed)
        np.add(mixed, MD5_SINES[i], out=mixed)
        if blocks[word] is not None:
            np.add(mixed, blocks[word], out=mixed)
        left = MD5_TURNS[turn][slot % 4]
        np.left_shift(mixed, left, out=turned)
        np.right_shift(mixed, 32 - left, out=mixed)
        np.bitwise_or(mixed, turned, out=mixed)
        np.add(mixed, b, out=a)
        a, d, c, b = d, c, b, a
    return [x + np.uint32(y) for x, y in zip((a, b, c, d), MD5_START)]


@lru_cache(maxsize=64)
def _tails(samples, block, start):
    """Words of the ends of all messages of ``draws`` behind ``start`` bytes: separator, resample, block and padding."""
    ends = np.zeros((samples, 64), dtype=np.uint8)
    for r in range(samples):
        tail = f"{':' if start else ''}{r}:{block}".encode()
        ends[r, start : start + len(tail)] = np.frombuffer(tail, np.uint8)
        ends[r, start + len(tail)] = 0x80
        ends[r, 56:58] = np.frombuffer((8 * (start + len(tail))).to_bytes(2, "little"), np.uint8)
    return np.ascontiguousarray(ends.view("<u4").T)


def draws(identities, sizes, samples):
    """Per identity (bytes, None for null) ``samples`` resamples of ``size`` places below ``size``.

    Place k of resample r is the k % 4-th group of eight hex digits of md5("identity:r:(k // 4)"), modulo the
    size; a null identity is left out with its colon. Identities of one length are hashed together.
    """
    out = [None] * len(identities)
    groups = {}
    for at, (identity, size) in enumerate(zip(identities, sizes)):
        groups.setdefault((-1 if identity is None else len(identity), size), []).append(at)
    for (length, size), members in groups.items():
        for first in range(0, len(members), 8):  # 8 x 1000 lanes stay in the cache
            part = members[first : first + 8]
            found = np.empty((len(part), samples, (size + 3) // 4 * 4), dtype=np.int64)
            for block in range((size + 3) // 4):
                if 0 < length <= 40:
                    heads = np.zeros((len(part), 64), dtype=np.uint8)
                    heads[:, :length] = [list(identities[at]) for at in part]
                    heads, tails = heads.view("<u4"), _tails(samples, block, length)
                    words = [None if not (heads[:, w].any() or tails[w].any()) else heads[:, w, None] | tails[w] for w in range(16)]
                    digest = np.stack([x.byteswap() for x in md5_words(words)], axis=-1)
                else:
                    texts = [[identities[at], b"%d" % r, b"%d" % block] for at in part for r in range(samples)]
                    raw = b"".join(hashlib.md5(b":".join(t for t in text if t is not None)).digest() for text in texts)
                    digest = np.frombuffer(raw, ">u4").reshape(len(part), samples, 4)
                found[:, :, 4 * block : 4 * block + 4] = digest % np.uint32(size)
            for at, places in zip(part, found):
                out[at] = places[:, :size]
    return out


def resampled_medians(identities, scores, samples):
    """Per identity the median of the means of its resamples, for each of some score arrays of one length; nulls last."""
    sizes = [len(s[0]) if s[0] is not None else 0 for s in scores]
    many = [k for k, n in enumerate(sizes) if n > 1]
    out = [[s[0] for s in row] if n == 1 else None for row, n in zip(scores, sizes)]
    middle = [(samples - 1) // 2, samples // 2]
    for first in range(0, len(many), 64):
        part = many[first : first + 64]
        for k, places in zip(part, draws([identities[k] for k in part], [sizes[k] for k in part], samples)):
            row = np.array([[np.nan if x is None else x for x in values] for values in scores[k]], dtype=float)
            blank = np.array([[x is None for x in values] for values in scores[k]])
            total = np.zeros((len(row), samples))
            for at in range(sizes[k]):  # summed in the order of the draws
                total = total + row[:, places[:, at]]
            means = np.partition(total / sizes[k], middle, axis=1)[:, middle]
            value = (means[:, 0] + means[:, 1]) / 2
            if blank.any():  # a null mean sorts behind all numbers
                known = samples - blank[:, places].any(axis=2).sum(axis=1)
                out[k] = [float(v) if n > middle[1] else None for v, n in zip(value, known)]
            else:
                out[k] = value.tolist()
    return out


def medians_udf(identity, scores, samples):
    """``resampled_medians`` of the arrays of the Column ``scores``, an array of arrays; null without any."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(ids: pd.Series, rows: pd.Series) -> pd.Series:
        plain = [[None if s is None else list(s) for s in row] for row in rows]
        return pd.Series(resampled_medians([None if x is None else x.encode() for x in ids], plain, samples))

    return run(identity, scores)


def gram_counts(pred, golds, sizes):
    """Per size of run: matches clipped by the best gold, runs of the prediction, runs of the longest gold."""
    out = []
    for size in sizes:
        p, *gs = (Counter(u if size == 1 else zip(*(u[k:] for k in range(size)))) for u in (pred, *golds))
        best = gs[0]
        for other in gs[1:]:
            best = best | other  # the larger count of each run
        few, many = (p, best) if len(p) <= len(best) else (best, p)
        match = sum(min(n, many[x]) for x, n in few.items() if x in many)
        out.append([match, p.total(), max(g.total() for g in gs)])
    return out


def _lists(column, chunk=64):
    """The lists of strings of an Arrow column, made for a few rows at a time."""
    for first in range(0, len(column), chunk):
        part = column.slice(first, chunk)
        flat = part.flatten().to_numpy(zero_copy_only=False).tolist()
        at = 0
        for n in part.value_lengths().to_pylist():
            yield None if n is None else flat[at : at + n]
            at += n or 0


def gram_counts_udf(sizes, units):
    """``gram_counts`` of each row, for one or more kinds of units: Columns of the prediction and its golds, and sizes of runs.

    Null where an array of units is.
    """
    width = len(units[0])

    @F.arrow_udf("array<array<bigint>>")
    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for row in zip(*[_lists(c) for c in columns]):
            sides = [row[k : k + width] for k in range(0, len(row), width)]
            known = all(u is not None for u in row)
            out.append([x for (pred, *golds), own in zip(sides, sizes) for x in gram_counts(pred, golds, own)] if known else None)
        return pa.array(out, pa.list_(pa.list_(pa.int64())))

    return run(*[column for kind in units for column in kind])


def fragments_udf(summary, source):
    """Fragment lengths of a summary against its source."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fragments(list(x), list(y)) for x, y in zip(a, b)])

    return run(summary, source)


def assignment_udf(scores):
    """Best one-to-one sum over a score matrix Column."""

    @F.pandas_udf(T.DoubleType())
    def run(m: pd.Series) -> pd.Series:
        return pd.Series([best_assignment(x) for x in m])

    return run(scores)
