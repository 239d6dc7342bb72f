"""Merkle manifests against plain hashing of the whole tree."""

import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from evalmill.llm.manifest import FIELDS, MANIFEST_SQL, document_manifest, fold, manifest, parents, resumed
from evalmill.llm.queries import op11_midstate_manifest

from .helpers import DOCS, SF, no_documents, odd_documents


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows, arity=2, n_chars=3):
    """[(row, leaf, subroot, root, proof, folded_root)] of rows in the order of FIELDS."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
        return out

    def path(tree, at):
        for level in tree[:-1]:
            first = at // arity * arity
            yield "".join(level[first:at]), "".join(level[at + 1 : first + arity])
            at //= arity

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    order = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    trees = {g: levels([leaf(r) for r in order[g]]) for g in names}
    crown = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, r in enumerate(order[g]):
            proof = [*path(trees[g], at), *path(crown, k)]
            told = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[n_chars] is not None:
                told[n_chars] += 1
            value = leaf(told)
            for left, right in proof:
                value = H(left, value, right)
            out.append((r, leaf(r), trees[g][-1][0], crown[-1][0], proof, value))
    return out


def compared(df, got, arity=2):
    rows = [tuple(r[f] for f in FIELDS) for r in df.collect()]
    want = sorted((str(r[0]), lf, sub, root, str(proof), value, value == root) for r, lf, sub, root, proof, value in plain(rows, arity))
    have = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, str([(p.left, p.right) for p in r.proof]), r.folded_root, r.verified) for r in got.collect())
    assert have == want


def tampering():
    from evalmill.llm.manifest import tampered

    return tampered()


def documents(spark, n):
    """Many rows of one language, one language of one row, a null language, gaps in the ids."""
    rows = [(k * 3, f"text {k} é", "en" if k % 3 else None, "s" if k % 5 else None, k if k % 4 else None) for k in range(n)]
    return spark.createDataFrame(rows + [(5, "x", "é", "s", 1), (6, "", "de", "", 0), (7, None, "de", "s", None)], DOCS)


def test_state_before_a_slot():
    digests = [H(str(k)) for k in range(7)]
    up, slots = parents(digests, 3)
    assert up == [H(*digests[:3]), H(*digests[3:6]), H(digests[6])]
    state, left, right = slots[4]
    assert (left, right) == (digests[3], digests[5])
    assert resumed(state, "new", right) == H(digests[3], "new", digests[5]) == fold("new", [(left, right)])
    assert resumed(state, digests[4], right) == up[1]  # the kept state is not used up


def test_small_pieces_over_several_tables(spark):
    df = documents(spark, 300).repartition(5)
    for piece in (2, 8, 4096):
        compared(df, manifest(df, "doc_id", "lang", FIELDS, tampering(), piece=piece))


def test_other_arity(spark):
    df = documents(spark, 90)
    compared(df, manifest(df, "doc_id", "lang", FIELDS, tampering(), arity=3, piece=9), 3)


def test_proofs_lead_to_the_root(spark):
    df = documents(spark, 40)
    for r in manifest(df, "doc_id", "lang", FIELDS).collect():
        assert fold(r.leaf, [(p.left, p.right) for p in r.proof]) == r.root == r.folded_root and r.verified


def test_odd_rows(spark):
    """Nulls, repeated rows and ids, long texts, clashing columns."""
    df = odd_documents(spark)
    for name in ("grp", "key", "digest", "path", "total", "value", "replacement"):
        df = df.withColumn(name, F.lit("?"))
    compared(df, manifest(df, "doc_id", "lang", FIELDS, tampering()))


def test_many_groups_and_one_row(spark):
    rows = [(k, "t", f"l{k % 50}", "s", 1) for k in range(120)]
    df = spark.createDataFrame(rows, DOCS)
    compared(df, manifest(df, "doc_id", "lang", FIELDS, tampering(), piece=4))
    one = spark.createDataFrame(rows[:1], DOCS)
    compared(one, manifest(one, "doc_id", "lang", FIELDS, tampering()))


def test_equal_rows_are_split_over_ranges(spark):
    df = spark.createDataFrame([(1, "t", "en", "s", 1)] * 400 + [(k, "u", "en", "s", 1) for k in range(30)], DOCS)
    compared(df, manifest(df, "doc_id", "lang", FIELDS, tampering(), piece=16))


def test_no_rows(spark):
    assert document_manifest(no_documents(spark)).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(MANIFEST_SQL).fetchall())
    got = sorted(tuple(r) for r in op11_midstate_manifest(spark, SF).collect())
    assert got == want and any(not r[-1] for r in got)
