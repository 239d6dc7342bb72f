"""Merkle manifest of a table: a SHA-256 tree whose parents keep states of their hash.

Leaves are digests of rows. Per group they are placed by key; every ``arity`` consecutive
nodes (the last run may be shorter) are hashed into a parent until one is left, the subroot.
Subroots, placed by group, make one more tree with the root of the table.

A parent's hash reads its children from left to right. A copy of its state is kept before
each child's slot, with the digests that follow that child. Folding a changed leaf takes,
level by level, the state before its slot, adds the new digest and the siblings to the right
only; what stands to the left is in the state already.

On Spark a tree is cut into pieces of ``arity ** height`` neighbours. A piece is a subtree
that one task builds; the tops of pieces are the nodes of the next, much shorter table, and so
on. On the way down each piece gets the path from its top to the root, and builds its subtree
once more with states. Pieces are dealt by their hash, so a group of a third of all rows is
many pieces, and many small groups share a task. Places come from a range exchange by group
and key, counts of each range and their running sums.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.llm.common import staged, unstaged

ARITY = 2
#: Most leaves of a piece.
PIECE = 4096

PATH = "array<struct<left:string,right:string>>"
#: Columns of tree nodes; payload columns of leaves stand behind them.
NODE = "grp string, pos long, total long, digest string"


def row_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields in order: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def depth(total: int, arity: int) -> int:
    """Levels of hashes above ``total`` leaves."""
    levels = 0
    while total > 1:
        total, levels = -(-total // arity), levels + 1
    return levels


def steps(most: int, arity: int) -> int:
    """Levels of one piece."""
    return max(1, int(math.log(most, arity) + 1e-9))


def parents(below: list[str], arity: int) -> tuple[list[str], list[tuple]]:
    """Digests of the parents; and for each child the parent's state before its slot, the
    siblings to its left and those to its right."""
    up, slots = [], []
    for k in range(0, len(below), arity):
        run = below[k : k + arity]
        state = hashlib.sha256()
        for j, digest in enumerate(run):
            slots.append((state.copy(), "".join(run[:j]), "".join(run[j + 1 :])))
            state.update(digest.encode())
        up.append(state.hexdigest())
    return up, slots


def resumed(state, digest: str, right: str) -> str:
    """The parent's digest with ``digest`` in the slot that ``state`` stands before."""
    state = state.copy()
    state.update(digest.encode())
    state.update(right.encode())
    return state.hexdigest()


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings on its path (left, right) lead to."""
    for left, right in path:
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


def pieces(table: pa.Table, size: int):
    """(group, number, total, rows) of each piece in a table of nodes sorted by group and place."""
    groups, places, totals = (table.column(c).to_pylist() for c in ("grp", "pos", "total"))
    at = 0
    while at < len(places):
        to, number = at, places[at] // size
        while to < len(places) and groups[to] == groups[at] and places[to] // size == number:
            to += 1
        yield groups[at], number, totals[at], slice(at, to)
        at = to


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, the place of a row in its ``grp`` by ``order``, and total, the rows of the group."""
    keys = ["grp", *order, "_row"]  # rows that are alike in all else may stand in any order, and in several ranges
    ranges = nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    at = nodes.columns.index("grp")

    def run(batches):
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(at)
            codes = np.asarray(pc.dictionary_encode(group).indices)
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            sizes = np.diff(np.r_[starts, len(codes)])
            place = np.arange(len(codes)) - np.repeat(starts, sizes)
            if group[0].as_py() == last:
                place[: sizes[0]] += count
            last, count = group[-1].as_py(), int(place[-1]) + 1
            own = [pa.array(np.full(len(codes), part)), pa.array(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "_part", "_idx"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    rows = staged(ranges.mapInArrow(run, f"{schema}, _part long, _idx long"), "manifest-ranges")
    sizes = rows.groupBy("grp", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("_part")  # a row for each range
    sizes = sizes.select(
        "grp", "_part", (F.sum("n").over(before) - F.col("n")).alias("_before"), F.sum("n").over(Window.partitionBy("grp")).alias("total")
    )
    out = rows.join(staged(sizes, "manifest-sizes"), ["grp", "_part"])
    kept = [c for c in nodes.columns if c != "grp"]
    return out.select("grp", (F.col("_before") + F.col("_idx")).alias("pos"), "total", *kept)


def _bin(n: int, size: int, pos: Column) -> Column:
    return F.pmod(F.xxhash64("grp", pos), F.lit(max(1, math.ceil(n / size))))


def _piece(size: int) -> Column:
    return F.floor(F.col("pos") / size).cast("long")


def grown(nodes: DataFrame, n: int, arity: int, most: int) -> DataFrame:
    """The tops of all pieces of ``n`` nodes, as nodes of the next table."""
    height = steps(most, arity)
    size = arity**height

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("pos", "ascending")])
        digests, out = table.column("digest").to_pylist(), []
        for group, number, total, rows in pieces(table, size):
            level = digests[rows]
            for _ in range(min(height, depth(total, arity))):
                level = [hashlib.sha256("".join(level[k : k + arity]).encode()).hexdigest() for k in range(0, len(level), arity)]
            out.append((group, number, -(-total // size), level[0]))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["grp", "pos", "total", "digest"])

    packed = nodes.select("grp", "pos", "total", "digest", _bin(n, size, _piece(size)).alias("_bin"))
    return packed.groupBy("_bin").applyInArrow(run, NODE)


def lowered(nodes: DataFrame, above: DataFrame, n: int, arity: int, most: int) -> DataFrame:
    """Adds subroot, path and folded to the nodes of a table.

    ``above`` is (grp, pos, subroot, path) of the tops of their pieces. ``folded`` is the root
    with ``replacement`` instead of the node's digest; only tables with that column have it.
    """
    height = steps(most, arity)
    size = arity**height
    folds = "replacement" in nodes.columns

    def run(table: pa.Table, tops: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("pos", "ascending")])
        top_of = dict(zip(zip(*(tops.column(c).to_pylist() for c in ("grp", "pos")), strict=True), range(len(tops)), strict=True))
        digests = table.column("digest").to_pylist()
        values = table.column("replacement").to_pylist() if folds else digests
        lefts, rights, ends, subroots, folded = [], [], [0], [], []
        for group, number, total, rows in pieces(table, size):
            top = top_of[group, number]
            above = [(x["left"], x["right"]) for x in tops.column("path")[top].as_py()]
            levels, level = [], digests[rows]
            for _ in range(min(height, depth(total, arity))):
                level, slots = parents(level, arity)
                levels.append(slots)
            states = [(hashlib.sha256(left.encode()), right) for left, right in above]
            for k in range(rows.stop - rows.start):
                value, at = values[rows.start + k], k
                value = digests[rows.start + k] if value is None else value
                for slots in levels:
                    state, left, right = slots[at]
                    lefts.append(left)
                    rights.append(right)
                    at //= arity
                    if folds:
                        value = resumed(state, value, right)
                for left, right in above:
                    lefts.append(left)
                    rights.append(right)
                if folds:
                    for state, right in states:
                        value = resumed(state, value, right)
                    folded.append(value)
                ends.append(len(lefts))
            subroots += [tops.column("subroot")[top].as_py()] * (rows.stop - rows.start)
        siblings = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], names=["left", "right"])
        path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), siblings)
        table = table.drop_columns(["_bin"]).append_column("subroot", pa.array(subroots, pa.string())).append_column("path", path)
        return table.append_column("folded", pa.array(folded, pa.string())) if folds else table

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    schema += f", subroot string, path {PATH}" + (", folded string" if folds else "")
    bins = nodes.withColumn("_bin", _bin(n, size, _piece(size))).groupBy("_bin")
    tops = above.select("grp", "pos", "subroot", "path", _bin(n, size, F.col("pos")).alias("_bin")).groupBy("_bin")
    return bins.cogroup(tops).applyInArrow(run, schema)


def climbed(leaves: DataFrame, arity: int, most: int) -> list[tuple[DataFrame, int]]:
    """The tables of a forest, from the leaves to one node a group, each with its number of rows."""
    size = arity ** steps(most, arity)
    n, total = leaves.agg(F.count("*"), F.max("total")).first()
    levels = [(leaves, n)]
    while (total or 1) > 1:
        table = staged(grown(*levels[-1], arity, most), "manifest-level")
        levels.append((table, table.count()))
        total = -(-total // size)
    return levels


def descended(levels: list[tuple[DataFrame, int]], tops: DataFrame, arity: int, most: int) -> DataFrame:
    """The leaves with subroot and path, given (grp, pos, subroot, path) of the top table."""
    for table, n in reversed(levels[1:-1]):
        tops = staged(lowered(table, tops, n, arity, most).select("grp", "pos", "subroot", "path"), "manifest-paths")
    return lowered(*(levels[0][0], tops, levels[0][1]), arity, most)


def manifest(
    rows: DataFrame,
    key: str,
    group: str,
    fields: list[str],
    changed: tuple[Column, dict[str, Column]] | None = None,
    arity: int = ARITY,
    piece: int = PIECE,
) -> DataFrame:
    """(key, group, leaf, subroot, root, proof, folded_root, verified) of every row.

    ``leaf`` is ``row_digest`` of the fields. Leaves of one ``group`` value are placed by
    ascending ``key``; groups are placed by their value, bytewise. ``proof`` holds for every
    level, from the leaf up, the joined digests of the siblings to the left and to the right.
    ``changed`` is a condition and fields as they read where it holds; ``folded_root`` is the
    root that follows from the changed row and the siblings of the original ones, and
    ``verified`` says that it is the root of the table.

    A null group or key comes first, and a null field is hashed as such. Rows that repeat a key
    stand by their leaf; equal rows are leaves of their own. A group or table of one row has no
    siblings on that level. An empty table gives no rows. Long texts are hashed by Spark, which
    holds one row at a time. Other columns are not read.
    """
    leaf = row_digest([F.col(f) for f in fields])
    replacement = F.lit(None).cast("string")
    if changed is not None:
        where, values = changed
        replacement = F.when(where, row_digest([values.get(f, F.col(f)) for f in fields]))
    name = F.col(group).cast("string")
    nodes = rows.select(
        F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("grp"),
        F.col(key).alias("key"), F.col(group).alias("value"), leaf.alias("digest"), replacement.alias("replacement"),
    )
    leaves = staged(nodes, "manifest-leaves")
    placed = staged(numbered(leaves, ["key", "digest"]), "manifest-placed")
    unstaged(leaves)
    levels = climbed(placed, arity, piece)
    subroots = staged(levels[-1][0].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "manifest-subroots")
    above = climbed(staged(numbered(subroots, ["name"]), "manifest-groups"), arity, piece)
    top = above[-1][0].select("digest").first()
    root = F.lit(top[0] if top else None).cast("string")
    crown = above[-1][0].select("grp", "pos", F.col("digest").alias("subroot"), F.array().cast(PATH).alias("path"))
    paths = descended(above, crown, arity, piece) if len(above) > 1 else above[0][0].withColumn("path", F.array().cast(PATH))
    tops = staged(paths.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "path"), "manifest-tops")
    out = descended(levels if len(levels) > 1 else [*levels, levels[0]], tops, arity, piece)
    return out.select(
        F.col("key").alias(key), F.col("value").alias(group), F.col("digest").alias("leaf"), "subroot", root.alias("root"),
        F.col("path").alias("proof"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"),
    )


#: Fields of a document, in the order in which they are hashed.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered() -> tuple[Column, dict[str, Column]]:
    """Documents whose n_chars is one too many: those whose crc32 of the id as text 7 divides."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % 7 == 0, F.lit(False)), {"n_chars": F.col("n_chars") + 1}


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, checked against a tampered copy, with a digest of each proof."""
    out = manifest(docs, "doc_id", "lang", FIELDS, tampered())
    siblings = F.array_join(F.transform("proof", lambda x: F.concat(x["left"], x["right"])), "")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def _field(x: str) -> str:
    return f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')"


def _row(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


def _tree(name: str, leaves: str, group: str) -> str:
    """A recursive table of all nodes above numbered leaves (pos, total, digest)."""
    return f"""{name} AS (
  SELECT 0 AS level, {group} AS g, pos, total, digest FROM {leaves}
  UNION ALL
  SELECT level + 1, g, pos // 2, any_value((total + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE total > 1 GROUP BY level, g, pos // 2)"""


def _folds(name: str, start: str, tree: str) -> str:
    """A recursive table: each value with the sibling on its level, up to the top."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT f.row, f.g, f.level + 1, f.pos // 2, (f.total + 1) // 2,
         sha256(CASE WHEN s.digest IS NULL THEN f.value WHEN f.pos % 2 = 1 THEN s.digest || f.value ELSE f.value || s.digest END),
         f.proof || coalesce(s.digest, '')
  FROM {name} f LEFT JOIN {tree} s ON s.g = f.g AND s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.total > 1)"""


MANIFEST_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {_row("n_chars")} AS digest, {_row("n_chars + 1")} AS other,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents),
placed AS (
  SELECT *, row_number() OVER () AS row, CASE WHEN crc % 7 = 0 THEN other ELSE digest END AS told,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY g) AS total
  FROM d),
{_tree("tree", "placed", "g")},
subroots AS (
  SELECT g AS name, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS total FROM tree WHERE total = 1),
{_tree("crown", "subroots", "''")},
{_folds("low", "SELECT row, g, 0 AS level, pos, total, told AS value, '' AS proof FROM placed", "tree")},
{_folds("high", "SELECT l.row, '' AS g, 0 AS level, s.pos, s.total, l.value, l.proof FROM low l JOIN subroots s ON s.name = l.g WHERE l.total = 1", "crown")},
root AS (SELECT digest AS root FROM crown WHERE total = 1)
SELECT p.doc_id, p.digest AS leaf, s.digest AS subroot, root, sha256(h.proof) AS proof_sha256, h.value AS folded_root, h.value = root AS verified
FROM placed p JOIN subroots s ON s.name = p.g JOIN high h ON h.row = p.row AND h.total = 1, root
"""
