"""Shared parts of the operators: staged tables, id filters, connected components, test folds."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm.words import mix

#: Bits of an id filter: 512 KB whatever the size of the table. A full filter lets more rows
#: through to the exact join behind it; results never depend on it.
FILTER_BITS = 1 << 22


#: Holds while a staged table is written: a batch of texts goes to Python a few MB at a time,
#: and shuffle files go when the table that they were made for is there.
WRITING = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of its own only where that is unset, in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="evalmill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings, changed for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstaged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing unwritten reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True for the test fold: crc32 of the id as text leaves 1 modulo 3 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    """The same for one value."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def arrow_map(
    df: DataFrame, schema: str, columns: list[str], rows: Callable[[pa.RecordBatch], Iterator[dict]]
) -> DataFrame:
    """Map batches of the named columns; ``rows`` yields dicts of column -> values."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for out in rows(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in target],
                    schema=target,
                )

    return df.select(*columns).mapInArrow(run, schema)


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def id_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of fixed size over a one-column table of ids, for ``may_hold``."""

    def marks(batches):
        own = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            values = np.asarray(batch.column(0).drop_null())
            for at in _places(values, bits):
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        words = own.view(np.int64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used])], names=["word", "mask"])

    found = ids.mapInArrow(marks, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy()
    return out.view(np.uint8)


def may_hold(marks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """False for ids that are surely not in the filter."""
    out = np.ones(len(ids), dtype=bool)
    for at in _places(ids, len(marks) * 8):
        out &= (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def texts_of(docs: DataFrame, ids: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) of the rows whose key is in ``ids``, perhaps some more: join exactly afterwards."""
    marks = docs.sparkSession.sparkContext.broadcast(id_filter(ids))
    schema = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(may_hold(marks.value, np.asarray(batch.column(0)))))

    return schema.filter(F.col(key).isNotNull()).mapInArrow(keep, f"{key} long, {text} string")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of the edges (a long, b long).

    Large-star and small-star rounds: each node hooks its neighbours to the smallest one.
    Minima are combined before the shuffle and joined back, so a hub is never one group.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = now.checkpoint()
    nodes = now
    last = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = smallest(large)
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        )
        now = small.filter("u <> v").distinct().checkpoint()
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    ids = nodes.select(F.col("u").alias("id")).union(nodes.select("v")).distinct()
    top = now.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "id")
    return ids.join(top, "id", "left").select("id", F.coalesce("m", "id").alias("component"))
